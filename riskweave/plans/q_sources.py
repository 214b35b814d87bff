"""Reading, writing and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions import dims
from riskweave.operators.alerts import build_alerts
from riskweave.plans import sqltext as S
from riskweave.plans.registry import query
from riskweave.plans.views import ac, raw_tx, tx
from riskweave.runtime import scratch_path
from riskweave.scorers import compliance, geo
from riskweave.sources import files, jsonrows, schemas

_BY_TYPE = """SELECT transaction_type, count(*) AS n, round(sum(amount_npr), 2) AS amount,
 CAST(min(transaction_date) AS STRING) AS first_day, CAST(sum(is_fraud) AS BIGINT) AS frauds FROM tx GROUP BY transaction_type"""


def _by_type(df):
    return df.groupBy("transaction_type").agg(
        F.count("*").alias("n"),
        F.round(F.sum("amount_npr"), 2).alias("amount"),
        F.min("transaction_date").cast("string").alias("first_day"),
        F.sum("is_fraud").alias("frauds"),
    )


def _canonical(spark, d):
    """tx cast to the canonical schema."""
    return tx(spark, d).select(*[F.col(f.name).cast(f.dataType) for f in schemas.TRANSACTIONS])


@query("io1_read_parquet", _BY_TYPE)
def io1(spark, d):
    path = scratch_path(spark, "transactions.parquet")
    _canonical(spark, d).write.parquet(path)
    return _by_type(files.read_parquet(spark, path, schemas.TRANSACTIONS))


@query(
    "io1_read_accounts",
    "SELECT account_type, count(*) AS n, CAST(sum(account_age_days) AS BIGINT) AS days, CAST(max(account_open_date) AS STRING) AS newest FROM ac GROUP BY account_type",
    views=("ac",),
)
def io1_accounts(spark, d):
    path = scratch_path(spark, "accounts.parquet")
    ac(spark, d).select(*[F.col(f.name).cast(f.dataType) for f in schemas.ACCOUNTS]).write.parquet(path)
    return files.read_parquet(spark, path, schemas.ACCOUNTS).groupBy("account_type").agg(
        F.count("*").alias("n"),
        F.sum("account_age_days").alias("days"),
        F.max("account_open_date").cast("string").alias("newest"),
    )


@query(
    "io2_read_csv",
    "SELECT CAST(\"Date\" AS STRING) AS day, count(*) AS n, round(sum(amount_local_npr), 2) AS amount, CAST(sum(cross_border_flag) AS BIGINT) AS cross_border FROM raw_tx GROUP BY 1",
    views=("raw_tx",),
)
def io2(spark, d):
    path = scratch_path(spark, "transactions.csv")
    raw_tx(spark, d).write.csv(path, header=True, dateFormat="yyyy-MM-dd")
    df = files.read_csv(spark, path, schemas.RAW_TRANSACTIONS)
    return df.groupBy(F.col("Date").cast("string").alias("day")).agg(
        F.count("*").alias("n"),
        F.round(F.sum("amount_local_npr"), 2).alias("amount"),
        F.sum("cross_border_flag").alias("cross_border"),
    )


@query("io3_choose_source", _BY_TYPE)
def io3(spark, d):
    root = scratch_path(spark, "input")
    _canonical(spark, d).write.parquet(f"{root}/deep/folder/transactions.parquet")
    # Nothing at the interim path: the table under the input folder is found.
    part = files.load_transactions(spark, f"{root}/interim/none.parquet", root, None, schemas.RAW_TRANSACTIONS)
    return _by_type(part)


@query(
    "io4_write_scores",
    "SELECT agent_name, count(*) AS n, round(sum(risk_score), 4) AS total FROM (SELECT 'geo_risk' AS agent_name, risk_score FROM geo UNION ALL SELECT 'kyc_aml', risk_score FROM kyc) GROUP BY agent_name",
    views=("tx", "ac"),
    ctes=(S.GEO_F, S.GEO, *S.KYC_ALL),
)
def io4(spark, d):
    t = tx(spark, d)
    path = scratch_path(spark, "scores")
    both = geo.score(t).unionByName(compliance.score(compliance.join_accounts(t, ac(spark, d))))
    files.write_scores(both, path)
    return files.read_scores(spark, path).groupBy("agent_name").agg(
        F.count("*").alias("n"), F.round(F.sum("risk_score"), 4).alias("total")
    )


@query("io5_model_round_trip", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS changed FROM tx")
def io5(spark, d):
    from pyspark.ml import PipelineModel

    t = tx(spark, d)
    model = geo.fit(t, kind="logistic")
    path = scratch_path(spark, "geo_model")
    model.write().overwrite().save(path)
    before = geo.score(t, model).select("transaction_id", F.col("risk_score").alias("a"))
    after = geo.score(t, PipelineModel.load(path)).select("transaction_id", F.col("risk_score").alias("b"))
    return before.join(after, "transaction_id").agg(
        F.count("*").alias("n"), F.count(F.when(F.abs(F.col("a") - F.col("b")) > 1e-12, 1)).alias("changed")
    )


@query(
    "io6_json_round_trip",
    "SELECT transaction_type, count(*) AS n, round(sum(amount_npr), 2) AS amount, count(remittance_corridor) AS corridors, count(*) AS same FROM tx GROUP BY transaction_type",
)
def io6(spark, d):
    original = _canonical(spark, d)
    rows = jsonrows.to_json_rows(original)
    back = jsonrows.from_json_rows(rows, schemas.TRANSACTIONS)
    again = F.to_json(F.struct(*back.columns), {"ignoreNullFields": "false"})
    both = rows.select("json", F.from_json("json", schemas.TRANSACTIONS).alias("r")).select("json", "r.*")
    compared = both.withColumn("again", F.when(again == F.col("json"), again))
    return compared.groupBy("transaction_type").agg(
        F.count("*").alias("n"),
        F.round(F.sum("amount_npr"), 2).alias("amount"),
        F.count("remittance_corridor").alias("corridors"),
        F.count("again").alias("same"),
    )


@query(
    "io7_corridor_risk",
    f"SELECT transaction_id, {S.TIER} AS tier, f_corridor_risk AS corridor_risk FROM tx JOIN geo_f USING (transaction_id)",
    ctes=(S.GEO_F,),
)
def io7(spark, d):
    t = tx(spark, d)
    dim = dims.corridor_dim(spark).select(F.col("corridor").alias("remittance_corridor"), "tier", "tier_score")
    return t.join(F.broadcast(dim), "remittance_corridor", "left").select(
        "transaction_id", "tier", F.coalesce("tier_score", F.lit(dims.UNKNOWN_CORRIDOR_SCORE)).alias("corridor_risk")
    )


@query(
    "io8_lookup_tables",
    """SELECT channel, original_currency, count(*) AS n,
 round(max(CASE channel WHEN 'mobile_banking' THEN 0.45 WHEN 'branch' THEN 0.225 WHEN 'atm' THEN 0.125 WHEN 'online_banking' THEN 0.125 WHEN 'pos' THEN 0.075 END)::DOUBLE, 6) AS mix,
 max(CASE original_currency WHEN 'USD' THEN 110.0 WHEN 'INR' THEN 1.58 WHEN 'QAR' THEN 30.0 END)::DOUBLE AS min_rate,
 max(CASE original_currency WHEN 'USD' THEN 135.0 WHEN 'INR' THEN 1.65 WHEN 'QAR' THEN 38.0 END)::DOUBLE AS max_rate,
 max(CASE remittance_corridor WHEN 'Qatar->Nepal' THEN 'QAR' WHEN 'India->Nepal' THEN 'INR' WHEN 'USA->Nepal' THEN 'USD' END) AS corridor_currency
 FROM tx GROUP BY channel, original_currency""",
)
def io8(spark, d):
    corridor = dims.corridor_dim(spark).select(F.col("corridor").alias("remittance_corridor"), F.col("currency").alias("cc"))
    rates = dims.rate_dim(spark).withColumnRenamed("currency", "original_currency")
    joined = (
        tx(spark, d)
        .join(F.broadcast(dims.channel_dim(spark)), "channel", "left")
        .join(F.broadcast(rates), "original_currency", "left")
        .join(F.broadcast(corridor), "remittance_corridor", "left")
    )
    return joined.groupBy("channel", "original_currency").agg(
        F.count("*").alias("n"), F.round(F.max("mix"), 6).alias("mix"), F.max("min_rate").alias("min_rate"),
        F.max("max_rate").alias("max_rate"), F.max("cc").alias("corridor_currency"),
    )


@query(
    "io8_known_cities",
    "SELECT city, count(*) AS n, max(CASE WHEN city IN ('Kathmandu','Pokhara') THEN 1 ELSE 0 END) AS known FROM ac GROUP BY city",
    views=("ac",),
)
def io8_cities(spark, d):
    known = F.broadcast(dims.city_dim(spark).withColumn("k", F.lit(1)))
    return ac(spark, d).join(known, "city", "left").groupBy("city").agg(
        F.count("*").alias("n"), F.coalesce(F.max("k"), F.lit(0)).alias("known")
    )


@query(
    "o1_alert_rows",
    """SELECT transaction_id, 'custom' AS agent_name, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, amount_npr / 2000000.0)), 6) AS risk_score,
 CASE WHEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, amount_npr / 2000000.0)) >= 0.5::DOUBLE THEN 1 ELSE 0 END AS alert_flag,
 'AGENT_SCORE' AS reason_code, 'Risk score generated by the agent.' AS explanation FROM tx""",
)
def o1(spark, d):
    out = build_alerts(tx(spark, d), "custom", F.col("amount_npr") / 2_000_000.0, 0.5)
    return out.drop("timestamp").withColumn("risk_score", F.round("risk_score", 6))
