"""Column expressions: coercion, defaults, text, category ids, raw mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions import dims
from riskweave.functions import scalars as X
from riskweave.operators import alerts as A
from riskweave.operators.rolling import fill_missing_time
from riskweave.plans import sqltext as S
from riskweave.plans.registry import query
from riskweave.plans.views import ac, raw_ac, raw_tx, tx, tx_text
from riskweave.scorers import compliance, geo
from riskweave.sources import canonical


@query(
    "p1_numeric_coercion",
    """SELECT transaction_id, coalesce(TRY_CAST(amount_npr AS DOUBLE), 0.0) AS amount, coalesce(TRY_CAST(is_cross_border AS DOUBLE), 0.0) AS cross_border,
 coalesce(TRY_CAST(ip_is_vpn AS DOUBLE), 1.0) AS vpn FROM tx_text""",
    views=("tx_text",),
)
def p1(spark, d):
    return tx_text(spark, d).select(
        "transaction_id", X.number("amount_npr", 0).alias("amount"), X.number("is_cross_border", 0).alias("cross_border"),
        X.number("ip_is_vpn", 1).alias("vpn"),
    )


@query(
    "p2_parse_timestamp",
    "SELECT transaction_id, epoch_us(TRY_CAST(transaction_date || ' ' || transaction_time AS TIMESTAMP)) AS micros FROM tx_text",
    views=("tx_text",),
)
def p2(spark, d):
    t = tx_text(spark, d)
    return t.select("transaction_id", X.event_micros(t).alias("micros"))


@query(
    "p3_fill_missing_time",
    """SELECT transaction_id, coalesce(us, (row_number() OVER (ORDER BY transaction_id) - 1) * 1000000) AS micros FROM
 (SELECT transaction_id, epoch_us(TRY_CAST(transaction_date || ' ' || transaction_time AS TIMESTAMP)) AS us FROM tx_text)""",
    views=("tx_text",),
)
def p3(spark, d):
    t = tx_text(spark, d)
    timed = t.select("transaction_id", X.event_micros(t).alias("micros"))
    return fill_missing_time(timed, "micros", "transaction_id")


@query(
    "p4_column_aliases",
    """SELECT round(sum(f_corridor_risk), 4) AS corridor_risk, CAST(sum(f_ip_country_mismatch) AS BIGINT) AS mismatches,
 count(DISTINCT f_original_currency) AS currencies, count(DISTINCT f_sender_country) AS countries FROM geo_f""",
    ctes=(S.GEO_F,),
)
def p4(spark, d):
    renamed = tx(spark, d).withColumnsRenamed({"original_currency": "currency", "sender_account_id": "sender_account"})
    return geo.features(renamed).agg(
        F.round(F.sum("f_corridor_risk"), 4).alias("corridor_risk"),
        F.sum("f_ip_country_mismatch").cast("bigint").alias("mismatches"),
        F.count_distinct("f_original_currency").alias("currencies"),
        F.count_distinct("f_sender_country").alias("countries"),
    )


@query(
    "p5_text_defaults",
    "SELECT coalesce(sender_account_id, '__missing__') AS sender, coalesce(sender_country, 'unknown') AS country, count(*) AS n FROM tx_text GROUP BY 1, 2",
    views=("tx_text",),
)
def p5(spark, d):
    t = tx_text(spark, d)
    return t.groupBy(
        X.text_or(t, X.account_column(t, "sender"), "__missing__").alias("sender"),
        X.text_or(t, "sender_country", "unknown").alias("country"),
    ).agg(F.count("*").alias("n"))


_TYPE_SQL = """CASE "Payment_type" WHEN 'Cash Deposit' THEN 'deposit' WHEN 'Cross-border' THEN 'remittance_outbound' WHEN 'Cheque' THEN 'payment'
 WHEN 'ACH' THEN 'transfer' WHEN 'Credit card' THEN 'payment' WHEN 'Wire' THEN 'transfer' WHEN 'Cash Withdrawal' THEN 'withdrawal' ELSE 'payment' END"""
_CHANNEL_SQL = """CASE transmode_code WHEN 'A' THEN 'mobile_banking' WHEN 'B' THEN 'online_banking' WHEN 'E' THEN 'branch' WHEN 'F' THEN 'atm'
 WHEN 'J' THEN 'pos' WHEN 'P' THEN 'mobile_banking' WHEN 'Z' THEN 'branch' ELSE 'branch' END"""


@query(
    "p6_canonical_mapping",
    f"""SELECT CAST(row_number() OVER (ORDER BY event_id) - 1 AS STRING) AS transaction_id, "Sender_account" AS sender_account_id,
 "Receiver_account" AS receiver_account_id, round(amount_local_npr, 4) AS amount_npr, "Payment_currency" AS original_currency,
 coalesce(cross_border_flag, 0) AS is_cross_border, epoch_us(CAST(CAST("Date" AS STRING) || ' ' || "Time" AS TIMESTAMP)) AS micros,
 {_TYPE_SQL} AS transaction_type, {_CHANNEL_SQL} AS channel,
 CASE WHEN cross_border_flag = 1 THEN "Sender_bank_location" || '->Nepal' END AS remittance_corridor FROM raw_tx""",
    views=("raw_tx",),
)
def p6(spark, d):
    raw = canonical.row_numbers(raw_tx(spark, d, "event_id"), ["event_id"])
    return (
        canonical.transactions(raw)
        .withColumn("micros", F.unix_micros("timestamp"))
        .withColumn("amount_npr", F.round("amount_npr", 4))
        .drop("timestamp")
    )


@query(
    "p7_type_and_channel_maps",
    f"SELECT {_TYPE_SQL} AS transaction_type, {_CHANNEL_SQL} AS channel, count(*) AS n FROM raw_tx GROUP BY 1, 2",
    views=("raw_tx",),
)
def p7(spark, d):
    return raw_tx(spark, d).groupBy(
        dims.lookup(F.col("Payment_type"), dims.PAYMENT_TYPE, "payment").alias("transaction_type"),
        dims.lookup(F.col("transmode_code"), dims.MODE_CHANNEL, "branch").alias("channel"),
    ).agg(F.count("*").alias("n"))


@query(
    "p8_account_features",
    """SELECT account_id, CAST(coalesce(date_diff('day', opened, DATE '2022-12-31'), 0) AS INTEGER) AS account_age_days, 1 AS kyc_verified,
 coalesce(lower(risk_grade), 'low') AS kyc_risk_grade, coalesce(pep_flag, 0) AS is_pep, coalesce(sanctions_hit, 0) AS is_sanctioned, 0 AS is_mule FROM raw_ac""",
    views=("raw_ac",),
)
def p8(spark, d):
    return canonical.accounts(raw_ac(spark, d))


@query(
    "p9_clip_scores",
    "SELECT transaction_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, amount_npr / 1000000.0 - 0.5::DOUBLE)), 6) AS score FROM tx",
)
def p9(spark, d):
    return tx(spark, d).select(
        "transaction_id", F.round(X.clip01(F.col("amount_npr") / 1_000_000.0 - 0.5), 6).alias("score")
    )


@query(
    "p10_alert_flag",
    "SELECT transaction_id, CASE WHEN risk_score >= 0.5 THEN 1 ELSE 0 END AS alert_flag FROM geo",
    ctes=(S.GEO_F, S.GEO),
)
def p10(spark, d):
    return geo.score(tx(spark, d), settings={"geo_risk_alert_threshold": 0.5}).select("transaction_id", "alert_flag")


@query("p11_reason_chains", "SELECT transaction_id, reason_code FROM geo", ctes=(S.GEO_F, S.GEO))
def p11(spark, d):
    return geo.features(tx(spark, d)).select("transaction_id", geo.reason().alias("reason_code"))


@query(
    "p12_math",
    """SELECT transaction_id, round(ln(1 + amount_npr), 6) AS log_amount, round(1 / (1 + exp(-amount_npr / 1000000.0)), 6) AS logistic,
 round(abs(amount_npr - 500000.0), 4) AS distance, round(coalesce(amount_npr / nullif(is_cross_border, 0), 0), 4) AS safe_ratio,
 round(greatest(amount_npr, 100000.0), 4) AS at_least, round(least(amount_npr, 100000.0), 4) AS at_most FROM tx""",
)
def p12(spark, d):
    a = F.col("amount_npr")
    return tx(spark, d).select(
        "transaction_id",
        F.round(F.log1p(a), 6).alias("log_amount"),
        F.round(1 / (1 + F.exp(-a / 1_000_000.0)), 6).alias("logistic"),
        F.round(F.abs(a - 500_000.0), 4).alias("distance"),
        F.round(X.ratio(a, F.col("is_cross_border")), 4).alias("safe_ratio"),
        F.round(F.greatest(a, F.lit(100_000.0)), 4).alias("at_least"),
        F.round(F.least(a, F.lit(100_000.0)), 4).alias("at_most"),
    )


@query(
    "p13_text_functions",
    """SELECT transaction_id, lower(replace(reason_code, '_', ' ')) AS words, regexp_replace('geo_risk_score', '_score$', '') AS agent,
 'NPR ' || format('{:,.2f}', amount_npr) AS amount_text, concat_ws(', ', transaction_type, channel, remittance_corridor) AS joined
 FROM geo JOIN tx USING (transaction_id)""",
    ctes=(S.GEO_F, S.GEO),
)
def p13(spark, d):
    t = tx(spark, d)
    rows = geo.features(t, ("transaction_id", "amount_npr", "transaction_type", "channel", "remittance_corridor"))
    return rows.select(
        "transaction_id",
        X.words(geo.reason()).alias("words"),
        F.regexp_replace(F.lit("geo_risk_score"), "_score$", "").alias("agent"),
        F.concat(F.lit("NPR "), F.format_number("amount_npr", 2)).alias("amount_text"),
        F.array_join(F.array("transaction_type", "channel", "remittance_corridor"), ", ").alias("joined"),
    )


@query(
    "p14_first_distinct",
    """SELECT transaction_id, a || CASE WHEN b = a THEN '' ELSE ',' || b END || CASE WHEN c IN (a, b) THEN '' ELSE ',' || c END
 || CASE WHEN x IN (a, b, c) THEN '' ELSE ',' || x END AS listed FROM
 (SELECT transaction_id, sender_country AS a, ip_country AS b, receiver_country AS c, channel AS x FROM tx)""",
)
def p14(spark, d):
    items = F.array("sender_country", "ip_country", "receiver_country", "sender_country", "channel", "device_type")
    return tx(spark, d).select(
        "transaction_id",
        F.array_join(
            X.first_distinct(F.slice(items, 1, 5), 4), ","
        ).alias("listed"),
    )


@query(
    "p15_first_non_empty",
    "SELECT transaction_id, coalesce(nullif(trim(remittance_corridor), ''), nullif(trim(merchant_category), ''), 'unknown') AS place FROM tx",
)
def p15(spark, d):
    t = tx(spark, d)
    return t.select("transaction_id", X.first_text(t, ("remittance_corridor", "merchant_category"), "unknown").alias("place"))


@query(
    "p16_both_alert",
    """SELECT transaction_id, round(g.risk_score, 6) AS geo_score, round(k.risk_score, 6) AS kyc_score FROM geo g JOIN kyc k USING (transaction_id)
 WHERE g.risk_score >= 0.5 AND k.risk_score >= 0.2""",
    views=("tx", "ac"),
    ctes=(S.GEO_F, S.GEO, *S.KYC_ALL),
)
def p16(spark, d):
    t = tx(spark, d)
    pair = A.pair_scores(
        geo.score(t, settings={"alert_threshold": 0.5, "geo_risk_alert_threshold": 0.5}),
        compliance.score(compliance.join_accounts(t, ac(spark, d)), {"kyc_aml_alert_threshold": 0.2}),
        "geo", "kyc",
    )
    both = pair.filter((F.col("geo_flag") == 1) & (F.col("kyc_flag") == 1))
    return both.select("transaction_id", F.round("geo_score", 6).alias("geo_score"), F.round("kyc_score", 6).alias("kyc_score"))


@query(
    "p17_category_ids",
    """SELECT transaction_id, CASE transaction_type WHEN 'transfer' THEN 1 WHEN 'payment' THEN 2 WHEN 'withdrawal' THEN 3 WHEN 'deposit' THEN 4
 WHEN 'cash_out' THEN 5 WHEN 'remittance_inbound' THEN 6 WHEN 'remittance_outbound' THEN 7 ELSE 0 END AS type_id,
 CASE channel WHEN 'mobile_banking' THEN 1 WHEN 'atm' THEN 2 WHEN 'branch' THEN 3 WHEN 'online_banking' THEN 4 WHEN 'pos' THEN 5 ELSE 0 END AS channel_id FROM tx""",
)
def p17(spark, d):
    return tx(spark, d).select(
        "transaction_id",
        dims.category_id(F.col("transaction_type"), dims.TRANSACTION_TYPES).alias("type_id"),
        dims.category_id(F.col("channel"), dims.CHANNELS).alias("channel_id"),
    )


@query(
    "o3_explain_transactions",
    """SELECT transaction_id, 'Transaction ' || transaction_id || ': ' || lower(replace(coalesce(reason_code, 'no geographic score is available'), '_', ' ')) || '.' AS explanation
 FROM tx LEFT JOIN (SELECT * FROM geo WHERE risk_score > 0.1) g USING (transaction_id)""",
    ctes=(S.GEO_F, S.GEO),
)
def o3(spark, d):
    t = tx(spark, d)
    stored = geo.score(t).filter(F.col("risk_score") > 0.1)
    return A.explain(stored, t.select("transaction_id"), "geo_risk")


@query(
    "o3_explain_all_transactions",
    """SELECT transaction_id, 'Transaction ' || transaction_id || ': ' || lower(replace(coalesce(reason_code, 'no geographic score is available'), '_', ' ')) || '.' AS explanation
 FROM tx LEFT JOIN geo g USING (transaction_id)""",
    ctes=(S.GEO_F, S.GEO),
)
def o3_all(spark, d):
    t = tx(spark, d)
    return A.explain(geo.score(t), t.select("transaction_id"), "geo_risk")
