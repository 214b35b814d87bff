"""Aggregates, windows, order and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.evaluation import metrics as M
from riskweave.operators import alerts as A
from riskweave.operators import graph as G
from riskweave.operators.ranking import global_rank, running, temporal_split, top_fraction
from riskweave.operators.rolling import activity_windows
from riskweave.operators.sequences import behaviour_rows, normalisation, sequences, time_deltas
from riskweave.plans import parts as P
from riskweave.plans import sqltext as S
from riskweave.plans.registry import query
from riskweave.plans.views import tx, tx_dirty
from riskweave.scorers import behaviour, compliance, geo, meta
from riskweave.settings import DEFAULTS

HOT, DENSE = DEFAULTS["hot_key_rows"], DEFAULTS["dense_key_rows"]
_VT = "vt AS (SELECT transaction_id, sender_account_id AS s, epoch_us(txn_ts) AS us, amount_npr AS a FROM tx)"


def _timed(t):
    return t.select(
        "transaction_id", F.col("sender_account_id").alias("sender"),
        F.unix_micros(F.col("txn_ts").cast("timestamp")).alias("ts"), F.col("amount_npr").alias("amount"),
    )


def _windows(spark, d):
    return activity_windows(
        _timed(tx(spark, d)), "sender", "ts", "transaction_id", "amount", DEFAULTS["velocity_windows_hours"], DENSE, HOT
    )


@query(
    "a1_sender_corridor_count",
    "SELECT transaction_id, count(*) OVER (PARTITION BY sender_account_id, coalesce(remittance_corridor, 'None')) AS corridor_count FROM tx",
)
def a1(spark, d):
    return compliance.corridor_counts(tx(spark, d), HOT).select("transaction_id", "corridor_count")


@query(
    "a2_normalisation",
    """SELECT round(avg(a), 4) AS amount_mean, round(stddev_samp(a), 4) AS amount_std, round(avg(dt), 4) AS time_mean, round(stddev_samp(dt), 4) AS time_std
 FROM (SELECT a, (us - lag(us) OVER (PARTITION BY s ORDER BY us, transaction_id)) / 1e6 AS dt FROM vt)""",
    ctes=(_VT,),
)
def a2(spark, d):
    out = normalisation(behaviour_rows(tx(spark, d)), HOT)
    return P.rounded(out, *out.columns, digits=4)


@query(
    "a3_sender_moments",
    "SELECT transaction_id, round(avg(a) OVER (PARTITION BY s), 4) AS key_mean, round(stddev_samp(a) OVER (PARTITION BY s), 4) AS key_std FROM vt",
    ctes=(_VT,),
)
def a3(spark, d):
    return P.rounded(_windows(spark, d).select("transaction_id", "key_mean", "key_std"), "key_mean", "key_std", digits=4)


@query(
    "a4_alert_summary",
    """SELECT 'geo_risk' AS agent, CAST(sum(g) AS BIGINT) AS alerts, round(avg(g), 6) AS alert_rate FROM f UNION ALL
 SELECT 'kyc', CAST(sum(k) AS BIGINT), round(avg(k), 6) FROM f UNION ALL SELECT 'both', CAST(sum(g * k) AS BIGINT), round(avg(g * k), 6) FROM f""",
    views=("tx", "ac"),
    ctes=(
        S.GEO_F, S.GEO, *S.KYC_ALL,
        "f AS (SELECT CASE WHEN g.risk_score >= 0.3 THEN 1 ELSE 0 END AS g, CASE WHEN k.risk_score >= 0.2 THEN 1 ELSE 0 END AS k FROM geo g JOIN kyc k USING (transaction_id))",
    ),
)
def a4(spark, d):
    left = geo.score(tx(spark, d), settings={"geo_risk_alert_threshold": 0.3})
    right = compliance.score(P.joined(spark, d), {"kyc_aml_alert_threshold": 0.2})
    return P.rounded(A.alert_summary(A.pair_scores(left, right, "geo", "kyc"), "geo", "kyc"), "alert_rate")


@query(
    "a5_score_distribution",
    """SELECT count(*) AS count, round(avg(risk_score), 6) AS mean, round(stddev_samp(risk_score), 6) AS std, round(min(risk_score), 6) AS min,
 round(quantile_cont(risk_score, 0.25), 6) AS p25, round(quantile_cont(risk_score, 0.5), 6) AS p50, round(quantile_cont(risk_score, 0.75), 6) AS p75,
 round(max(risk_score), 6) AS max FROM beh""",
    ctes=S.BEH_ALL,
)
def a5(spark, d):
    t = tx(spark, d)
    out = A.describe_scores(behaviour.score(t, None))
    return P.rounded(out, "mean", "std", "min", "max", "p25", "p50", "p75")


@query("a6_reason_frequencies", "SELECT reason_code, count(*) AS n FROM geo GROUP BY reason_code", ctes=(S.GEO_F, S.GEO))
def a6(spark, d):
    return A.reason_counts(geo.score(tx(spark, d)))


@query(
    "a7_null_counts",
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM tx_dirty"
        for c in ("remittance_corridor", "merchant_category", "fraud_type", "sender_account_id", "amount_npr", "channel", "ip_country")
    ) + ") ORDER BY nulls DESC, column_name LIMIT 5",
    views=("tx_dirty",),
)
def a7(spark, d):
    return A.null_counts(tx_dirty(spark, d))


@query(
    "a8_class_balance",
    "SELECT count(*) AS rows, count(DISTINCT is_fraud) AS classes, CAST(sum(is_fraud) AS BIGINT) AS positives, round(avg(is_fraud), 6) AS rate FROM tx",
)
def a8(spark, d):
    return P.rounded(A.class_balance(tx(spark, d), "is_fraud").drop("pos_weight"), "rate")


@query("a9_pivot_scores", "SELECT transaction_id, round(velocity_score, 6) AS velocity_score, round(geo_risk_score, 6) AS geo_risk_score, round(behaviour_score, 6) AS behaviour_score, round(kyc_aml_score, 6) AS kyc_aml_score, round(graph_score, 6) AS graph_score, is_fraud FROM wide", views=("tx", "ac"), ctes=S.WIDE_ALL)
def a9(spark, d):
    long = None
    for part in P.rule_alerts(spark, d).values():
        long = part if long is None else long.unionByName(part)
    labelled = long.join(tx(spark, d).select("transaction_id", "is_fraud"), "transaction_id", "left")
    out = A.pivot_scores(labelled, meta.AGENTS, "is_fraud")
    return P.rounded(out, *[f"{a}_score" for a in meta.AGENTS])


@query(
    "a10_mean_of_scores",
    "SELECT transaction_id, round((velocity_score + geo_risk_score + behaviour_score + kyc_aml_score + graph_score) / 5, 6) AS mean_score FROM wide",
    views=("tx", "ac"),
    ctes=S.WIDE_ALL,
)
def a10(spark, d):
    table = P.wide(spark, d)
    return table.select("transaction_id", F.round(meta.average(meta.feature_columns(table)), 6).alias("mean_score"))


@query(
    "a11_class_weight",
    "SELECT transaction_type, round(greatest(1, least(99, sum(1 - is_fraud) / nullif(sum(is_fraud), 0)))::DOUBLE, 6) AS pos_weight FROM tx GROUP BY transaction_type HAVING sum(is_fraud) > 0 UNION ALL SELECT 'all', round(greatest(1, least(99, sum(1 - is_fraud) / sum(is_fraud)))::DOUBLE, 6) FROM tx",
)
def a11(spark, d):
    t = tx(spark, d)
    whole = A.class_balance(t, "is_fraud").select(F.lit("all").alias("transaction_type"), "pos_weight")
    per = t.groupBy("transaction_type").agg(F.sum("is_fraud").alias("p"), F.sum(1 - F.col("is_fraud")).alias("n"))
    per = per.filter("p > 0").select(
        "transaction_type", F.greatest(F.lit(1.0), F.least(F.lit(99.0), F.col("n") / F.col("p"))).alias("pos_weight")
    )
    return P.rounded(whole.unionByName(per), "pos_weight")


@query(
    "a12_recall_per_pattern",
    """SELECT agent_name, fraud_type AS pattern, round(avg(CASE WHEN s >= 0.5 THEN 1 ELSE 0 END), 6) AS detection_rate, count(*) AS count
 FROM el JOIN ev USING (transaction_id) WHERE fraud_type IS NOT NULL GROUP BY agent_name, fraud_type""",
    ctes=S.EVAL_ALL,
)
def a12(spark, d):
    return P.rounded(M.detection_rates(P.evaluated(spark, d), P.EVAL_COLUMNS), "detection_rate")


@query(
    "w1_rolling_activity",
    """SELECT transaction_id, c1::DOUBLE AS count_1h, c6::DOUBLE AS count_6h, c24::DOUBLE AS count_24h, c168::DOUBLE AS count_168h,
 round(s1, 2) AS sum_1h, round(s6, 2) AS sum_6h, round(s24, 2) AS sum_24h, round(s168, 2) AS sum_168h FROM vw""",
    ctes=(S.VT, S.VW),
)
def w1(spark, d):
    return _activity(_windows(spark, d))


# Payments below a million (more than half of the rows) under one sender, the rest as they are.
_HOT_SENDER = "CASE WHEN amount_npr < 1000000 THEN 'A0' ELSE sender_account_id END"


@query(
    "w1_rolling_activity_hot_sender",
    """SELECT transaction_id, c1::DOUBLE AS count_1h, c6::DOUBLE AS count_6h, c24::DOUBLE AS count_24h, c168::DOUBLE AS count_168h,
 round(s1, 2) AS sum_1h, round(s6, 2) AS sum_6h, round(s24, 2) AS sum_24h, round(s168, 2) AS sum_168h FROM vw""",
    ctes=(S.VT.replace("sender_account_id AS s", f"{_HOT_SENDER} AS s"), S.VW),
)
def w1_hot(spark, d):
    hot = _timed(tx(spark, d).withColumn("sender_account_id", F.expr(_HOT_SENDER)))
    return _activity(
        activity_windows(hot, "sender", "ts", "transaction_id", "amount", DEFAULTS["velocity_windows_hours"], DENSE, HOT)
    )


def _activity(windows):
    sums = [f"sum_{h}h" for h in DEFAULTS["velocity_windows_hours"]]
    counts = [f"count_{h}h" for h in DEFAULTS["velocity_windows_hours"]]
    return P.rounded(windows.select("transaction_id", *counts, *sums), *sums, digits=2)


@query("w2_seconds_since_previous", "SELECT transaction_id, round(since, 6) AS since FROM vl", ctes=(S.VT, S.VL))
def w2(spark, d):
    since = F.coalesce((F.col("ts") - F.col("previous_ts")) / 1e6, F.lit(86400.0))
    return _windows(spark, d).select("transaction_id", F.round(since, 6).alias("since"))


@query(
    "w3_time_delta",
    "SELECT transaction_id, round(coalesce((us - lag(us) OVER (PARTITION BY s ORDER BY us, transaction_id)) / 1e6, 0), 6) AS time_delta FROM vt",
    ctes=(_VT,),
)
def w3(spark, d):
    return P.rounded(time_deltas(behaviour_rows(tx(spark, d)), HOT).select("transaction_id", "time_delta"), "time_delta")


@query("w4_amount_zscore", "SELECT transaction_id, round(z, 6) AS amount_zscore FROM vl", ctes=(S.VT, S.VL))
def w4(spark, d):
    from riskweave.scorers import velocity

    return P.rounded(velocity.features(tx(spark, d)).select("transaction_id", "amount_zscore"), "amount_zscore")


@query(
    "w5_last_rows_per_account",
    """SELECT account, n, ids FROM (SELECT sender_account_id AS account, count(*) AS n, string_agg(transaction_id, ',' ORDER BY txn_ts, transaction_id) AS ids
 FROM (SELECT *, row_number() OVER (PARTITION BY sender_account_id ORDER BY txn_ts DESC, transaction_id DESC) AS r FROM tx) WHERE r <= 16 GROUP BY 1)""",
)
def w5(spark, d):
    seq = sequences(behaviour_rows(tx(spark, d)), behaviour.UNIT_STATS)
    return seq.select("account", F.size("ids").cast("bigint").alias("n"), F.array_join("ids", ",").alias("ids"))


@query(
    "w6_temporal_split",
    "SELECT transaction_id, CASE WHEN row_number() OVER (ORDER BY txn_ts, transaction_id) <= floor((SELECT count(*) FROM tx) * 0.8) THEN 1 ELSE 0 END AS is_train FROM tx",
)
def w6(spark, d):
    split = temporal_split(_timed(tx(spark, d)), "ts", "transaction_id")
    return split.select("transaction_id", "is_train")


@query(
    "t1_sorted_order",
    "SELECT transaction_id, row_number() OVER (PARTITION BY s ORDER BY us, transaction_id) AS position FROM vt",
    ctes=(_VT,),
)
def t1(spark, d):
    ranked = global_rank(_timed(tx(spark, d)), [F.col("ts"), F.col("transaction_id")], "position", ["sender"])
    return ranked.select("transaction_id", "position")


@query(
    "t2_top_scores",
    "SELECT transaction_id, round(risk_score, 6) AS risk_score, reason_code FROM kyc ORDER BY kyc.risk_score DESC, transaction_id LIMIT 3",
    views=("tx", "ac"),
    ctes=S.KYC_ALL,
)
def t2(spark, d):
    top = A.top_scores(compliance.score(P.joined(spark, d)), 3)
    return P.rounded(top.select("transaction_id", "risk_score", "reason_code"), "risk_score")


@query(
    "t3_top_fraction",
    "SELECT transaction_id, round(risk_score, 6) AS risk_score, rank FROM (SELECT *, row_number() OVER (ORDER BY risk_score DESC, transaction_id) AS rank FROM geo) WHERE rank <= greatest(1, least((SELECT count(*) FROM geo), ceil((SELECT count(*) FROM geo) * 0.05)))",
    ctes=(S.GEO_F, S.GEO),
)
def t3(spark, d):
    scored = geo.score(tx(spark, d)).select("transaction_id", F.round("risk_score", 6).alias("risk_score"))
    return top_fraction(scored, "risk_score", "transaction_id", 0.05)


@query("t5_all_accounts", "SELECT sender_account_id AS node FROM tx UNION SELECT receiver_account_id FROM tx")
def t5(spark, d):
    return G.nodes(G.edges(tx(spark, d)))


@query(
    "x1_running_sums",
    """SELECT transaction_id, row_number() OVER w AS rank, round(sum(a) OVER w, 2) AS running_amount FROM vt
 WINDOW w AS (ORDER BY us, transaction_id ROWS UNBOUNDED PRECEDING)""",
    ctes=(_VT,),
)
def x1(spark, d):
    out = running(
        _timed(tx(spark, d)), [F.col("ts"), F.col("transaction_id")],
        {"rank": F.lit(1).cast("bigint"), "running_amount": F.col("amount")},
    )
    return P.rounded(out.select("transaction_id", "rank", "running_amount"), "running_amount", digits=2)
