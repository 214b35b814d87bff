"""Joins of transactions, accounts and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import alerts as A
from riskweave.operators import graph as G
from riskweave.operators.sequences import behaviour_rows, sequences
from riskweave.plans import parts as P
from riskweave.plans import sqltext as S
from riskweave.plans.registry import query
from riskweave.plans.views import ac, tx
from riskweave.scorers import behaviour, compliance, explanation, geo, meta, network
from riskweave.scorers.together import score_together


@query(
    "j1_account_features",
    "SELECT transaction_id, sender_account_id, kyc_verified, kyc_risk_grade, is_pep, is_sanctioned, CAST(account_age_days AS BIGINT) AS account_age_days FROM kyc_j",
    views=("tx", "ac"),
    ctes=(S.KYC_J,),
)
def j1(spark, d):
    return P.joined(spark, d).select(
        "transaction_id", "sender_account_id", "kyc_verified", "kyc_risk_grade", "is_pep", "is_sanctioned",
        F.col("account_age_days").cast("bigint").alias("account_age_days"),
    )


def _pair(spark, d):
    t = tx(spark, d)
    return A.pair_scores(geo.score(t), compliance.score(P.joined(spark, d)), "geo", "kyc")


_PAIR = """pair AS (SELECT transaction_id, round(g.risk_score, 6) AS geo_score, CASE WHEN g.risk_score >= 0.65 THEN 1 ELSE 0 END AS geo_flag,
 g.reason_code AS geo_reason, round(k.risk_score, 6) AS kyc_score, CASE WHEN k.risk_score >= 0.6 THEN 1 ELSE 0 END AS kyc_flag,
 k.reason_code AS kyc_reason FROM geo g JOIN kyc k USING (transaction_id))"""


@query("j2_pair_scores", "SELECT * FROM pair", views=("tx", "ac"), ctes=(S.GEO_F, S.GEO, *S.KYC_ALL, _PAIR))
def j2(spark, d):
    return P.rounded(_pair(spark, d), "geo_score", "kyc_score")


@query(
    "j3_label_join",
    "SELECT pair.*, tx.is_fraud FROM pair LEFT JOIN tx USING (transaction_id)",
    views=("tx", "ac"),
    ctes=(S.GEO_F, S.GEO, *S.KYC_ALL, _PAIR),
)
def j3(spark, d):
    labels = tx(spark, d).select("transaction_id", "is_fraud")
    return P.rounded(_pair(spark, d).join(labels, "transaction_id", "left"), "geo_score", "kyc_score")


_WIDE_ROUNDED = "SELECT transaction_id, is_fraud, fraud_type, round(velocity_score, 6) AS velocity_score, round(geo_risk_score, 6) AS geo_risk_score, round(behaviour_score, 6) AS behaviour_score, round(kyc_aml_score, 6) AS kyc_aml_score, round(graph_score, 6) AS graph_score FROM wide"


@query("j4_five_scores", _WIDE_ROUNDED, views=("tx", "ac"), ctes=S.WIDE_ALL)
def j4(spark, d):
    base = tx(spark, d).select("transaction_id", "is_fraud", "fraud_type")
    return P.rounded(A.join_scores(base, P.rule_alerts(spark, d)), *[f"{a}_score" for a in meta.AGENTS])


@query(
    "j4_five_scores_one_shuffle",
    """SELECT w.transaction_id, w.is_fraud, round(velocity_score, 6) AS velocity_score, round(geo_risk_score, 6) AS geo_risk_score, round(behaviour_score, 6) AS behaviour_score,
 round(kyc_aml_score, 6) AS kyc_aml_score, round(graph_score, 6) AS graph_score, vel.reason_code AS velocity_reason_code, geo.reason_code AS geo_risk_reason_code,
 kyc.reason_code AS kyc_aml_reason_code, CASE WHEN graph_score >= 0.65 THEN 'GRAPH_ANOMALY' ELSE 'NORMAL_GRAPH' END AS graph_reason_code
 FROM wide w JOIN vel USING (transaction_id) JOIN geo USING (transaction_id) JOIN kyc USING (transaction_id)""",
    views=("tx", "ac"),
    ctes=S.WIDE_ALL,
)
def j4_together(spark, d):
    out = score_together(tx(spark, d), ac(spark, d), keep=("is_fraud",))
    return P.rounded(out, *[f"{a}_score" for a in meta.AGENTS])


@query(
    "j5_meta_join",
    """SELECT transaction_id, round((geo_risk_score + kyc_aml_score) / 2, 6) AS meta_risk_score,
 CASE WHEN (geo_risk_score + kyc_aml_score) / 2 >= 0.5 THEN 1 ELSE 0 END AS meta_alert_flag,
 CASE WHEN (geo_risk_score + kyc_aml_score) / 2 >= 0.5 THEN 'META_ALERT' ELSE 'META_NORMAL' END AS meta_reason_code
 FROM (SELECT transaction_id, g.risk_score AS geo_risk_score, k.risk_score AS kyc_aml_score FROM geo g JOIN kyc k USING (transaction_id))""",
    views=("tx", "ac"),
    ctes=(S.GEO_F, S.GEO, *S.KYC_ALL),
)
def j5(spark, d):
    t = tx(spark, d)
    scores = {"geo_risk": geo.score(t), "kyc_aml": compliance.score(P.joined(spark, d))}
    table = A.join_scores(t.select("transaction_id"), scores)
    model = meta.MetaModel("random_forest", ["geo_risk_score", "kyc_aml_score"])
    out = explanation.add_meta(t.select("transaction_id"), meta.score(table, model))
    return P.rounded(out, "meta_risk_score")


@query(
    "j6_node_score_to_transactions",
    """SELECT transaction_id, round(coalesce(n.node_score, (SELECT avg(node_score) FROM half)), 6) AS node_score
 FROM tx LEFT JOIN half n ON n.node = tx.sender_account_id""",
    ctes=(*S.GRA_ALL[:2], S.GSCORE, "half AS (SELECT * FROM gs WHERE node < 'A5')"),
)
def j6(spark, d):
    """Scores of some accounts only, so that the default is used as well."""
    t = tx(spark, d)
    scores = network.heuristic_scores(G.node_features(G.edges(t))).filter(F.col("node") < "A5")
    return P.rounded(network.map_to_transactions(t, scores), "node_score")


@query(
    "j6_all_node_scores_to_transactions",
    """SELECT transaction_id, round(coalesce(n.node_score, (SELECT avg(node_score) FROM gs)), 6) AS node_score
 FROM tx LEFT JOIN gs n ON n.node = tx.sender_account_id""",
    ctes=(*S.GRA_ALL[:2], S.GSCORE),
)
def j6_all(spark, d):
    t = tx(spark, d)
    return P.rounded(network.map_to_transactions(t, network.heuristic_scores(G.node_features(G.edges(t)))), "node_score")


@query(
    "j7_window_score_to_transactions",
    """SELECT transaction_id, round(CASE WHEN r <= 16 THEN total ELSE 0 END, 6) AS seq_score FROM
 (SELECT *, sum(CASE WHEN r <= 16 THEN amount_npr END) OVER (PARTITION BY sender_account_id) AS total FROM
 (SELECT *, row_number() OVER (PARTITION BY sender_account_id ORDER BY txn_ts DESC, transaction_id DESC) AS r FROM tx))""",
)
def j7(spark, d):
    """The window's amount sum stands in for its score."""
    t = tx(spark, d)
    seq = sequences(behaviour_rows(t), behaviour.UNIT_STATS)
    total = F.aggregate("steps", F.lit(0.0), lambda acc, s: acc + s["amount_norm"])
    return P.rounded(behaviour.spread_back(t, seq.select("account", "ids", total.alias("seq_score"))), "seq_score")
