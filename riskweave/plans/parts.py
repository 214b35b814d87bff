"""Scored tables several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.scalars import clip01
from riskweave.plans.views import ac, tx
from riskweave.runtime import cut
from riskweave.scorers import behaviour, compliance, geo, network, velocity
from riskweave.scorers.meta import AGENTS
from riskweave.scorers.together import score_together


def joined(spark: SparkSession, d: str) -> DataFrame:
    return compliance.join_accounts(tx(spark, d), ac(spark, d))


def rule_alerts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The five scorers without trained models."""
    t = tx(spark, d)
    return {
        "velocity": velocity.score(t, None),
        "geo_risk": geo.score(t),
        "behaviour": behaviour.score_heuristic(t, behaviour.amount_stats(t)),
        "kyc_aml": compliance.score(joined(spark, d)),
        "graph": network.score(t),
    }


def wide(spark: SparkSession, d: str) -> DataFrame:
    """Five score columns per transaction, with label and pattern."""
    out = score_together(tx(spark, d), ac(spark, d), keep=("is_fraud", "fraud_type"))
    return out.select("transaction_id", "is_fraud", "fraud_type", *[f"{a}_score" for a in AGENTS])


def evaluated(spark: SparkSession, d: str) -> DataFrame:
    """Three score columns: one with many ties, one continuous, their mean."""
    t = tx(spark, d)
    stats = behaviour.amount_stats(t)
    geo_part = geo.features(t, tuple(t.columns))
    scored = geo_part.select(
        "transaction_id", "is_fraud", "fraud_type",
        clip01(geo.rule_score()).alias("geo_risk_score"),
        behaviour.heuristic(t, stats).alias("behaviour_score"),
    )
    return cut(scored.withColumn("meta_learner_score", (F.col("geo_risk_score") + F.col("behaviour_score")) / 2.0))


EVAL_COLUMNS = {
    "geo_risk": "geo_risk_score",
    "behaviour": "behaviour_score",
    "meta_learner": "meta_learner_score",
}


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])
