"""The long result table of every scorer, and what is derived from it."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions.scalars import clip01, words
from riskweave.operators.ranking import running

ALERT_SCHEMA = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("agent_name", T.StringType()),
        T.StructField("risk_score", T.DoubleType()),
        T.StructField("alert_flag", T.IntegerType()),
        T.StructField("reason_code", T.StringType()),
        T.StructField("explanation", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)


def empty_alerts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ALERT_SCHEMA)


def has_columns(df: DataFrame, names: Sequence[str]) -> bool:
    """Whether all needed columns exist; decided while planning."""
    return set(names) <= set(df.columns)


def build_alerts(
    df: DataFrame,
    agent: str,
    score: Column,
    threshold: float,
    reason: Column | str = "AGENT_SCORE",
    explanation: Column | str = "Risk score generated by the agent.",
    scored_at: dt.datetime | None = None,
) -> DataFrame:
    """One alert row per input row: score clipped to [0, 1], flag, reason, text.

    ``reason`` may depend on the columns of ``df`` and on ``risk_score``;
    ``explanation`` also on ``reason_code``.
    """
    if not has_columns(df, ("transaction_id",)):
        return empty_alerts(df.sparkSession)
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    stamp = F.lit(scored_at or dt.datetime.now(dt.timezone.utc)).cast("timestamp")
    return (
        df.withColumn("risk_score", clip01(score).cast("double"))
        .withColumn("reason_code", as_col(reason))
        .select(
            F.col("transaction_id").cast("string").alias("transaction_id"),
            F.lit(agent).alias("agent_name"),
            "risk_score",
            (F.col("risk_score") >= F.lit(threshold)).cast("int").alias("alert_flag"),
            "reason_code",
            as_col(explanation).alias("explanation"),
            stamp.alias("timestamp"),
        )
    )


# Sentences for transactions without a stored score.
_NO_SCORE = {
    "velocity": "no velocity score is available",
    "geo_risk": "no geographic score is available",
    "behaviour": "no behaviour score is available for this transaction",
    "graph": "no graph score is available for this transaction",
    "meta_learner": "no meta-learner score available for this transaction",
    "kyc_aml": "No KYC/AML score is available for this transaction.",
    "explanation": "No explanation is available for transaction",
}


def explain(alerts: DataFrame, ids: DataFrame, agent: str, model: str | None = None) -> DataFrame:
    """Sentence per requested transaction from the stored alert table.

    ``ids`` holds the transaction ids asked for; unknown ones get the default.
    """
    stored = alerts.filter(F.col("agent_name") == agent).select("transaction_id", "reason_code", "explanation")
    found = ids.select(F.col("transaction_id").cast("string")).join(stored, "transaction_id", "left")
    head = F.concat(F.lit("Transaction "), F.col("transaction_id"), F.lit(": "))
    if agent == "kyc_aml":
        text = F.concat(head, F.coalesce("explanation", F.lit(_NO_SCORE[agent])))
    elif agent == "explanation":
        default = F.concat(F.lit(_NO_SCORE[agent] + " "), F.col("transaction_id"), F.lit("."))
        text = F.coalesce(F.col("explanation"), default)
    else:
        tail = "." if model is None else f" ({model})."
        text = F.concat(head, words(F.coalesce("reason_code", F.lit(_NO_SCORE[agent]))), F.lit(tail))
    return found.select("transaction_id", text.alias("explanation"))


def pivot_scores(alerts: DataFrame, agents: Sequence[str], label: str | None = None) -> DataFrame:
    """Long scores to one ``<agent>_score`` column each, absent scores 0.

    One shuffle by transaction. Duplicate scores of one agent resolve to their
    maximum, which does not depend on row order.
    """
    cols = [
        F.coalesce(F.max(F.when(F.col("agent_name") == a, F.col("risk_score"))), F.lit(0.0)).alias(f"{a}_score")
        for a in agents
    ]
    if label is not None:
        cols.append(F.max(label).alias(label))
    return alerts.groupBy("transaction_id").agg(*cols)


def join_scores(base: DataFrame, scores: Mapping[str, DataFrame]) -> DataFrame:
    """Left-join scorer outputs onto ``base``; a missing score counts 0.

    The scorer tables are stacked and pivoted first, so ``base`` is shuffled
    once however many scorers there are.
    """
    stacked = None
    for name, df in scores.items():
        part = df.select("transaction_id", F.lit(name).alias("agent_name"), "risk_score")
        stacked = part if stacked is None else stacked.unionByName(part)
    wide = pivot_scores(stacked, list(scores))
    return base.join(wide, "transaction_id", "left").fillna(0.0, [f"{n}_score" for n in scores])


def pair_scores(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Inner join of two scorers with prefixed score, flag and reason columns."""

    def renamed(df: DataFrame, p: str) -> DataFrame:
        return df.select(
            "transaction_id",
            F.col("risk_score").alias(f"{p}_score"),
            F.col("alert_flag").alias(f"{p}_flag"),
            F.col("reason_code").alias(f"{p}_reason"),
        )

    return renamed(left, left_name).join(renamed(right, right_name), "transaction_id", "inner")


def alert_summary(paired: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Alert count and rate of each scorer and of both together."""
    both = F.col(f"{left_name}_flag") * F.col(f"{right_name}_flag")
    named = [
        (left_name, F.col(f"{left_name}_flag")),
        (right_name, F.col(f"{right_name}_flag")),
        ("both", both),
    ]
    one = paired.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"n{i}") for i, (_, c) in enumerate(named)],
        *[F.avg(c).alias(f"r{i}") for i, (_, c) in enumerate(named)],
    )
    items = [
        F.struct(
            F.lit(n if n != "geo" else "geo_risk").alias("agent"),
            F.col(f"n{i}").alias("alerts"),
            F.col(f"r{i}").alias("alert_rate"),
        )
        for i, (n, _) in enumerate(named)
    ]
    return one.select(F.inline(F.array(*items)))


def top_scores(alerts: DataFrame, n: int) -> DataFrame:
    """The ``n`` highest scores; equal scores in id order."""
    return alerts.orderBy(F.col("risk_score").desc(), "transaction_id").limit(n)


def reason_counts(alerts: DataFrame) -> DataFrame:
    return (
        alerts.groupBy("reason_code").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("reason_code"))
    )


def describe_scores(alerts: DataFrame, col: str = "risk_score") -> DataFrame:
    """Count, mean, deviation, range and exact quartiles (linear interpolation).

    Quartiles are read from running counts over the distinct values, so no
    task has to hold all of them.
    """
    moments = alerts.agg(
        F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"), F.max(col).alias("max"),
    ).first()
    counted = alerts.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("_n"))
    upto = running(counted, [F.col(col)], {"_upto": F.col("_n")})
    quartiles = []
    for q in (0.25, 0.5, 0.75):
        at = q * (moments["count"] - 1)
        low = F.min(F.when(F.col("_upto") > math.floor(at), F.col(col)))
        high = F.min(F.when(F.col("_upto") > math.ceil(at), F.col(col)))
        quartiles.append((low + (high - low) * (at - math.floor(at))).alias(f"p{int(q * 100)}"))
    fixed = [F.lit(moments[n]).alias(n) for n in ("count", "mean", "std", "min", "max")]
    return upto.agg(*quartiles).select(*fixed, "p25", "p50", "p75")


def null_counts(df: DataFrame, n: int = 5) -> DataFrame:
    """Columns with the most nulls; one pass over the table."""
    one = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns])
    items = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in df.columns])
    return one.select(F.inline(items)).orderBy(F.col("nulls").desc(), "column_name").limit(n)


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows, classes, positives, rate and the clipped negative/positive ratio."""
    y = F.coalesce(F.col(label).try_cast("int"), F.lit(0))
    one = df.agg(
        F.count("*").alias("rows"),
        F.count_distinct(F.col(label)).alias("classes"),
        F.sum(y).alias("positives"),
        F.avg(y).alias("rate"),
    )
    neg = F.col("rows") - F.col("positives")
    weight = F.when(F.col("positives") == 0, 1.0).otherwise(
        F.greatest(F.lit(1.0), F.least(F.lit(99.0), F.try_divide(neg, F.col("positives"))))
    )
    return one.withColumn("pos_weight", weight)
