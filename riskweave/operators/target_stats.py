"""Ordered target statistics: label means of a category over the rows before, in a fixed random order.

A row's own label never enters its statistic, so a model can be fitted on the
same rows. No list of categories leaves the executors, and a category may hold
any share of the rows: the sums run over range chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators.ranking import running
from riskweave.operators.skew import MAX_BROADCAST_KEYS, spread_join

KEYS = ("_category", "_value")


def _melted(df: DataFrame, categories: Sequence[str], *keep: Column) -> DataFrame:
    """A row per row and category column; null is a value of its own."""
    values = [
        F.struct(F.lit(c).alias(KEYS[0]), F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")).alias(KEYS[1]))
        for c in categories
    ]
    return df.select(*keep, F.explode(F.array(*values)).alias("_m")).select("*", "_m.*").drop("_m")


def _smoothed(positives: Column, known: Column, prior: float, strength: float) -> Column:
    return (positives + F.lit(strength * prior)) / (known + F.lit(float(strength)))


def _widened(points: DataFrame, categories: Sequence[str]) -> DataFrame:
    mean = lambda c: F.max(F.when(F.col("_category") == c, F.col("_mean")))
    return points.groupBy("_id").agg(*[mean(c).alias(f"{c}_mean") for c in categories])


def ordered_means(
    df: DataFrame, categories: Sequence[str], label: str, tie: str, prior: float, strength: float = 1.0, seed: int = 42
) -> DataFrame:
    """Add ``<category>_mean``: (positives before + strength * prior) / (labels before + strength).

    Before means: rows of the same category that come earlier by the hash of
    ``tie``, which is unique and not null. ``label`` is 0 or 1; rows whose label
    is null get their means and count in none.
    """
    points = _melted(
        df, categories, F.col(tie).alias("_id"), F.col(label).cast("bigint").alias("_y"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.col(tie).cast("string"))).alias("_at"),
    )
    own, known = F.coalesce(F.col("_y"), F.lit(0)), F.col("_y").isNotNull().cast("bigint")
    # Whole numbers: taking the row itself off again is exact.
    summed = running(points, [F.col("_at"), F.col("_id")], {"_p": own, "_n": known}, group=KEYS)
    means = summed.withColumn("_mean", _smoothed(F.col("_p") - own, F.col("_n") - known, prior, strength))
    wide = _widened(means, categories)
    return df.join(wide, df[tie] == wide["_id"]).drop("_id")


def category_totals(df: DataFrame, categories: Sequence[str], label: str) -> DataFrame:
    """Rows, labels and positives of every value of every category column."""
    return _melted(df, categories, F.col(label).cast("bigint").alias("_y")).groupBy(*KEYS).agg(
        F.count("*").alias("_rows"), F.count("_y").alias("_known"), F.coalesce(F.sum("_y"), F.lit(0)).alias("_positives")
    )


def with_totals(
    df: DataFrame, totals: DataFrame, categories: Sequence[str], tie: str, prior: float, strength: float, hot_rows: int
) -> DataFrame:
    """Add ``<category>_mean`` from stored totals to rows that had no part in them; unseen values get the prior."""
    points = _melted(df, categories, F.col(tie).alias("_id"))
    if totals.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS:
        joined = points.join(F.broadcast(totals), list(KEYS), "left")
    else:
        # Rows decide what is hot here, not those the totals came from.
        here = points.groupBy(*KEYS).agg(F.count("*").alias("_here")).join(totals, list(KEYS), "left")
        joined = spread_join(points, here, KEYS, "_here", "_id", hot_rows)
    known, positives = (F.coalesce(F.col(c), F.lit(0)) for c in ("_known", "_positives"))
    wide = _widened(joined.withColumn("_mean", _smoothed(positives, known, prior, strength)), categories)
    return df.join(wide, df[tie] == wide["_id"]).drop("_id")
