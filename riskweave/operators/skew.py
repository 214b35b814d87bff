"""Joins and splits that stay balanced when one key holds a large share of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.runtime import cut

# A list of this many keys (tens of MB) is still fit for a broadcast.
MAX_BROADCAST_KEYS = 500_000


def spread_join(
    rows: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    weight: str,
    spread_by: str,
    rows_per_task: int,
    how: str = "left",
) -> DataFrame:
    """Join per-key ``stats`` back to ``rows``, splitting keys with many rows.

    ``stats`` has one row per key and the key's row count in ``weight``. A key
    with more than ``rows_per_task`` rows is cut into ceil(weight / limit)
    salted parts. The list of such keys is broadcast: it has at most
    rows / rows_per_task entries, because each one stands for that many rows.
    """
    keys = list(keys)
    parts = F.ceil(F.col(weight) / F.lit(rows_per_task)).cast("int")
    hot = stats.filter(F.col(weight) > rows_per_task).select(*keys, parts.alias("_parts"))
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("_parts")), F.lit(0)).cast("int")
    )
    copies = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt", "_parts")


def split_heavy(df: DataFrame, key: str, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Split into rows of ordinary keys and rows of keys with over ``limit`` rows.

    The second part is None when no key is that heavy. Keys must not be null.
    """
    return split_counted(df, key, limit)[:2]


def split_counted(df: DataFrame, key: str, limit: int) -> tuple[DataFrame, DataFrame | None, int]:
    """``split_heavy`` with the number of rows of the second part."""
    heavy = cut(df.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit))
    n, rows = heavy.agg(F.count("*"), F.sum("_n")).first()
    if n == 0:
        return df, None, 0
    side = F.broadcast(heavy.select(key)) if n <= MAX_BROADCAST_KEYS else heavy.select(key)
    return df.join(side, key, "left_anti"), df.join(side, key, "left_semi"), rows
