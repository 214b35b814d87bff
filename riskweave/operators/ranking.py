"""Exact global ranks and running sums over any number of rows.

A window without a partition, or with one huge partition, would run in one
task. Here the rows are range-partitioned on (group, order), each chunk is
summed on its own, and the totals of earlier chunks are added. A group of any
size spreads over as many chunks as it needs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.runtime import cut, partitions


# Rows of a chunk where their number is known: what a task sorts does not grow with the table.
CHUNK_ROWS = 200_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks that sort ``CHUNK_ROWS`` rows each on average, not fewer than the session's partitions."""
    return max(partitions(spark), -(-rows // CHUNK_ROWS))


def range_chunks(df: DataFrame, order: Sequence[Column], chunks: int | None = None) -> DataFrame:
    """Rows with a stored ``_chunk`` number that follows ``order``.

    The chunk number is written to shared storage before it is used twice: the
    range bounds come from a sample, and a recomputed stage must not see others.
    """
    ranged = df.repartitionByRange(chunks or partitions(df.sparkSession), *order)
    return cut(ranged.withColumn("_chunk", F.spark_partition_id()))


def running(
    df: DataFrame,
    order: Sequence[Column],
    sums: Mapping[str, Column],
    group: Sequence[str] = (),
    previous_max: Mapping[str, Column] | None = None,
    after: Mapping[str, Column] | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Add running sums (current row included) and maxima of the rows before.

    ``after`` are sums from the current row to the end of its group.
    ``order`` must be total within a group; group columns must not be null.
    With ``rows``, the number of rows, chunks and tasks grow in number with it, not in size.
    """
    previous_max, after = previous_max or {}, after or {}
    group = list(group)
    named = df.select(
        "*",
        *[c.alias(f"_v_{n}") for n, c in sums.items()],
        *[c.alias(f"_m_{n}") for n, c in previous_max.items()],
        *[c.alias(f"_a_{n}") for n, c in after.items()],
    )
    n = tasks_for(df.sparkSession, rows or 0)
    chunks = range_chunks(named, [*[F.col(g) for g in group], *order], n)
    keys = ["_chunk", *group]
    # A number given here is kept: tasks are neither merged again nor as few as those of other shuffles.
    dealt = chunks if rows is None else chunks.repartition(n, *keys)

    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select(
        "*",
        *[F.sum(f"_v_{n}").over(upto).alias(f"_l_{n}") for n in sums],
        *[F.max(f"_m_{n}").over(before).alias(f"_p_{n}") for n in previous_max],
        *([F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias("_place")] if after else []),
    )
    if after:
        back = Window.partitionBy(*keys).orderBy(F.desc("_place")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = local.select("*", *[F.sum(f"_a_{n}").over(back).alias(f"_b_{n}") for n in after])

    # One row per chunk and group: at most chunks + groups rows in all.
    totals = chunks.groupBy(*keys).agg(
        *[F.sum(f"_v_{n}").alias(f"_v_{n}") for n in sums],
        *[F.max(f"_m_{n}").alias(f"_m_{n}") for n in previous_max],
        *[F.sum(f"_a_{n}").alias(f"_a_{n}") for n in after],
        F.count("*").alias("_n"),
    )
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*(group or [F.lit(0)])).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        *[F.sum(f"_v_{n}").over(earlier).alias(f"_o_{n}") for n in sums],
        *[F.max(f"_m_{n}").over(earlier).alias(f"_q_{n}") for n in previous_max],
        *[F.sum(f"_a_{n}").over(later).alias(f"_d_{n}") for n in after],
    )
    joined = local.join(offsets, keys, "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_l_{n}") + F.coalesce(F.col(f"_o_{n}"), F.lit(0))).alias(n) for n in sums],
        *[F.greatest(f"_p_{n}", f"_q_{n}").alias(n) for n in previous_max],
        *[(F.col(f"_b_{n}") + F.coalesce(F.col(f"_d_{n}"), F.lit(0))).alias(n) for n in after],
    )


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank", group: Sequence[str] = ()) -> DataFrame:
    """1-based position of every row in ``order`` (within ``group``)."""
    return running(df, order, {name: F.lit(1).cast("bigint")}, group)


# Rows of a boundary cell that are ranked without narrowing it further, and the sketch's resolution.
_CELL_ROWS = 1_000_000
_RESOLUTION = 10_000


def _number(df: DataFrame, value: str) -> Column:
    """The value as a number in the same order; times as microseconds."""
    kind = df.schema[value].dataType.typeName()
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(value).cast("timestamp"))
    return F.unix_date(value) if kind == "date" else F.col(value)


def first_rows(df: DataFrame, value: str, tie: str, k: int, descending: bool = False, cell_rows: int = _CELL_ROWS) -> Column:
    """Condition that holds for exactly the first ``k`` rows by ``value``, then ``tie``; nulls last, NaN above all numbers.

    The table is not sorted. A quantile sketch proposes a range around position ``k``, exact counts
    before and within it confirm the proposal, and the range narrows while it holds more than
    ``cell_rows`` rows and two values. Only the rows of the last range are ranked. ``df`` is read
    several times, so it should be stored; ``tie`` must be unique.
    """
    v, t = F.col("_v"), F.col("_t")
    slim = df.select(_number(df, value).alias("_v"), F.col(tie).alias("_t"))
    n, known = slim.agg(F.count("*"), F.count("_v")).first()
    if k <= 0:
        return F.lit(False)
    if k >= n:
        return F.lit(True)
    here = _number(df, value)
    if k == known:
        return here.isNotNull()
    if k > known:
        cell, size, before = slim.filter(v.isNull()), n - known, known
    else:
        cell, size, before = slim.filter(v.isNotNull()), known, 0
        while size > cell_rows:
            at = (k - before) / size
            at, margin = (1 - at if descending else at), 2.0 / _RESOLUTION
            found = cell.agg(F.percentile_approx("_v", [max(0.0, at - margin), min(1.0, at + margin)], _RESOLUTION).alias("q")).first()["q"]
            low, high = (F.lit(x).cast(cell.schema["_v"].dataType) for x in found)
            # coalesce keeps the filter away from column statistics, which leave NaN out.
            inside = F.coalesce((v >= low) & (v <= high), F.lit(False))
            ahead, within = cell.agg(F.count_if((v > high) if descending else (v < low)), F.count_if(inside)).first()
            if not ahead < k - before <= ahead + within or within == size:
                break  # No narrower range is certain: the rest is ranked as it is.
            cell, size, before = cell.filter(inside), within, before + ahead
            if found[0] == found[1]:
                break
    order = [v.desc_nulls_last() if descending else v.asc_nulls_last(), t]
    edge = global_rank(cell, order, "_rank").filter(F.col("_rank") == k - before).first()
    last = F.lit(edge["_t"]).cast(slim.schema["_t"].dataType)
    if k > known:
        return here.isNotNull() | (F.col(tie) <= last)
    bound = F.lit(edge["_v"]).cast(slim.schema["_v"].dataType)
    ahead = here > bound if descending else here < bound
    return F.coalesce(ahead | ((here == bound) & (F.col(tie) <= last)), F.lit(False))


def temporal_split(df: DataFrame, ts: str, tie: str, fraction: float = 0.8) -> DataFrame:
    """Add ``is_train``: the first ``floor(n * fraction)`` rows in time order, null times last."""
    df = cut(df)
    return df.withColumn("is_train", first_rows(df, ts, tie, int(df.count() * fraction)).cast("int"))


def top_fraction(df: DataFrame, score: str, tie: str, fraction: float) -> DataFrame:
    """The k = max(1, min(n, ceil(n * fraction))) rows with the highest score, ranked; only they are sorted."""
    df = cut(df)
    n = df.count()
    k = max(1, min(n, -int(-n * fraction // 1)))
    kept = df.filter(first_rows(df, score, tie, k, descending=True))
    return global_rank(kept, [F.col(score).desc(), F.col(tie)], "rank")
