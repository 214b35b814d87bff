"""Per-key windows over event time: rolling count and sum, previous event."""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.ranking import global_rank, running, tasks_for
from riskweave.operators.skew import MAX_BROADCAST_KEYS, split_counted, split_heavy, spread_join
from riskweave.runtime import cut

HOUR_MICROS = 3_600_000_000


def fill_missing_time(df: DataFrame, ts: str, tie: str) -> DataFrame:
    """Null event times become 1970-01-01 plus the row's position in seconds.

    Rows have no position in a table, so the position is the rank of ``tie``
    among all rows. Rows are ranked only if some time is missing.
    """
    if df.filter(F.col(ts).isNull()).isEmpty():
        return df
    ranked = global_rank(df, [F.col(tie)], "_pos")
    return ranked.withColumn(ts, F.coalesce(F.col(ts), (F.col("_pos") - 1) * 1_000_000)).drop("_pos")


def activity_windows(
    df: DataFrame,
    key: str,
    ts: str,
    tie: str,
    value: str,
    hours: Sequence[int],
    dense_rows: int,
    hot_rows: int,
) -> DataFrame:
    """Add ``count_<h>h`` and ``sum_<h>h`` over the frame (t - h, t], the time
    of the key's previous row, and mean and deviation of the key's history.

    Rows with equal time count up to the current row in ``tie`` order. The
    windows of ordinary keys share one shuffle by ``key``. A null, NaN or infinite
    value is a row without an amount on either path: it is counted, adds 0
    to sums, and has no part in mean and deviation. Sums only ever add the
    amounts of their frame, so no other amount of the key, however large,
    touches them; the two layouts differ in the order of addition alone.
    """
    ordinary, dense = split_heavy(df, key, dense_rows)
    out = native_windows(ordinary, key, ts, tie, value, hours)
    if dense is None:
        return out
    return out.unionByName(chunked_windows(dense, key, ts, tie, value, hours, hot_rows))


def _with_finite(df: DataFrame, value: str) -> DataFrame:
    """Add ``_finite``: the value, null where it is NaN or infinite."""
    return df.withColumn("_finite", F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value).cast("double")))


def native_windows(df: DataFrame, key: str, ts: str, tie: str, value: str, hours: Sequence[int]) -> DataFrame:
    """The activity windows as Spark windows over one shuffle by ``key``.

    A frame is the rows before the current time and, of the rows of that
    time, those up to the current one.
    """
    df, value = _with_finite(df, value), "_finite"
    whole, by_time = Window.partitionBy(key), Window.partitionBy(key).orderBy(ts)
    upto = Window.partitionBy(key, ts).orderBy(tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = df.select(
        "*",
        F.lag(ts).over(whole.orderBy(ts, tie)).alias("previous_ts"),
        F.count("*").over(upto).alias("_un"),
        F.coalesce(F.sum(value).over(upto), F.lit(0.0)).alias("_uv"),
    )
    cols = []
    for h in hours:
        earlier = by_time.rangeBetween(-(int(h) * HOUR_MICROS - 1), -1)
        cols.append((F.count("*").over(earlier) + F.col("_un")).cast("double").alias(f"count_{h}h"))
        cols.append((F.coalesce(F.sum(value).over(earlier), F.lit(0.0)) + F.col("_uv")).alias(f"sum_{h}h"))
    return ordered.select(
        "*", *cols, F.avg(value).over(whole).alias("key_mean"), F.stddev_samp(value).over(whole).alias("key_std")
    ).drop("_un", "_uv", "_finite")


def chunked_windows(
    df: DataFrame, key: str, ts: str, tie: str, value: str, hours: Sequence[int], hot_rows: int
) -> DataFrame:
    """The activity windows over range chunks, for keys of any size."""
    df, value = _with_finite(df, value), "_finite"
    stats = cut(df.groupBy(key).agg(
        F.avg(value).alias("key_mean"), F.stddev_samp(value).alias("key_std"), F.count("*").alias("_n")
    ))
    keys, rows = stats.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    heavy = _celled(df, key, ts, tie, value, hours, hot_rows, rows)
    heavy = running(
        heavy, [F.col(ts), F.col(tie)], {}, group=[key], previous_max={"previous_ts": F.col(ts)}, rows=rows
    )
    if keys <= MAX_BROADCAST_KEYS:
        return heavy.join(F.broadcast(stats), key, "left").drop("_n", "_finite")
    return spread_join(heavy, stats, [key], "_n", tie, hot_rows).drop("_n", "_finite")


def _celled(
    df: DataFrame, key: str, ts: str, tie: str, value: str, hours: Sequence[int], hot_rows: int, rows: int
) -> DataFrame:
    """Windows from time cells, for keys of any size; ``rows`` is the number of rows.

    The edges of a frame of h hours, t - h and t, lie at the same place of two
    cells. The frame is the rest of the first cell after t - h, the whole
    cells between, and the last cell up to the row. Rests and beginnings are
    running sums within a cell, read at one probe per window and at the row,
    and a cell spreads over as many range chunks as it needs. Whole cells are
    summed over the stored cell totals, a fixed number of them per window.
    """
    cell = gcd(*[int(h) for h in hours]) * HOUR_MICROS // 4
    start = lambda at: at - F.pmod(at, F.lit(cell))
    marks = F.array(
        F.struct(F.lit(0).alias("h"), F.col(ts).alias("at")),
        *[F.struct(F.lit(int(h)).alias("h"), (F.col(ts) - int(h) * HOUR_MICROS).alias("at")) for h in hours],
    )
    is_row = F.col("_h") == 0
    # Dealt out before they multiply: what a task holds while it writes a shuffle of many parts is then small as well.
    n = tasks_for(df.sparkSession, rows * (1 + len(hours)))
    dealt = df.repartition(n, tie)
    points = dealt.select(key, tie, value, F.explode(marks).alias("m")).select(
        key, tie, F.col("m.h").alias("_h"), F.col("m.at").alias("_at"), start(F.col("m.at")).alias("_cell"),
        F.when(F.col("m.h") == 0, F.col(value)).alias("_x"),
    )
    # A probe comes after the rows of its own time: the frame is open there.
    order = [F.col("_at"), is_row.cast("int").desc(), F.col(tie), F.col("_h")]
    one, amount = is_row.cast("bigint"), F.coalesce(F.col("_x"), F.lit(0.0))
    sides = running(
        points, order, {"_n": one, "_s": amount}, group=[key, "_cell"], after={"_rn": one, "_rs": amount},
        rows=rows * (1 + len(hours)),
    )
    at = lambda c, h: F.max(F.when(F.col("_h") == h, F.col(c)))
    # Rows of one tie are rarely in one task yet, so they are not summed before they are dealt out.
    edges = sides.repartition(n, tie).groupBy(tie).agg(
        at("_n", 0).alias("_n0"), at("_s", 0).alias("_s0"),
        *[at(c, int(h)).alias(f"{c}{h}") for h in hours for c in ("_rn", "_rs")],
    )

    totals = df.groupBy(key, start(F.col(ts)).alias("_cell")).agg(
        F.count("*").alias("_cell_n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("_cell_s")
    )
    by_cell = Window.partitionBy(key).orderBy("_cell")
    between = [
        F.coalesce(F.sum(c).over(by_cell.rangeBetween(cell - int(h) * HOUR_MICROS, -cell)), F.lit(0)).alias(f"{c}{h}")
        for h in hours
        for c in ("_cell_n", "_cell_s")
    ]
    totals = totals.select(key, "_cell", "_cell_n", *between)

    whole = dealt.withColumn("_cell", start(F.col(ts))).join(edges, tie)
    whole = spread_join(whole, totals, [key, "_cell"], "_cell_n", tie, hot_rows)
    cols = []
    for h in hours:
        n = F.col(f"_rn{h}") + F.col(f"_cell_n{h}") + F.col("_n0")
        cols.append(n.cast("double").alias(f"count_{h}h"))
        cols.append((F.col(f"_rs{h}") + F.col(f"_cell_s{h}") + F.col("_s0")).alias(f"sum_{h}h"))
    return whole.select(*df.columns, *cols)


def with_previous_time(df: DataFrame, key: str, ts: str, tie: str, name: str, hot_rows: int) -> DataFrame:
    """Add the time of the key's previous row, null for its first."""
    ordinary, hot, rows = split_counted(df, key, hot_rows)
    before = Window.partitionBy(key).orderBy(F.col(ts).asc_nulls_last(), tie)
    out = ordinary.withColumn(name, F.lag(ts).over(before))
    if hot is not None:
        order = [F.col(ts).asc_nulls_last(), F.col(tie)]
        out = out.unionByName(running(hot, order, {}, group=[key], previous_max={name: F.col(ts)}, rows=rows))
    return out


def window_counts(
    df: DataFrame, key: str, ts: str, tie: str, counted: dict[str, tuple[Column, int, int]], dense_rows: int
) -> DataFrame:
    """Add, per name, the sum of a 0/1 column over the key's rows in [t + low, t + high].

    ``counted`` maps a name to (column, low, high), in microseconds. All frames
    of a key share one shuffle.
    """
    flagged = df.select("*", *[c.cast("bigint").alias(f"_c_{n}") for n, (c, _, _) in counted.items()])
    ordinary, dense, rows = split_counted(flagged, key, dense_rows)
    by_time = Window.partitionBy(key).orderBy(ts)
    out = ordinary.select(
        *df.columns,
        *[
            F.coalesce(F.sum(f"_c_{n}").over(by_time.rangeBetween(low, high)), F.lit(0)).alias(n)
            for n, (_, low, high) in counted.items()
        ],
    )
    if dense is None:
        return out
    # A frame is the running total just before t + high + 1 less the one just
    # before t + low. Marks come before the rows of their own time.
    shifts = sorted({x for _, low, high in counted.values() for x in (low, high + 1)})
    number = {x: i + 1 for i, x in enumerate(shifts)}
    marks = F.array(
        F.struct(F.lit(0).alias("k"), F.col(ts).alias("at")),
        *[F.struct(F.lit(k).alias("k"), (F.col(ts) + x).alias("at")) for x, k in number.items()],
    )
    points = dense.select(key, tie, *[f"_c_{n}" for n in counted], F.explode(marks).alias("m"))
    is_row = F.col("m.k") == 0
    sums = {n: F.when(is_row, F.col(f"_c_{n}")).otherwise(0) for n in counted}
    order = [F.col("m.at"), is_row.cast("int"), F.col(tie), F.col("m.k")]
    totals = running(points, order, sums, group=[key], rows=rows * (1 + len(shifts)))
    at = lambda c, x: F.max(F.when(F.col("m.k") == number[x], F.col(c)))
    windows = totals.groupBy(tie).agg(
        *[(at(n, high + 1) - at(n, low)).alias(n) for n, (_, low, high) in counted.items()]
    )
    return out.unionByName(dense.select(*df.columns).join(windows, tie))
