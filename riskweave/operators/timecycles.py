"""Payments that come back: A to B to C to A in time order within a window, counted and never listed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.graph import closed_triples, nodes
from riskweave.operators.rolling import HOUR_MICROS
from riskweave.runtime import cut, materialise

# Bits of a payment's place in a cycle: first, middle, last.
FIRST, MIDDLE, LAST = 1, 2, 4


def _turning(e: DataFrame) -> DataFrame:
    """Payments between accounts that both pay and are paid at some time; no other is on a cycle.

    Where few accounts do both, little is left to spread over cells. Accounts are stored first: their
    size tells Spark whether to send them to the payments.
    """
    timed = e.filter(F.col("ts").isNotNull() & (F.col("src") != F.col("dst"))).select("src", "dst", "ts")
    sides = F.array(
        F.struct(F.col("src").alias("node"), F.lit(1).alias("side")), F.struct(F.col("dst").alias("node"), F.lit(2).alias("side"))
    )
    ends = timed.select(F.inline(sides)).groupBy("node").agg(F.bit_or("side").alias("sides"))
    both = materialise(ends.filter("sides = 3").select("node"), "turning-accounts")
    for end in ("src", "dst"):
        timed = timed.join(both.withColumnRenamed("node", end), end, "left_semi")
    return timed.select("src", "dst", "ts")


def _cells(e: DataFrame, span: int) -> DataFrame:
    """Payments in the time cells in which they can take part, with the places they can take there.

    A cell is a stretch of ``span`` and counts the cycles whose middle payment lies in it. The
    first payment then lies in it or in the one before, the last in it or in the next.
    """
    bucket = F.floor(F.col("ts") / F.lit(span)).cast("bigint")
    places = F.array(
        F.struct((bucket - 1).alias("cell"), F.lit(LAST).alias("place")),
        F.struct(bucket.alias("cell"), F.lit(FIRST | MIDDLE | LAST).alias("place")),
        F.struct((bucket + 1).alias("cell"), F.lit(FIRST).alias("place")),
    )
    return e.select("src", "dst", "ts", F.inline(places))


def _routes(cells: DataFrame) -> DataFrame:
    """(cell, x, y, z): x pays y, y pays z and z pays x in a cell, each in a place it can take there."""
    low_first = F.col("src") < F.col("dst")
    marks = lambda towards: F.coalesce(F.bit_or(F.when(towards, F.col("place"))), F.lit(0))
    links = cells.groupBy("cell", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(
        marks(low_first).alias("fwd"), marks(~low_first).alias("back")
    )
    closed = closed_triples(cut(links), ["cell"])
    way = {(p, q): f"{p}{q}" for p in "abc" for q in "abc" if p != q}
    turns = []
    for x, y, z in ("abc", "bca", "cab", "acb", "cba", "bac"):
        fits = (
            (F.col(way[x, y]).bitwiseAND(FIRST) > 0)
            & (F.col(way[y, z]).bitwiseAND(MIDDLE) > 0)
            & (F.col(way[z, x]).bitwiseAND(LAST) > 0)
        )
        turns.append(F.when(fits, F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(z).alias("z"))))
    return closed.select("cell", F.inline(F.array_compact(F.array(*turns))))


def cycle_counts(e: DataFrame, hours: int) -> DataFrame:
    """(cell, x, y, z, cycles): triples of payments x to y, y to z, z to x, each later than the one before, the last
    at most ``hours`` after the first, by the time cell of the middle one.

    Routes come from wedges at the low-degree end within a time cell. Their payments are
    joined by (cell, place, pair) and counted by running sums over time: with N(t) the last
    payments up to t, a middle one at t2 has, over the first ones at t1 in [t2 - span, t2), the sum of
    N(t1 + span) - N(t2) cycles. So a busy pair costs its payments for each route it is on, not their products.
    """
    span = hours * HOUR_MICROS
    cells = materialise(_cells(_turning(e), span), "cycle-cells")
    routes = _routes(cells)
    legs = F.array(
        F.struct(F.lit(FIRST).alias("leg"), F.col("x").alias("src"), F.col("y").alias("dst")),
        F.struct(F.lit(MIDDLE).alias("leg"), F.col("y").alias("src"), F.col("z").alias("dst")),
        F.struct(F.lit(LAST).alias("leg"), F.col("z").alias("src"), F.col("x").alias("dst")),
    )
    wanted = routes.select("cell", "x", "y", "z", F.inline(legs))
    takes = F.filter(F.array(*[F.lit(p) for p in (FIRST, MIDDLE, LAST)]), lambda p: F.col("place").bitwiseAND(p) > 0)
    payments = cells.select("cell", "src", "dst", "ts", F.explode(takes).alias("leg"))
    key = ["cell", "x", "y", "z"]
    told = wanted.join(payments, ["cell", "leg", "src", "dst"]).select(*key, "leg", "ts")

    # Last payments up to a middle one, and up to the end of the window of a first one (which comes after all at its time).
    first, last = F.col("leg") == FIRST, F.col("leg") == LAST
    at = F.col("ts") + F.when(first, F.lit(span)).otherwise(F.lit(0))
    by_end = Window.partitionBy(*key).orderBy("at", F.when(last, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    closing = told.withColumn("at", at).withColumn("n_last", F.sum(last.cast("bigint")).over(by_end)).filter(~last)
    # A first payment counts from its time on; a middle one asks for all before it, less all before its window.
    asks = F.when(first, F.array(F.struct(F.col("ts").alias("when"), F.lit(0).alias("sign")))).otherwise(
        F.array(
            F.struct(F.col("ts").alias("when"), F.lit(1).alias("sign")),
            F.struct((F.col("ts") - span).alias("when"), F.lit(-1).alias("sign")),
        )
    )
    steps = closing.select(*key, "n_last", F.inline(asks))
    is_first = F.col("sign") == 0
    by_time = Window.partitionBy(*key).orderBy("when", F.when(is_first, 1).otherwise(0)).rowsBetween(Window.unboundedPreceding, 0)
    summed = steps.select(
        *key, "sign", "n_last",
        F.sum(F.when(is_first, F.col("n_last")).otherwise(0)).over(by_time).alias("ends"),
        F.sum(is_first.cast("bigint")).over(by_time).alias("starts"),
    )
    found = summed.groupBy(*key).agg(F.sum(F.col("sign") * (F.col("ends") - F.col("starts") * F.col("n_last"))).alias("cycles"))
    return found.filter("cycles > 0")


def time_cycles(e: DataFrame, hours: int) -> DataFrame:
    """(node, started, passed) of every account: cycles it starts and ends, and cycles that pass through it on the way."""
    counted = cycle_counts(e, hours).select(
        F.inline(
            F.array(
                F.struct(F.col("x").alias("node"), F.col("cycles").alias("started"), F.lit(0).alias("passed")),
                F.struct(F.col("y").alias("node"), F.lit(0).alias("started"), F.col("cycles").alias("passed")),
                F.struct(F.col("z").alias("node"), F.lit(0).alias("started"), F.col("cycles").alias("passed")),
            )
        )
    )
    totals = counted.groupBy("node").agg(F.sum("started").alias("started"), F.sum("passed").alias("passed"))
    return nodes(e).join(totals, "node", "left").fillna(0, ["started", "passed"])
