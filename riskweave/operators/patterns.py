"""Time-ordered payment chains through a middle transaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.rolling import HOUR_MICROS, window_counts


def payment_chains(e: DataFrame, hours: int, dense_rows: int) -> DataFrame:
    """Number of chains A -> B -> C -> D for every middle transaction B -> C.

    The first hop comes at most ``hours`` before the middle one, the last at
    most ``hours`` after it; A differs from C and B from D (a direct return is
    no onward move). Chains are counted, not listed: arrivals at B times
    departures from C. That needs only rolling counts per account and per
    ordered pair, so a hub with a large share of all payments costs no more
    than its own rows.
    """
    span = hours * HOUR_MICROS
    base = e.filter(F.col("ts").isNotNull() & (F.col("src") != F.col("dst")))
    ends = F.array(
        # The transaction as an arrival at, and as a departure from, an account.
        F.struct(F.lit("in").alias("side"), F.col("dst").alias("acct"), F.col("src").alias("other")),
        F.struct(F.lit("out").alias("side"), F.col("src").alias("acct"), F.col("dst").alias("other")),
    )
    stream = base.select("transaction_id", "ts", F.inline(ends)).select(
        "*",
        F.concat_ws(":", "transaction_id", "side").alias("tie"),
        F.struct("acct", "other").alias("pair"),
    )
    arrival, departure = F.col("side") == "in", F.col("side") == "out"
    before, after = (-span, -1), (1, span)
    counts = window_counts(
        stream, "acct", "ts", "tie", {"n_in": (arrival, *before), "n_out": (departure, *after)}, dense_rows
    )
    counts = window_counts(
        counts, "pair", "ts", "tie", {"same_in": (arrival, *before), "same_out": (departure, *after)}, dense_rows
    )
    one = lambda side, c: F.max(F.when(F.col("side") == side, c))
    chained = counts.groupBy("transaction_id").agg(
        one("out", F.col("acct")).alias("src"),
        one("out", F.col("other")).alias("dst"),
        one("out", F.col("n_in") - F.col("same_in")).alias("upstream"),
        one("in", F.col("n_out") - F.col("same_out")).alias("downstream"),
    )
    return chained.select("*", (F.col("upstream") * F.col("downstream")).alias("chains"))
