"""The last transactions of every account as a fixed-length sequence."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from riskweave.functions import dims
from riskweave.functions.scalars import account_column, amount_of, event_micros, number_or
from riskweave.operators.rolling import with_previous_time

#: Bits of the largest amount as a whole number, and of the lower part of whole numbers that are squared.
_BITS, _LOW = 52, 31


def behaviour_rows(tx: DataFrame) -> DataFrame:
    """Account, time, amount, category ids and label per transaction."""
    account = account_column(tx, "sender")

    def ids(name, names):
        return dims.category_id(F.col(name).cast("string"), names) if name in tx.columns else F.lit(0)

    return tx.select(
        F.col("transaction_id").cast("string").alias("transaction_id"),
        F.coalesce(F.col(account).cast("string"), F.lit("__missing__")).alias("account"),
        event_micros(tx).alias("ts"),
        amount_of(tx).alias("amount"),
        ids("transaction_type", dims.TRANSACTION_TYPES).alias("type_id"),
        ids("channel", dims.CHANNELS).alias("channel_id"),
        number_or(tx, "is_fraud", 0.0).alias("is_fraud"),
    )


def time_deltas(rows: DataFrame, hot_rows: int) -> DataFrame:
    """Add ``time_delta``: seconds since the account's previous row, first 0."""
    out = with_previous_time(rows, "account", "ts", "transaction_id", "_prev", hot_rows)
    delta = F.coalesce((F.col("ts") - F.col("_prev")) / 1e6, F.lit(0.0))
    return out.withColumn("time_delta", delta).drop("_prev")


def _whole_sums(col: Column, name: str) -> list[Column]:
    """Count, sum and the parts of the sum of squares of whole numbers, none of them rounded."""
    high = F.shiftright(col, _LOW)
    low = col - F.shiftleft(high, _LOW)
    parts = {"sum": col, "high": high * high, "mixed": high * low, "low": low * low}
    return [F.count(col).alias(f"{name}_n"), *[F.sum(c.cast("decimal(28,0)")).alias(f"{name}_{k}") for k, c in parts.items()]]


def _moments(sums: Row, name: str, unit: Fraction) -> tuple[float, float]:
    """Mean and deviation of whole numbers of ``unit``; 0 and 1 where there is none."""
    n, total, high, mixed, low = (int(sums[f"{name}_{k}"] or 0) for k in ("n", "sum", "high", "mixed", "low"))
    if not n:
        return 0.0, 1.0
    squares = (high << 2 * _LOW) + (mixed << _LOW + 1) + low
    variance = Fraction(n * squares - total**2, n * (n - 1)) if n > 1 else 0
    return float(Fraction(total, n) * unit), math.sqrt(variance) * float(unit) or 1.0


def normalisation(rows: DataFrame, hot_rows: int) -> DataFrame:
    """One row: mean and deviation of amounts and of time deltas.

    The first row of an account has no delta here. A missing or zero
    deviation becomes 1. Sums are of whole numbers (microseconds, and amounts in
    2**-52 of a power of two above the largest), so the same rows give the same
    digits in whatever order tasks are added up. Infinite amounts make the mean
    infinite and the deviation NaN.
    """
    finite = F.abs("amount") < float("inf")
    top, endless = rows.agg(F.max(F.when(finite, F.abs("amount"))), F.sum(F.when(~finite, F.col("amount")))).first()
    shift = min(_BITS - math.frexp(top or 1.0)[1], 1023)
    whole = F.when(finite, F.rint(F.col("amount") * 2.0**shift).cast("bigint"))
    out = with_previous_time(rows, "account", "ts", "transaction_id", "_prev", hot_rows)
    sums = out.agg(*_whole_sums(whole, "amount"), *_whole_sums(F.col("ts") - F.col("_prev"), "time")).first()
    amount = _moments(sums, "amount", Fraction(2) ** -shift) if endless is None else (endless, math.nan)
    time = _moments(sums, "time", Fraction(1, 10**6))
    names = ("amount_mean", "amount_std", "time_mean", "time_std")
    return rows.sparkSession.createDataFrame([(*amount, *time)], ", ".join(f"{c} double" for c in names))


def sequences(rows: DataFrame, stats: dict[str, float], length: int = 16) -> DataFrame:
    """(account, steps, label, ids): the last ``length`` rows in time order.

    Steps are left-padded with zeros. One more row than needed is kept per
    account, to know the delta of the first step; the rank limit is applied
    before the shuffle too, so an account with very many rows sends only a
    few from each task.
    """
    newest = Window.partitionBy("account").orderBy(F.col("ts").desc_nulls_first(), F.col("transaction_id").desc())
    recent = rows.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= length + 1)
    packed = recent.groupBy("account").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    (-F.col("_r")).alias("at"), "ts", "transaction_id", "amount", "type_id", "channel_id", "is_fraud"
                )
            )
        ).alias("all")
    )
    every = F.col("all")

    def step(x, i):
        previous = F.get(every, F.greatest(i - 1, F.lit(0)))["ts"]
        delta = F.when(i > 0, F.coalesce((x["ts"] - previous) / 1e6, F.lit(0.0))).otherwise(0.0)
        return F.struct(
            x["type_id"].cast("int").alias("type_id"),
            x["channel_id"].cast("int").alias("channel_id"),
            ((x["amount"] - stats["amount_mean"]) / max(stats["amount_std"], 1e-9)).alias("amount_norm"),
            ((delta - stats["time_mean"]) / max(stats["time_std"], 1e-9)).alias("time_norm"),
            x["transaction_id"].alias("id"),
            x["is_fraud"].alias("is_fraud"),
        )

    tail = packed.select("account", F.transform(every, step).alias("s")).select(
        "account", F.slice("s", F.greatest(F.lit(1), F.size("s") - length + 1), F.lit(length)).alias("s")
    )
    zero = F.struct(
        F.lit(0).alias("type_id"), F.lit(0).alias("channel_id"), F.lit(0.0).alias("amount_norm"),
        F.lit(0.0).alias("time_norm"),
    )
    bare = F.transform(
        "s",
        lambda x: F.struct(
            x["type_id"].alias("type_id"), x["channel_id"].alias("channel_id"),
            x["amount_norm"].alias("amount_norm"), x["time_norm"].alias("time_norm"),
        ),
    )
    return tail.select(
        "account",
        F.concat(F.array_repeat(zero, F.lit(length) - F.size("s")), bare).alias("steps"),
        F.array_max(F.transform("s", lambda x: x["is_fraud"])).alias("label"),
        F.transform("s", lambda x: x["id"]).alias("ids"),
    )
