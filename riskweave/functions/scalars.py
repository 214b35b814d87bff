"""Column expressions shared by the scorers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_present(df: DataFrame, names: Sequence[str]) -> str | None:
    """First of ``names`` that is a column of ``df``; decided while planning."""
    return next((n for n in names if n in df.columns), None)


def account_column(df: DataFrame, side: str) -> str | None:
    return first_present(df, (f"{side}_account_id", f"{side}_account"))


def amount_column(df: DataFrame) -> str | None:
    return first_present(df, ("amount_npr", "amount"))


def number(col: Column | str, default: float | None = None) -> Column:
    """Numeric coercion: text that is no number and NaN become ``default``."""
    value = (F.col(col) if isinstance(col, str) else col).try_cast("double")
    value = F.when(~F.isnan(value), value)
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def number_or(df: DataFrame, name: str | None, default: float) -> Column:
    """Coerced column, or the default when the table lacks it."""
    return number(name, default) if name in df.columns else F.lit(float(default))


def amount_of(df: DataFrame) -> Column:
    return number_or(df, amount_column(df), 0.0)


def text_or(df: DataFrame, name: str | None, default: str) -> Column:
    if name is None or name not in df.columns:
        return F.lit(default)
    return F.coalesce(F.col(name).cast("string"), F.lit(default))


def clip01(col: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col))


def ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(num, den), F.lit(default))


def event_micros(df: DataFrame) -> Column:
    """Event time in microseconds, null when it cannot be parsed."""
    if "timestamp" in df.columns or "txn_ts" in df.columns:
        name = "timestamp" if "timestamp" in df.columns else "txn_ts"
        if isinstance(df.schema[name].dataType, T.StringType):
            return F.unix_micros(F.try_to_timestamp(F.col(name)))
        return F.unix_micros(F.col(name).cast("timestamp"))
    if {"transaction_date", "transaction_time"} <= set(df.columns):
        text = F.concat_ws(" ", F.col("transaction_date").cast("string"), F.col("transaction_time").cast("string"))
        return F.unix_micros(F.try_to_timestamp(text))
    return F.lit(None).cast("bigint")


def words(code: Column) -> Column:
    """REASON_CODE -> reason code."""
    return F.lower(F.replace(code, F.lit("_"), F.lit(" ")))


#: White space of ASCII and the common wide spaces.
WHITE_SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000"


def stripped(text: Column) -> Column:
    """Text without white space at either end; trim() alone takes blanks only."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def first_text(df: DataFrame, names: Sequence[str], default: str) -> Column:
    """First non-blank of several columns."""
    found = [F.when(stripped(F.col(n).cast("string")) != "", F.col(n).cast("string")) for n in names if n in df.columns]
    return F.coalesce(*found, F.lit(default))


def first_distinct(items: Column, n: int) -> Column:
    """First ``n`` different elements in the order they appear."""
    return F.slice(F.array_distinct(items), 1, n)
