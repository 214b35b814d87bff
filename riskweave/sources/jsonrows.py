"""Rows as JSON text and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_json_rows(df: DataFrame) -> DataFrame:
    """One ``json`` column; null fields are written too."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def from_json_rows(df: DataFrame, schema: T.StructType, column: str = "json") -> DataFrame:
    return df.select(F.from_json(column, schema).alias("r")).select("r.*")
