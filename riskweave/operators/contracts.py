"""Contract checks: each rule is a predicate, checked for all rows in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions import dims
from riskweave.functions.scalars import stripped


def trim_text(df: DataFrame) -> DataFrame:
    """Trim every string column."""
    return df.select(
        *[stripped(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema]
    )


def _number(name: str) -> Column:
    """Value of a number column; null where a text column holds something else (a ``type:`` violation)."""
    return F.col(name).try_cast("double")


def _wrong_type(name: str, kind: str) -> Column:
    if kind == "time":
        return F.col(name).isNotNull() & ~F.col(name).cast("string").rlike(r"^([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?$")
    return F.col(name).isNotNull() & F.col(name).try_cast(kind).isNull()


def _not_in(name: str, allowed) -> Column:
    return F.col(name).isNotNull() & ~F.col(name).isin(*allowed)


def _bad_flag(name: str) -> Column:
    return F.coalesce(~_number(name).between(0, 1), F.lit(False))


def _not_positive(name: str) -> Column:
    return F.coalesce(~(_number(name) > 0), F.lit(False))


def _negative(name: str) -> Column:
    return F.coalesce(~(_number(name) >= 0), F.lit(False))


# Columns whose text must read as the given type, per table.
TYPES = {
    "transactions": {
        "transaction_date": "date", "transaction_time": "time", "amount_npr": "double", "exchange_rate": "double",
        "is_cross_border": "int", "ip_is_vpn": "int", "is_fraud": "int", "aml_risk_indicator": "int",
    },
    "accounts": {
        "account_open_date": "date", "account_age_days": "int", "kyc_verified": "int", "is_pep": "int", "is_sanctioned": "int",
        "average_monthly_volume": "double", "average_monthly_count": "double", "is_mule": "int",
    },
    "alert_scores": {"risk_score": "double", "alert_flag": "int"},
}

# Columns that must be present and not null, per table.
REQUIRED = {
    "transactions": (
        "transaction_id", "transaction_date", "transaction_time", "sender_account_id", "receiver_account_id",
        "transaction_type", "amount_npr", "original_currency", "exchange_rate", "channel", "is_cross_border",
        "device_type", "ip_address", "ip_is_vpn", "is_fraud", "aml_risk_indicator",
    ),
    "accounts": (
        "account_id", "account_type", "account_open_date", "account_age_days", "kyc_verified", "kyc_risk_grade",
        "is_pep", "is_sanctioned", "average_monthly_volume", "average_monthly_count", "country", "is_mule",
    ),
    "alert_scores": (
        "transaction_id", "agent_name", "risk_score", "alert_flag", "reason_code", "explanation", "timestamp",
    ),
}


def rules(table: str) -> dict[str, Column]:
    """Rule name -> violation predicate for one of the three tables."""
    out = {f"required:{c}": F.col(c).isNull() for c in REQUIRED[table]}
    out.update({f"type:{c}": _wrong_type(c, kind) for c, kind in TYPES[table].items()})
    if table == "transactions":
        out["enum:transaction_type"] = _not_in("transaction_type", dims.TRANSACTION_TYPES)
        out["enum:channel"] = _not_in("channel", dims.CHANNELS)
        out["enum:fraud_type"] = _not_in("fraud_type", dims.FRAUD_TYPES)
        out["positive:amount_npr"] = _not_positive("amount_npr")
        out["positive:exchange_rate"] = _not_positive("exchange_rate")
        for c in ("is_cross_border", "ip_is_vpn", "is_fraud", "aml_risk_indicator"):
            out[f"flag:{c}"] = _bad_flag(c)
        out["corridor:required"] = (_number("is_cross_border") == 1) & F.col("remittance_corridor").isNull()
    elif table == "accounts":
        out["enum:account_type"] = _not_in("account_type", dims.ACCOUNT_TYPES)
        out["enum:kyc_risk_grade"] = _not_in("kyc_risk_grade", dims.RISK_GRADES)
        for c in ("kyc_verified", "is_pep", "is_sanctioned", "is_mule"):
            out[f"flag:{c}"] = _bad_flag(c)
        for c in ("account_age_days", "average_monthly_volume", "average_monthly_count"):
            out[f"nonnegative:{c}"] = _negative(c)
    else:
        score = _number("risk_score")
        out["range:risk_score"] = score.isNotNull() & (F.isnan(score) | ~score.between(0.0, 1.0))
        out["flag:alert_flag"] = _bad_flag("alert_flag")
    return out


def _checkable(df: DataFrame, table: str, trim: bool = True) -> DataFrame:
    """Trimmed table in which every column the rules read exists.

    A required column the table lacks counts as null in every row.
    """
    df = trim_text(df) if trim else df
    needed = set(REQUIRED[table]) | ({"fraud_type", "remittance_corridor"} if table == "transactions" else set())
    missing = sorted(needed - set(df.columns))
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in missing]) if missing else df


def _broken_names(table: str) -> Column:
    return F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in rules(table).items()]))


def with_violations(df: DataFrame, table: str, trim: bool = True) -> DataFrame:
    """Add ``violations``: the names of the rules a row breaks."""
    return _checkable(df, table, trim).select("*", _broken_names(table).alias("violations"))


def split_valid(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their violations).

    Rows are told apart by the rules themselves; names are listed only for
    the broken ones.
    """
    rows = _checkable(df, table)
    broken = reduce(lambda a, b: a | b, [F.coalesce(p, F.lit(False)) for p in rules(table).values()])
    return rows.filter(~broken), rows.filter(broken).select("*", _broken_names(table).alias("violations"))


def rule_report(df: DataFrame, table: str, prefix: str = "") -> DataFrame:
    """Violating row count of every rule whose name starts with ``prefix``; one pass."""
    picked = {n: p for n, p in rules(table).items() if n.startswith(prefix)}
    counts = _checkable(df, table).agg(*[F.count_if(p).alias(f"r{i}") for i, p in enumerate(picked.values())])
    items = [F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("violations")) for i, n in enumerate(picked)]
    return counts.select(F.inline(F.array(*items)))


def cast_report(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Per column of a text table: nulls, and values that do not cast to ``schema``."""
    fields = [f for f in schema if f.name in df.columns]

    def value(f: T.StructField) -> Column:
        return stripped(F.col(f.name))

    aggs = []
    for i, f in enumerate(fields):
        aggs.append(F.count(F.when(F.col(f.name).isNull(), 1)).alias(f"n{i}"))
        bad = F.col(f.name).isNotNull() & value(f).try_cast(f.dataType).isNull()
        aggs.append(F.count(F.when(bad, 1)).alias(f"b{i}"))
    items = [
        F.struct(F.lit(f.name).alias("column_name"), F.col(f"n{i}").alias("nulls"), F.col(f"b{i}").alias("uncastable"))
        for i, f in enumerate(fields)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*items)))


def cast_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast a text table to ``schema``; what does not cast becomes null."""
    return df.select(
        *[stripped(F.col(f.name).cast("string")).try_cast(f.dataType).alias(f.name) for f in schema if f.name in df.columns]
    )


def corridor_checks(tx: DataFrame) -> DataFrame:
    """Rows whose currency or exchange rate does not fit their corridor.

    Both lookup tables are fixed and tiny, so they are broadcast.
    """
    spark = tx.sparkSession
    joined = tx.join(
        F.broadcast(dims.corridor_dim(spark).withColumnRenamed("currency", "_expected")),
        F.col("remittance_corridor") == F.col("corridor"),
        "left",
    ).join(F.broadcast(dims.rate_dim(spark)), F.col("original_currency") == F.col("currency"), "left")
    wrong = F.col("_expected").isNotNull() & (F.col("_expected") != F.col("original_currency"))
    outside = F.col("min_rate").isNotNull() & ~F.col("exchange_rate").between(F.col("min_rate"), F.col("max_rate"))
    unknown = (F.col("is_cross_border") == 1) & F.col("corridor").isNull()
    return joined.select(
        "transaction_id",
        F.coalesce(unknown, F.lit(False)).cast("int").alias("unknown_corridor"),
        F.coalesce(wrong, F.lit(False)).cast("int").alias("wrong_currency"),
        F.coalesce(outside, F.lit(False)).cast("int").alias("rate_outside_range"),
    )


def lookup_invariants(tx: DataFrame) -> DataFrame:
    """Consistency of the lookup tables, and how many rows of ``tx`` use each.

    Row use shows which broken lookup entry would matter for the data.
    """
    spark = tx.sparkSession
    corridors, rates, mix = dims.corridor_dim(spark), dims.rate_dim(spark), dims.channel_dim(spark)
    used_corridor = tx.groupBy(F.col("remittance_corridor").alias("corridor")).agg(F.count("*").alias("used"))
    used_currency = tx.groupBy(F.col("original_currency").alias("currency")).agg(F.count("*").alias("used"))
    used_channel = tx.groupBy("channel").agg(F.count("*").alias("used"))
    parts = [
        corridors.filter(~F.col("tier").isin(*dims.RISK_GRADES) | F.col("tier_score").isNull()).select(
            F.lit("corridor_without_valid_tier").alias("rule"), F.lit(1).alias("n")
        ),
        corridors.filter(F.col("currency").isNull()).select(
            F.lit("corridor_without_currency").alias("rule"), F.lit(1).alias("n")
        ),
        rates.filter(F.col("min_rate") >= F.col("max_rate")).select(
            F.lit("rate_range_not_ascending").alias("rule"), F.lit(1).alias("n")
        ),
    ]
    broken = parts[0]
    for p in parts[1:]:
        broken = broken.unionByName(p)
    counted = broken.groupBy("rule").agg(F.sum("n").alias("n"))
    mix_sum = mix.agg(F.round(F.sum("mix"), 9).alias("v")).select(
        F.lit("channel_mix_not_one").alias("rule"), (F.col("v") != 1.0).cast("bigint").alias("n")
    )
    # Values used by the data that the lookups do not know.
    def unknown(used: DataFrame, dim: DataFrame, key: str, rule: str) -> DataFrame:
        missing = used.filter(F.col(key).isNotNull()).join(F.broadcast(dim.select(key)), key, "left_anti")
        return missing.agg(F.coalesce(F.sum("used"), F.lit(0)).alias("n")).select(F.lit(rule).alias("rule"), "n")

    names = spark.createDataFrame(
        [(r,) for r in ("corridor_without_valid_tier", "corridor_without_currency", "rate_range_not_ascending")],
        "rule string",
    )
    base = names.join(counted, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    return (
        base.unionByName(mix_sum)
        .unionByName(unknown(used_corridor, corridors, "corridor", "rows_with_unknown_corridor"))
        .unionByName(unknown(used_currency, rates, "currency", "rows_with_unknown_currency"))
        .unionByName(unknown(used_channel, mix, "channel", "rows_with_unknown_channel"))
    )
