"""Compliance rules on the sender's account and on the transaction."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.scalars import amount_column, number, words
from riskweave.operators.alerts import build_alerts, empty_alerts, has_columns
from riskweave.operators.skew import spread_join
from riskweave.settings import alert_threshold, resolve

AGENT = "kyc_aml"
ACCOUNT_COLUMNS = ("is_pep", "is_sanctioned", "kyc_verified", "account_age_days", "kyc_risk_grade")
# Rule names in reporting order, each with its weight setting.
RULES = {
    "PEP": "weight_pep_flag",
    "SANCTIONS": "weight_sanctions_match",
    "KYC_UNVERIFIED": "weight_kyc_unverified",
    "NEW_ACCOUNT": "weight_new_account",
    "HIGH_RISK_GRADE": "weight_high_risk_grade",
    "STRUCTURING": "weight_structuring_pattern",
    "LAYERING": "weight_layering_pattern",
}


def join_accounts(tx: DataFrame, accounts: DataFrame) -> DataFrame:
    """Sender's account features, with safe defaults for unknown senders.

    Spark broadcasts the account table while it is small and otherwise
    shuffles both sides, splitting senders that are skewed.
    """
    feats = accounts.select(F.col("account_id").alias("sender_account_id"), *ACCOUNT_COLUMNS)
    joined = tx.join(feats, "sender_account_id", "left")
    return joined.fillna(
        {"kyc_verified": 1, "kyc_risk_grade": "low", "is_pep": 0, "is_sanctioned": 0, "account_age_days": 9999}
    )


def corridor_counts(tx: DataFrame, hot_rows: int) -> DataFrame:
    """Add ``corridor_count``: rows of the same sender and corridor.

    All rows count, domestic ones too; rows without a corridor share one key.
    Counts are built by partial aggregation and joined back, so a pair with
    very many rows is never gathered in one task.
    """
    keyed = tx.withColumn("_s", F.coalesce(F.col("sender_account_id").cast("string"), F.lit("None"))).withColumn(
        "_c", F.coalesce(F.col("remittance_corridor").cast("string"), F.lit("None"))
    )
    counts = keyed.groupBy("_s", "_c").agg(F.count("*").alias("corridor_count"))
    return spread_join(keyed, counts, ["_s", "_c"], "corridor_count", "transaction_id", hot_rows).drop("_s", "_c")


def flag_columns(tx: DataFrame, cfg: Mapping) -> dict[str, Column]:
    """0/1 expression per rule; rules whose columns are missing are 0.

    Layering needs ``corridor_count``.
    """
    flags = {name: F.lit(0) for name in RULES}
    if has_columns(tx, ACCOUNT_COLUMNS):
        flags["PEP"] = number("is_pep", 0).cast("int")
        flags["SANCTIONS"] = number("is_sanctioned", 0).cast("int")
        flags["KYC_UNVERIFIED"] = (number("kyc_verified", 1).cast("int") == 0).cast("int")
        flags["NEW_ACCOUNT"] = (number("account_age_days", 9999) < cfg["new_account_threshold_days"]).cast("int")
        grade = F.lower(F.coalesce(F.col("kyc_risk_grade").cast("string"), F.lit("low")))
        flags["HIGH_RISK_GRADE"] = (grade == "high").cast("int")
    if amount_column(tx) == "amount_npr":
        low, high = cfg["structuring_min_npr"], cfg["structuring_max_npr"]
        flags["STRUCTURING"] = number("amount_npr", 0).between(low, high).cast("int")
    if has_columns(tx, ("is_cross_border", "corridor_count")):
        crossing = number("is_cross_border", 0).cast("int") == 1
        flags["LAYERING"] = (crossing & (F.col("corridor_count") >= 2)).cast("int")
    return flags


def rule_flags(tx: DataFrame, settings: Mapping | None = None) -> DataFrame:
    """One 0/1 column ``r_<RULE>`` per rule."""
    cfg = resolve(settings)
    if has_columns(tx, ("is_cross_border", "remittance_corridor", "sender_account_id")):
        tx = corridor_counts(tx, int(cfg["hot_key_rows"]))
    return tx.select("*", *[flag.alias(f"r_{name}") for name, flag in flag_columns(tx, cfg).items()])


def rule_score(cfg: Mapping) -> Column:
    """Weighted flags over the largest possible sum."""
    total = sum((F.col(f"r_{n}") * float(cfg[w]) for n, w in RULES.items()), F.lit(0.0))
    return total / max(sum(float(cfg[w]) for w in RULES.values()), 1e-9)


def broken_rules() -> Column:
    """Names of the broken rules in rule order."""
    return F.array_compact(F.array(*[F.when(F.col(f"r_{n}") == 1, n) for n in RULES]))


def reason() -> Column:
    return F.when(F.size(broken_rules()) == 0, "NO_VIOLATIONS").otherwise(F.array_join(broken_rules(), "|"))


def score(tx: DataFrame, settings: Mapping | None = None, scored_at: dt.datetime | None = None) -> DataFrame:
    """Alert rows with the weighted score and the broken rules named."""
    if not has_columns(tx, ("transaction_id",)):
        return empty_alerts(tx.sparkSession)
    flagged = rule_flags(tx, settings)
    text = F.when(F.size(broken_rules()) == 0, "No KYC/AML violations detected.").otherwise(
        F.concat(F.lit("KYC/AML violations: "), words(F.array_join(broken_rules(), ", ")), F.lit("."))
    )
    threshold = alert_threshold(AGENT, settings)
    return build_alerts(flagged, AGENT, rule_score(resolve(settings)), threshold, reason(), text, scored_at)
