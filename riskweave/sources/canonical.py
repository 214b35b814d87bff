"""Raw files to canonical transactions and accounts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions import dims
from riskweave.operators.ranking import global_rank

# Fixed value: date at which account ages are taken.
REFERENCE_DATE = dt.date(2022, 12, 31)


def row_numbers(raw: DataFrame, order: list[str]) -> DataFrame:
    """0-based position as text id; ``order`` fixes the file order."""
    ranked = global_rank(raw, [F.col(c) for c in order], "_pos")
    return ranked.withColumn("transaction_id", (F.col("_pos") - 1).cast("string")).drop("_pos")


def transactions(raw: DataFrame) -> DataFrame:
    """Canonical columns from the raw layout; needs ``transaction_id`` (see row_numbers)."""
    cross = F.coalesce(F.col("cross_border_flag").cast("int"), F.lit(0))
    return raw.select(
        "transaction_id",
        F.col("Sender_account").cast("string").alias("sender_account_id"),
        F.col("Receiver_account").cast("string").alias("receiver_account_id"),
        F.col("amount_local_npr").cast("double").alias("amount_npr"),
        F.col("Payment_currency").cast("string").alias("original_currency"),
        cross.alias("is_cross_border"),
        F.try_to_timestamp(F.concat_ws(" ", F.col("Date").cast("string"), F.col("Time").cast("string"))).alias(
            "timestamp"
        ),
        dims.lookup(F.col("Payment_type"), dims.PAYMENT_TYPE, "payment").alias("transaction_type"),
        dims.lookup(F.col("transmode_code"), dims.MODE_CHANNEL, "branch").alias("channel"),
        F.when(cross == 1, F.concat(F.col("Sender_bank_location").cast("string"), F.lit("->Nepal"))).alias(
            "remittance_corridor"
        ),
        *[c for c in ("is_fraud",) if c in raw.columns],
    )


def accounts(raw: DataFrame) -> DataFrame:
    """Account features for the compliance rules."""
    return raw.select(
        F.col("account_id").cast("string").alias("account_id"),
        F.coalesce(F.datediff(F.lit(REFERENCE_DATE), F.col("opened").cast("date")), F.lit(0)).alias("account_age_days"),
        F.lit(1).alias("kyc_verified"),
        F.coalesce(F.lower("risk_grade"), F.lit("low")).alias("kyc_risk_grade"),
        F.coalesce(F.col("pep_flag").cast("int"), F.lit(0)).alias("is_pep"),
        F.coalesce(F.col("sanctions_hit").cast("int"), F.lit(0)).alias("is_sanctioned"),
        F.lit(0).alias("is_mule"),
    )
