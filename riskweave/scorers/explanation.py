"""Plain-language explanation of each scored transaction."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.scalars import amount_column, first_distinct, first_text, number, words
from riskweave.operators.alerts import build_alerts, empty_alerts, has_columns
from riskweave.settings import alert_threshold

AGENT = "explanation"
# Codes that are no signal, for the general reason columns and
# for the per-scorer ones. The two lists differ on purpose.
_QUIET_GENERAL = ("META_NORMAL", "NORMAL")
_QUIET_SCORER = ("NO_VIOLATIONS", "NORMAL_VELOCITY", "META_NORMAL")
_DISCLAIMER = "This is a suspicious-activity triage explanation, not a finding of criminal conduct."
_NO_SIGNAL = "no dominant upstream reason was recorded"


def add_meta(tx: DataFrame, meta_alerts: DataFrame) -> DataFrame:
    """Left-join the stacked score, its flag and its reason."""
    meta = meta_alerts.select(
        "transaction_id",
        F.col("risk_score").alias("meta_risk_score"),
        F.col("alert_flag").alias("meta_alert_flag"),
        F.col("reason_code").alias("meta_reason_code"),
    )
    return tx.join(meta, "transaction_id", "left")


def signals(df: DataFrame, exclude: tuple[str, ...] = ()) -> Column:
    """Up to four different signals, general reasons first.

    ``exclude`` names further codes to leave out.
    """
    found = []
    for name in ("meta_reason_code", "reason_code"):
        if name in df.columns:
            found.append(F.when(~F.col(name).isin(*_QUIET_GENERAL, *exclude), words(F.col(name))))
    for name in df.columns:
        if name.endswith("_reason_code"):
            found.append(F.when(~F.col(name).isin(*_QUIET_SCORER, *exclude), words(F.col(name))))
    listed = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    if "attribution_reasons" in df.columns:
        named = F.transform("attribution_reasons", words)
        listed = F.concat(listed, F.coalesce(named, F.array().cast("array<string>")))
    return first_distinct(listed, 4)


def score_column(df: DataFrame) -> Column:
    for name in ("meta_risk_score", "risk_score"):
        if name in df.columns:
            return number(name)
    return F.lit(0.0)


def sentence(df: DataFrame, threshold: float, exclude: tuple[str, ...] = ()) -> Column:
    amount = number(amount_column(df)) if amount_column(df) else F.lit(None).cast("double")
    amount_text = F.coalesce(
        F.concat(F.lit("NPR "), F.format_number(amount, 2)), F.lit("an unknown amount")
    )
    value = score_column(df)
    named = signals(df, exclude)
    return F.concat(
        F.lit("Transaction "), first_text(df, ("transaction_id",), "unknown"),
        F.lit(" ("), first_text(df, ("transaction_type",), "transaction"),
        F.lit(", "), amount_text,
        F.lit(", via "), first_text(df, ("channel",), "unknown channel"),
        F.lit(", "), first_text(df, ("remittance_corridor",), "domestic corridor"),
        F.lit(") is "), F.when(value >= threshold, "flagged for review").otherwise("not flagged"),
        F.lit(" with combined risk score "), F.coalesce(F.format_number(value, 3), F.lit("unknown")),
        F.lit(". Contributing signals: "),
        F.when(F.size(named) > 0, F.array_join(named, ", ")).otherwise(_NO_SIGNAL),
        F.lit(". " + _DISCLAIMER),
    )


def score(
    df: DataFrame,
    settings: Mapping | None = None,
    scored_at: dt.datetime | None = None,
    exclude: tuple[str, ...] = (),
) -> DataFrame:
    """Alert rows whose explanation is the composed sentence."""
    if not has_columns(df, ("transaction_id",)):
        return empty_alerts(df.sparkSession)
    threshold = alert_threshold(AGENT, settings)
    prepared = df.select("*", sentence(df, threshold, exclude).alias("_text"), score_column(df).alias("_score"))
    prepared = prepared.drop(*[c for c in ("risk_score", "reason_code") if c in df.columns])
    value = F.coalesce(F.col("_score"), F.lit(0.0))
    reason = F.when(value >= threshold, "EXPLANATION_ALERT").otherwise("EXPLANATION_NORMAL")
    return build_alerts(prepared, AGENT, value, threshold, reason, F.col("_text"), scored_at)
