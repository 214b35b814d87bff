"""Contract checks on tables with injected violations."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import contracts
from riskweave.plans import sqltext as S
from riskweave.plans.registry import query
from riskweave.plans.views import ac_dirty, tx, tx_dirty, tx_text
from riskweave.scorers import compliance
from riskweave.sources import schemas


def _count(rule: str, condition: str, table: str) -> str:
    return f"SELECT '{rule}' AS rule, count(*) FILTER (WHERE {condition}) AS violations FROM {table}"


def _union(*parts: str) -> str:
    return " UNION ALL ".join(parts)


_TX_TRIM = "tt AS (SELECT * REPLACE (trim(transaction_id) AS transaction_id, trim(transaction_type) AS transaction_type) FROM tx_dirty)"
_TYPES = "('transfer','payment','withdrawal','deposit','cash_out','remittance_inbound','remittance_outbound')"


@query(
    "v1_trim_text",
    "SELECT trim(transaction_type) AS transaction_type, count(*) AS n, CAST(sum(length(trim(transaction_id))) AS BIGINT) AS id_chars FROM tx_dirty GROUP BY 1",
    views=("tx_dirty",),
)
def v1(spark, d):
    return contracts.trim_text(tx_dirty(spark, d)).groupBy("transaction_type").agg(
        F.count("*").alias("n"), F.sum(F.length("transaction_id")).alias("id_chars")
    )


@query(
    "v2_enum_membership",
    _union(
        _count("enum:transaction_type", f"transaction_type NOT IN {_TYPES}", "tt"),
        _count("enum:channel", "channel NOT IN ('mobile_banking','atm','branch','online_banking','pos')", "tt"),
        _count("enum:fraud_type", "fraud_type NOT IN ('transaction_fraud','aml_structuring','aml_layering','aml_mule_network','identity_fraud')", "tt"),
        _count("enum:account_type", "account_type NOT IN ('savings','current','salary','fixed_deposit')", "ac_dirty"),
        _count("enum:kyc_risk_grade", "kyc_risk_grade NOT IN ('low','medium','high')", "ac_dirty"),
    ),
    views=("tx_dirty", "ac_dirty"),
    ctes=(_TX_TRIM,),
)
def v2(spark, d):
    return contracts.rule_report(tx_dirty(spark, d), "transactions", "enum:").unionByName(
        contracts.rule_report(ac_dirty(spark, d), "accounts", "enum:")
    )


@query(
    "v3_positive_amounts",
    _union(
        _count("positive:amount_npr", "amount_npr <= 0", "tx_dirty"),
        _count("positive:exchange_rate", "exchange_rate <= 0", "tx_dirty"),
    ),
    views=("tx_dirty",),
)
def v3(spark, d):
    return contracts.rule_report(tx_dirty(spark, d), "transactions", "positive:")


@query(
    "v4_binary_flags",
    _union(
        *[_count(f"flag:{c}", f"{c} NOT BETWEEN 0 AND 1", "tx_dirty") for c in ("is_cross_border", "ip_is_vpn", "is_fraud", "aml_risk_indicator")],
        *[_count(f"flag:{c}", f"{c} NOT BETWEEN 0 AND 1", "ac_dirty") for c in ("kyc_verified", "is_pep", "is_sanctioned", "is_mule")],
    ),
    views=("tx_dirty", "ac_dirty"),
)
def v4(spark, d):
    return contracts.rule_report(tx_dirty(spark, d), "transactions", "flag:").unionByName(
        contracts.rule_report(ac_dirty(spark, d), "accounts", "flag:")
    )


@query(
    "v5_non_negative",
    _union(*[_count(f"nonnegative:{c}", f"{c} < 0", "ac_dirty") for c in ("account_age_days", "average_monthly_volume", "average_monthly_count")]),
    views=("ac_dirty",),
)
def v5(spark, d):
    return contracts.rule_report(ac_dirty(spark, d), "accounts", "nonnegative:")


_ALERTS_SQL = "al AS (SELECT CASE WHEN amount_npr IS NULL THEN 'NaN'::DOUBLE ELSE amount_npr / 1000000.0 END AS risk_score, ip_is_vpn AS alert_flag FROM tx_dirty)"


@query(
    "v6_score_range",
    _union(
        _count("range:risk_score", "isnan(risk_score) OR risk_score < 0 OR risk_score > 1", "al"),
        _count("flag:alert_flag", "alert_flag NOT BETWEEN 0 AND 1", "al"),
    ),
    views=("tx_dirty",),
    ctes=(_ALERTS_SQL,),
)
def v6(spark, d):
    alerts = tx_dirty(spark, d).select(
        "transaction_id",
        F.lit("velocity").alias("agent_name"),
        F.coalesce(F.col("amount_npr") / 1_000_000.0, F.lit(float("nan"))).alias("risk_score"),
        F.col("ip_is_vpn").alias("alert_flag"),
        F.lit("AGENT_SCORE").alias("reason_code"),
        F.lit("text").alias("explanation"),
        F.col("txn_ts").alias("timestamp"),
    )
    return contracts.rule_report(alerts, "alert_scores", "range:").unionByName(
        contracts.rule_report(alerts, "alert_scores", "flag:")
    )


@query(
    "v7_corridor_required",
    _count("corridor:required", "is_cross_border = 1 AND remittance_corridor IS NULL", "tx_dirty"),
    views=("tx_dirty",),
)
def v7(spark, d):
    return contracts.rule_report(tx_dirty(spark, d), "transactions", "corridor:")


@query(
    "v8_required_columns",
    _union(
        *[_count(f"required:{c}", f"{c} IS NULL", "tx_dirty") for c in contracts.REQUIRED["transactions"]],
        *[_count(f"required:{c}", f"{c} IS NULL", "ac_dirty") for c in contracts.REQUIRED["accounts"]],
    ),
    views=("tx_dirty", "ac_dirty"),
)
def v8(spark, d):
    return contracts.rule_report(tx_dirty(spark, d), "transactions", "required:").unionByName(
        contracts.rule_report(ac_dirty(spark, d), "accounts", "required:")
    )


@query(
    "v8_castable_types",
    _union(
        *[
            f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST({c} AS {t}) IS NULL) AS uncastable FROM tx_text"
            for c, t in (
                ("transaction_id", "VARCHAR"), ("transaction_date", "DATE"), ("transaction_time", "VARCHAR"),
                ("sender_account_id", "VARCHAR"), ("amount_npr", "DOUBLE"), ("sender_country", "VARCHAR"),
                ("is_cross_border", "INTEGER"), ("ip_is_vpn", "INTEGER"), ("is_fraud", "INTEGER"),
            )
        ]
    ),
    views=("tx_text",),
)
def v8_cast(spark, d):
    return contracts.cast_report(tx_text(spark, d), schemas.TRANSACTIONS)


_BROKEN = f"""concat_ws(',', CASE WHEN sender_account_id IS NULL THEN 'required:sender_account_id' END,
 CASE WHEN amount_npr IS NULL THEN 'required:amount_npr' END,
 CASE WHEN transaction_type NOT IN {_TYPES} THEN 'enum:transaction_type' END,
 CASE WHEN channel NOT IN ('mobile_banking','atm','branch','online_banking','pos') THEN 'enum:channel' END,
 CASE WHEN fraud_type NOT IN ('transaction_fraud','aml_structuring','aml_layering','aml_mule_network','identity_fraud') THEN 'enum:fraud_type' END,
 CASE WHEN amount_npr <= 0 THEN 'positive:amount_npr' END, CASE WHEN exchange_rate <= 0 THEN 'positive:exchange_rate' END,
 CASE WHEN ip_is_vpn NOT BETWEEN 0 AND 1 THEN 'flag:ip_is_vpn' END, CASE WHEN is_fraud NOT BETWEEN 0 AND 1 THEN 'flag:is_fraud' END,
 CASE WHEN is_cross_border = 1 AND remittance_corridor IS NULL THEN 'corridor:required' END)"""


@query(
    "v8_quarantine",
    f"SELECT * FROM (SELECT transaction_id, {_BROKEN} AS broken FROM tt) WHERE broken <> ''",
    views=("tx_dirty",),
    ctes=(_TX_TRIM,),
)
def v8_quarantine(spark, d):
    _, bad = contracts.split_valid(tx_dirty(spark, d), "transactions")
    return bad.select("transaction_id", F.array_join("violations", ",").alias("broken"))


@query(
    "v9_lookup_invariants",
    """SELECT 'corridor_without_valid_tier' AS rule, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'corridor_without_currency', 0
 UNION ALL SELECT 'rate_range_not_ascending', 0 UNION ALL SELECT 'channel_mix_not_one', 0
 UNION ALL SELECT 'rows_with_unknown_corridor', count(*) FILTER (WHERE remittance_corridor NOT IN ("""
    + f"{S.LOW},{S.MEDIUM},{S.HIGH}"
    + """)) FROM tx UNION ALL SELECT 'rows_with_unknown_currency', count(*) FILTER (WHERE original_currency NOT IN ('USD','EUR','GBP','INR','QAR','SAR','AED','MYR','AUD','JPY')) FROM tx
 UNION ALL SELECT 'rows_with_unknown_channel', count(*) FILTER (WHERE channel NOT IN ('mobile_banking','branch','atm','online_banking','pos')) FROM tx""",
)
def v9(spark, d):
    return contracts.lookup_invariants(tx(spark, d))


@query(
    "v10_corridor_currency_and_rate",
    """SELECT transaction_id, 0 AS unknown_corridor,
 CASE WHEN (remittance_corridor = 'Qatar->Nepal' AND original_currency <> 'QAR') OR (remittance_corridor = 'India->Nepal' AND original_currency <> 'INR')
 OR (remittance_corridor = 'USA->Nepal' AND original_currency <> 'USD') THEN 1 ELSE 0 END AS wrong_currency,
 CASE WHEN (original_currency = 'QAR' AND exchange_rate NOT BETWEEN 30 AND 38) OR (original_currency = 'INR' AND exchange_rate NOT BETWEEN 1.58 AND 1.65)
 OR (original_currency = 'USD' AND exchange_rate NOT BETWEEN 110 AND 135) THEN 1 ELSE 0 END AS rate_outside_range FROM tx""",
)
def v10(spark, d):
    return contracts.corridor_checks(tx(spark, d))


@query(
    "v11_missing_columns",
    """SELECT CASE WHEN a = 1 AND b = 1 THEN 'STRUCTURING|LAYERING' WHEN a = 1 THEN 'STRUCTURING' WHEN b = 1 THEN 'LAYERING' ELSE 'NO_VIOLATIONS' END AS reason_code,
 count(*) AS n, round(sum((a * 0.6 + b * 0.7)::DOUBLE / 3.8::DOUBLE), 6) AS total FROM (
 SELECT CASE WHEN amount_npr BETWEEN 900000 AND 999000 THEN 1 ELSE 0 END AS a,
 CASE WHEN is_cross_border = 1 AND count(*) OVER (PARTITION BY sender_account_id, remittance_corridor) >= 2 THEN 1 ELSE 0 END AS b FROM tx) GROUP BY 1""",
)
def v11(spark, d):
    """Without account columns only the transaction rules are left; without an id no rows are."""
    t = tx(spark, d)
    none = compliance.score(t.drop("transaction_id"))
    return compliance.score(t).unionByName(none).groupBy("reason_code").agg(
        F.count("*").alias("n"), F.round(F.sum("risk_score"), 6).alias("total")
    )
