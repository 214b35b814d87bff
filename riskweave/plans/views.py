"""Payment tables derived from the star-schema test tables.

Each view is a list of select expressions that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskweave.runtime import prepare

_COUNTRY = "CASE user_id % 8 WHEN 0 THEN 'Qatar' WHEN 1 THEN 'India' WHEN 2 THEN 'USA' ELSE 'Nepal' END"
_FRAUD = "(value > 200 OR (user_id % 29 = 0 AND event_id % 3 = 0))"

TX = {
    "transaction_id": "'T' || CAST(event_id AS STRING)",
    "txn_ts": "ts",
    "transaction_date": "CAST(ts AS DATE)",
    "transaction_time": "substr(CAST(ts AS STRING), 12, 8)",
    "sender_account_id": "'A' || CAST(user_id AS STRING)",
    "receiver_account_id": "'A' || CAST((user_id * 31 + event_id * 17) % 150 AS STRING)",
    "transaction_type": "CASE event_type WHEN 'purchase' THEN 'payment' WHEN 'view' THEN 'transfer' "
    "WHEN 'click' THEN 'withdrawal' WHEN 'signup' THEN 'deposit' ELSE 'cash_out' END",
    "amount_npr": "value * 20000.0",
    "original_currency": "CASE user_id % 8 WHEN 0 THEN 'QAR' WHEN 1 THEN 'INR' WHEN 2 THEN 'USD' ELSE 'NPR' END",
    "exchange_rate": "CAST(CASE user_id % 8 WHEN 0 THEN 28 + event_id % 13 WHEN 1 THEN 1.6 "
    "WHEN 2 THEN 105 + event_id % 35 ELSE 1.0 END AS DOUBLE)",
    "channel": "CASE event_id % 5 WHEN 0 THEN 'mobile_banking' WHEN 1 THEN 'atm' WHEN 2 THEN 'branch' "
    "WHEN 3 THEN 'online_banking' ELSE 'pos' END",
    "sender_country": _COUNTRY,
    "receiver_country": "'Nepal'",
    "is_cross_border": "CASE WHEN user_id % 8 < 3 THEN 1 ELSE 0 END",
    "remittance_corridor": "CASE user_id % 8 WHEN 0 THEN 'Qatar->Nepal' WHEN 1 THEN 'India->Nepal' "
    "WHEN 2 THEN 'USA->Nepal' END",
    "merchant_category": "CASE WHEN event_type = 'purchase' THEN 'retail' END",
    "device_type": "CASE event_id % 3 WHEN 0 THEN 'android' WHEN 1 THEN 'ios' ELSE 'web' END",
    "ip_address": "'10.0.' || CAST(user_id % 256 AS STRING) || '.' || CAST(event_id % 256 AS STRING)",
    "ip_country": f"CASE WHEN event_id % 17 = 0 THEN 'India' ELSE {_COUNTRY} END",
    "ip_is_vpn": "CASE WHEN event_id % 33 = 0 THEN 1 ELSE 0 END",
    "is_fraud": f"CASE WHEN {_FRAUD} THEN 1 ELSE 0 END",
    "fraud_type": f"CASE WHEN {_FRAUD} THEN CASE event_id % 5 WHEN 0 THEN 'transaction_fraud' "
    "WHEN 1 THEN 'aml_structuring' WHEN 2 THEN 'aml_layering' WHEN 3 THEN 'aml_mule_network' "
    "ELSE 'identity_fraud' END END",
    "aml_risk_indicator": f"CASE WHEN {_FRAUD} AND event_id % 5 IN (1, 2, 3) THEN 1 ELSE 0 END",
}

AC = {
    "account_id": "'A' || CAST(c_custkey AS STRING)",
    "account_type": "CASE c_custkey % 4 WHEN 0 THEN 'savings' WHEN 1 THEN 'current' WHEN 2 THEN 'salary' "
    "ELSE 'fixed_deposit' END",
    "account_open_date": "DATE '2022-12-31' - CAST((c_custkey * 37) % 2000 AS INT)",
    "account_age_days": "(c_custkey * 37) % 2000",
    "kyc_verified": "CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE 1 END",
    "kyc_risk_grade": "CASE c_custkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END",
    "is_pep": "CASE WHEN c_custkey % 23 = 0 THEN 1 ELSE 0 END",
    "is_sanctioned": "CASE WHEN c_custkey % 41 = 0 THEN 1 ELSE 0 END",
    "average_monthly_volume": "c_acctbal * 100.0",
    "average_monthly_count": "CAST(c_custkey % 60 AS INT)",
    "country": "CASE WHEN c_nationkey % 5 = 0 THEN 'India' ELSE 'Nepal' END",
    "city": "CASE c_custkey % 3 WHEN 0 THEN 'Kathmandu' WHEN 1 THEN 'Pokhara' END",
    "is_mule": "CASE WHEN c_custkey % 97 = 0 THEN 1 ELSE 0 END",
}

_N = "CAST(substr(transaction_id, 2) AS BIGINT)"
# tx with contract violations, over tx.
TX_DIRTY = {
    **{c: c for c in TX},
    "transaction_id": f"CASE WHEN {_N} % 101 = 0 THEN '  ' || transaction_id || ' ' ELSE transaction_id END",
    "sender_account_id": f"CASE WHEN {_N} % 103 = 0 THEN NULL ELSE sender_account_id END",
    "transaction_type": f"CASE WHEN {_N} % 37 = 0 THEN 'wire' WHEN {_N} % 41 = 0 THEN ' payment ' "
    "ELSE transaction_type END",
    "amount_npr": f"CASE WHEN {_N} % 43 = 0 THEN -amount_npr WHEN {_N} % 47 = 0 THEN 0.0 "
    f"WHEN {_N} % 53 = 0 THEN NULL ELSE amount_npr END",
    "exchange_rate": f"CASE WHEN {_N} % 59 = 0 THEN -1.0 ELSE exchange_rate END",
    "channel": f"CASE WHEN {_N} % 61 = 0 THEN 'fax' ELSE channel END",
    "remittance_corridor": f"CASE WHEN {_N} % 7 = 0 THEN NULL ELSE remittance_corridor END",
    "ip_is_vpn": f"CASE WHEN {_N} % 67 = 0 THEN 2 ELSE ip_is_vpn END",
    "is_fraud": f"CASE WHEN {_N} % 71 = 0 THEN -1 ELSE is_fraud END",
    "fraud_type": f"CASE WHEN {_N} % 73 = 0 THEN 'other' ELSE fraud_type END",
}
# ac with contract violations, over ac.
_A = "CAST(substr(account_id, 2) AS BIGINT)"
AC_DIRTY = {
    **{c: c for c in AC},
    "account_type": f"CASE WHEN {_A} % 19 = 0 THEN 'gold' ELSE account_type END",
    "account_age_days": f"CASE WHEN {_A} % 17 = 0 THEN -5 ELSE account_age_days END",
    "kyc_risk_grade": f"CASE WHEN {_A} % 29 = 0 THEN 'unknown' ELSE kyc_risk_grade END",
    "is_pep": f"CASE WHEN {_A} % 31 = 0 THEN 9 ELSE is_pep END",
    "country": f"CASE WHEN {_A} % 37 = 0 THEN NULL ELSE country END",
}
# tx as text, with values that do not parse, over tx.
TX_TEXT = {
    "transaction_id": "transaction_id",
    "transaction_date": f"CASE WHEN {_N} % 83 = 0 THEN 'not a date' ELSE CAST(transaction_date AS STRING) END",
    "transaction_time": "transaction_time",
    "sender_account_id": f"CASE WHEN {_N} % 103 = 0 THEN NULL ELSE sender_account_id END",
    "sender_country": f"CASE WHEN {_N} % 89 = 0 THEN NULL ELSE sender_country END",
    "amount_npr": f"CASE WHEN {_N} % 53 = 0 THEN 'abc' WHEN {_N} % 59 = 0 THEN NULL "
    "ELSE CAST(CAST(round(amount_npr, 0) AS BIGINT) AS STRING) END",
    "is_cross_border": f"CASE WHEN {_N} % 61 = 0 THEN '' ELSE CAST(is_cross_border AS STRING) END",
    "ip_is_vpn": f"CASE WHEN {_N} % 67 = 0 THEN 'yes' ELSE CAST(ip_is_vpn AS STRING) END",
    "is_fraud": "CAST(is_fraud AS STRING)",
}
# The raw file layout.
RAW_TX = {
    "Date": "CAST(ts AS DATE)",
    "Time": "substr(CAST(ts AS STRING), 12, 8)",
    "Sender_account": "CAST(user_id AS STRING)",
    "Receiver_account": "CAST((user_id * 31 + event_id * 17) % 150 AS STRING)",
    "amount_local_npr": "value * 20000.0",
    "Payment_currency": "CASE user_id % 8 WHEN 0 THEN 'QAR' WHEN 1 THEN 'INR' ELSE 'NPR' END",
    "Payment_type": "CASE event_id % 9 WHEN 0 THEN 'Cash Deposit' WHEN 1 THEN 'Cross-border' WHEN 2 THEN 'Cheque' "
    "WHEN 3 THEN 'ACH' WHEN 4 THEN 'Credit card' WHEN 5 THEN 'Wire' WHEN 6 THEN 'Cash Withdrawal' "
    "WHEN 7 THEN 'Barter' END",
    "transmode_code": "CASE event_id % 9 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'E' WHEN 3 THEN 'F' "
    "WHEN 4 THEN 'J' WHEN 5 THEN 'P' WHEN 6 THEN 'Z' WHEN 7 THEN 'Q' END",
    "cross_border_flag": "CASE WHEN user_id % 8 < 3 THEN 1 WHEN user_id % 8 < 6 THEN 0 END",
    "Sender_bank_location": "CASE user_id % 8 WHEN 0 THEN 'Qatar' WHEN 1 THEN 'India' WHEN 2 THEN 'USA' ELSE 'Nepal' END",
}
RAW_AC = {
    "account_id": "CAST(c_custkey AS STRING)",
    "opened": "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE DATE '2022-12-31' - CAST((c_custkey * 37) % 2000 AS INT) END",
    "risk_grade": "CASE c_custkey % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'Medium' WHEN 2 THEN 'low' END",
    "pep_flag": "CASE WHEN c_custkey % 23 = 0 THEN 1 WHEN c_custkey % 23 = 1 THEN 0 END",
    "sanctions_hit": "CASE WHEN c_custkey % 41 = 0 THEN 1 END",
}


def _exprs(view: dict[str, str]) -> list[str]:
    return [f"{e} AS {c}" for c, e in view.items()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_exprs(TX))


def ac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*_exprs(AC))


def tx_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx(spark, sf_dir).selectExpr(*_exprs(TX_DIRTY))


def ac_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ac(spark, sf_dir).selectExpr(*_exprs(AC_DIRTY))


def tx_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx(spark, sf_dir).selectExpr(*_exprs(TX_TEXT))


def raw_tx(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_exprs(RAW_TX), *extra)


def raw_ac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*_exprs(RAW_AC))


_SQL = {
    "tx": (TX, "events", ()),
    "ac": (AC, "customer", ()),
    "tx_dirty": (TX_DIRTY, "tx", ("tx",)),
    "ac_dirty": (AC_DIRTY, "ac", ("ac",)),
    "tx_text": (TX_TEXT, "tx", ("tx",)),
    "raw_tx": ({"event_id": "event_id", **RAW_TX}, "events", ()),
    "raw_ac": (RAW_AC, "customer", ()),
}


def sql_prelude(*names: str) -> list[str]:
    """CTE texts of the named views, with the views they build on."""
    out: list[str] = []
    for name in names:
        view, source, needs = _SQL[name]
        for text in [*sql_prelude(*needs), f"{name} AS (SELECT {', '.join(_exprs(view))} FROM {source})"]:
            if text not in out:
                out.append(text)
    return out
