"""Canonical and raw table schemas."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
}


def _schema(text: str) -> T.StructType:
    """``name type, ...`` to a schema; needs no running session."""
    pairs = (item.split() for item in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


TRANSACTIONS = _schema(
    "transaction_id string, transaction_date date, transaction_time string, sender_account_id string, "
    "receiver_account_id string, transaction_type string, amount_npr double, original_currency string, "
    "exchange_rate double, channel string, sender_country string, receiver_country string, is_cross_border int, "
    "remittance_corridor string, merchant_category string, device_type string, ip_address string, "
    "ip_country string, ip_is_vpn int, is_fraud int, fraud_type string, aml_risk_indicator int"
)
ACCOUNTS = _schema(
    "account_id string, account_type string, account_open_date date, account_age_days int, kyc_verified int, "
    "kyc_risk_grade string, is_pep int, is_sanctioned int, average_monthly_volume double, "
    "average_monthly_count int, country string, city string, is_mule int"
)
RAW_TRANSACTIONS = _schema(
    "Date date, Time string, Sender_account string, Receiver_account string, amount_local_npr double, "
    "Payment_currency string, Payment_type string, transmode_code string, cross_border_flag int, "
    "Sender_bank_location string"
)
RAW_ACCOUNTS = _schema(
    "account_id string, opened date, risk_grade string, pep_flag int, sanctions_hit int"
)
