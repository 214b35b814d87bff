"""Lookup tables: corridors, currencies, channels, type codes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Remittance corridor -> risk tier.
CORRIDOR_TIER = {
    "Qatar->Nepal": "medium",
    "UAE->Nepal": "medium",
    "Saudi Arabia->Nepal": "medium",
    "Bahrain->Nepal": "medium",
    "Kuwait->Nepal": "medium",
    "Oman->Nepal": "medium",
    "India->Nepal": "low",
    "Malaysia->Nepal": "medium",
    "South Korea->Nepal": "medium",
    "Thailand->Nepal": "low",
    "USA->Nepal": "high",
    "UK->Nepal": "high",
    "Australia->Nepal": "high",
    "Japan->Nepal": "high",
}
# Tier -> score; a corridor without a tier scores 0.1.
TIER_SCORE = {"low": 0.20, "medium": 0.50, "high": 0.85}
UNKNOWN_CORRIDOR_SCORE = 0.1
# Corridor -> currency.
CORRIDOR_CURRENCY = {
    "Qatar->Nepal": "QAR",
    "UAE->Nepal": "AED",
    "Saudi Arabia->Nepal": "SAR",
    "Bahrain->Nepal": "SAR",
    "Kuwait->Nepal": "SAR",
    "Oman->Nepal": "SAR",
    "India->Nepal": "INR",
    "Malaysia->Nepal": "MYR",
    "South Korea->Nepal": "USD",
    "Thailand->Nepal": "USD",
    "USA->Nepal": "USD",
    "UK->Nepal": "GBP",
    "Australia->Nepal": "AUD",
    "Japan->Nepal": "JPY",
}
# Currency -> (lowest, highest) NPR per unit.
RATE_RANGE = {
    "USD": (110.0, 135.0),
    "EUR": (120.0, 150.0),
    "GBP": (140.0, 170.0),
    "INR": (1.58, 1.65),
    "QAR": (30.0, 38.0),
    "SAR": (29.0, 36.0),
    "AED": (30.0, 37.0),
    "MYR": (24.0, 30.0),
    "AUD": (75.0, 95.0),
    "JPY": (0.75, 0.95),
}
# Channel -> share of transactions.
CHANNEL_MIX = {
    "mobile_banking": 0.45,
    "branch": 0.225,
    "atm": 0.125,
    "online_banking": 0.125,
    "pos": 0.075,
}
# City list.
CITIES = (
    "Kathmandu", "Lalitpur", "Bhaktapur", "Pokhara", "Biratnagar", "Bharatpur", "Birganj", "Dharan",
    "Butwal", "Hetauda", "Nepalgunj", "Bhadrapur", "Itahari", "Dhangadhi", "Mahendranagar",
)
# Enumerations of the contract. The order of the first two is
# also the order of the 1-based category ids.
TRANSACTION_TYPES = (
    "transfer", "payment", "withdrawal", "deposit", "cash_out", "remittance_inbound", "remittance_outbound",
)
CHANNELS = ("mobile_banking", "atm", "branch", "online_banking", "pos")
FRAUD_TYPES = ("transaction_fraud", "aml_structuring", "aml_layering", "aml_mule_network", "identity_fraud")
ACCOUNT_TYPES = ("savings", "current", "salary", "fixed_deposit")
RISK_GRADES = ("low", "medium", "high")
# Raw payment type -> transaction type (else payment).
PAYMENT_TYPE = {
    "Cash Deposit": "deposit",
    "Cross-border": "remittance_outbound",
    "Cheque": "payment",
    "ACH": "transfer",
    "Credit card": "payment",
    "Wire": "transfer",
    "Cash Withdrawal": "withdrawal",
}
# Raw mode code -> channel (else branch).
MODE_CHANNEL = {
    "A": "mobile_banking",
    "B": "online_banking",
    "E": "branch",
    "F": "atm",
    "J": "pos",
    "P": "mobile_banking",
    "Z": "branch",
}


def lookup(key: Column, table: Mapping, default) -> Column:
    """Value of ``key`` in a small fixed table, else ``default``."""
    literal = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(literal[key], F.lit(default))


def category_id(key: Column, names: tuple[str, ...]) -> Column:
    """1-based position of a category, 0 when unknown."""
    return lookup(key, {name: i + 1 for i, name in enumerate(names)}, 0)


def corridor_score(corridor: Column) -> Column:
    scores = {name: TIER_SCORE[tier] for name, tier in CORRIDOR_TIER.items()}
    return lookup(corridor, scores, UNKNOWN_CORRIDOR_SCORE)


def corridor_dim(spark: SparkSession) -> DataFrame:
    rows = [(c, t, TIER_SCORE.get(t), CORRIDOR_CURRENCY.get(c)) for c, t in CORRIDOR_TIER.items()]
    return spark.createDataFrame(rows, "corridor string, tier string, tier_score double, currency string")


def rate_dim(spark: SparkSession) -> DataFrame:
    rows = [(c, low, high) for c, (low, high) in RATE_RANGE.items()]
    return spark.createDataFrame(rows, "currency string, min_rate double, max_rate double")


def channel_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CHANNEL_MIX.items()), "channel string, mix double")


def city_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in CITIES], "city string")
