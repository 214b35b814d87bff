"""Contract rules on single rows and on generated tables."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from riskweave.functions import dims
from riskweave.operators import contracts as C
from riskweave.sources import jsonrows, schemas

VALID = {
    "transaction_id": "T1", "transaction_date": dt.date(2024, 1, 1), "transaction_time": "10:00:00",
    "sender_account_id": "A1", "receiver_account_id": "A2", "transaction_type": "transfer", "amount_npr": 10.0,
    "original_currency": "NPR", "exchange_rate": 1.0, "channel": "atm", "sender_country": None,
    "receiver_country": None, "is_cross_border": 0, "remittance_corridor": None, "merchant_category": None,
    "device_type": "web", "ip_address": "10.0.0.1", "ip_country": None, "ip_is_vpn": 0, "is_fraud": 0,
    "fraud_type": None, "aml_risk_indicator": 0,
}


def table(spark, *changes):
    rows = [tuple({**VALID, **c}[f.name] for f in schemas.TRANSACTIONS) for c in changes]
    return spark.createDataFrame(rows, schemas.TRANSACTIONS)


def broken(spark, *changes):
    return [sorted(r["violations"]) for r in C.with_violations(table(spark, *changes), "transactions").collect()]


def test_each_rule(spark):
    cases = [
        ({}, []),
        ({"amount_npr": 0.0}, ["positive:amount_npr"]),
        ({"exchange_rate": -1.0}, ["positive:exchange_rate"]),
        ({"channel": "fax"}, ["enum:channel"]),
        ({"transaction_type": " payment "}, []),
        ({"fraud_type": "other"}, ["enum:fraud_type"]),
        ({"is_fraud": 2}, ["flag:is_fraud"]),
        ({"is_cross_border": 1}, ["corridor:required"]),
        ({"is_cross_border": 1, "remittance_corridor": "Qatar->Nepal"}, []),
        ({"sender_account_id": None, "ip_is_vpn": -1}, ["flag:ip_is_vpn", "required:sender_account_id"]),
    ]
    assert broken(spark, *[c for c, _ in cases]) == [w for _, w in cases]


_row = st.fixed_dictionaries(
    {
        "amount_npr": st.floats(-10, 10, allow_nan=False),
        "is_cross_border": st.integers(-1, 2),
        "remittance_corridor": st.sampled_from([None, "UK->Nepal"]),
        "channel": st.sampled_from([*dims.CHANNELS, "fax", " atm"]),
        "is_fraud": st.sampled_from([None, 0, 1, 7]),
    }
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(_row, min_size=1, max_size=30))
def test_rules_match_plain_python(spark, rows):
    def want(r):
        out = set()
        if r["amount_npr"] <= 0:
            out.add("positive:amount_npr")
        if r["is_cross_border"] not in (0, 1):
            out.add("flag:is_cross_border")
        if r["is_cross_border"] == 1 and r["remittance_corridor"] is None:
            out.add("corridor:required")
        if r["channel"].strip() not in dims.CHANNELS:
            out.add("enum:channel")
        if r["is_fraud"] is None:
            out.add("required:is_fraud")
        elif r["is_fraud"] not in (0, 1):
            out.add("flag:is_fraud")
        return sorted(out)

    changes = [{**r, "transaction_id": f"T{i:03d}"} for i, r in enumerate(rows)]
    checked = C.with_violations(table(spark, *changes), "transactions").orderBy("transaction_id").collect()
    assert [sorted(r["violations"]) for r in checked] == [want(r) for r in rows]


def test_missing_column_is_reported(spark):
    report = {r["rule"]: r["violations"] for r in C.rule_report(table(spark, {}).drop("channel"), "transactions").collect()}
    assert report["required:channel"] == 1
    assert sum(report.values()) == 1


def test_split_keeps_all_rows(spark):
    good, bad = C.split_valid(table(spark, {}, {"amount_npr": -1.0}), "transactions")
    assert (good.count(), bad.count()) == (1, 1)


def test_score_range_rejects_nan(spark):
    rows = [("a", "x", s, 0, "r", "e", dt.datetime(2024, 1, 1)) for s in (0.0, 1.0, 1.5, -0.1, float("nan"))]
    df = spark.createDataFrame(
        rows, "transaction_id string, agent_name string, risk_score double, alert_flag int, reason_code string, explanation string, timestamp timestamp"
    )
    assert {r["rule"]: r["violations"] for r in C.rule_report(df, "alert_scores", "range").collect()} == {"range:risk_score": 3}


def test_json_round_trip(spark):
    df = table(spark, {}, {"remittance_corridor": "UK->Nepal", "amount_npr": 0.1 + 0.2})
    back = jsonrows.from_json_rows(jsonrows.to_json_rows(df), schemas.TRANSACTIONS)
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)


def test_lookup_tables():
    assert set(dims.CORRIDOR_TIER.values()) <= set(dims.RISK_GRADES)
    assert set(dims.CORRIDOR_CURRENCY) == set(dims.CORRIDOR_TIER)
    assert abs(sum(dims.CHANNEL_MIX.values()) - 1.0) < 1e-9
    assert all(low < high for low, high in dims.RATE_RANGE.values())
    assert set(dims.CORRIDOR_CURRENCY.values()) <= set(dims.RATE_RANGE)


def test_white_space_types_and_time_of_day(spark):
    good = {
        "transaction_id": "T1", "transaction_date": "2022-01-02", "transaction_time": "09:05:00", "sender_account_id": "A", "receiver_account_id": "B",
        "transaction_type": "\tpayment\n", "amount_npr": "10.5", "original_currency": "NPR", "exchange_rate": "1.0", "channel": "branch",
        "is_cross_border": "0", "device_type": "x", "ip_address": "1.1.1.1", "ip_is_vpn": "0", "is_fraud": "0", "aml_risk_indicator": "0",
        "fraud_type": None, "remittance_corridor": None,
    }
    rows = [good, {**good, "transaction_id": "T2", "transaction_time": "99:99:99"}, {**good, "transaction_id": "T3", "is_fraud": "yes"}, {**good, "transaction_id": "T4", "amount_npr": "ten"}]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} string" for c in good))
    valid, broken = C.split_valid(df, "transactions")
    assert [(r.transaction_id, r.transaction_type) for r in valid.collect()] == [("T1", "payment")]
    assert {r.transaction_id: r.violations for r in broken.collect()} == {
        "T2": ["type:transaction_time"], "T3": ["type:is_fraud"], "T4": ["type:amount_npr"],
    }
