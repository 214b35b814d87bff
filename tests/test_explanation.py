"""Composed sentences."""

import pytest

from riskweave.operators.alerts import explain
from riskweave.plans.catalog import QUERIES
from riskweave.scorers import explanation


def one(spark, schema, *row, **kw):
    return explanation.score(spark.createDataFrame([row], schema), **kw).first()


def test_full_sentence(spark):
    r = one(
        spark,
        "transaction_id string, transaction_type string, amount_npr double, channel string, remittance_corridor string, meta_risk_score double, kyc_aml_reason_code string",
        "T1", "transfer", 950000.0, "mobile_banking", "Qatar->Nepal", 0.92, "STRUCTURING",
    )
    assert r["explanation"] == (
        "Transaction T1 (transfer, NPR 950,000.00, via mobile_banking, Qatar->Nepal) is flagged for review "
        "with combined risk score 0.920. Contributing signals: structuring. "
        "This is a suspicious-activity triage explanation, not a finding of criminal conduct."
    )
    assert (r["reason_code"], r["alert_flag"]) == ("EXPLANATION_ALERT", 1)


def test_defaults(spark):
    r = one(spark, "transaction_id string, channel string", "T2", "  ")
    assert "(transaction, an unknown amount, via unknown channel, domestic corridor) is not flagged" in r["explanation"]
    assert "no dominant upstream reason was recorded" in r["explanation"]
    assert r["risk_score"] == 0.0


def test_unknown_score(spark):
    r = one(spark, "transaction_id string, meta_risk_score double", "T3", None)
    assert "is not flagged with combined risk score unknown." in r["explanation"]
    assert r["reason_code"] == "EXPLANATION_NORMAL"


def test_signal_order_and_limit(spark):
    df = spark.createDataFrame(
        [("T", "NO_VIOLATIONS", "VPN_OR_PROXY", "VPN_OR_PROXY", "NO_VIOLATIONS", ["graph", "velocity", "kyc_aml"])],
        "transaction_id string, reason_code string, meta_reason_code string, geo_reason_code string, kyc_reason_code string, attribution_reasons array<string>",
    )
    assert df.select(explanation.signals(df)).first()[0] == ["vpn or proxy", "no violations", "graph", "velocity"]
    assert df.select(explanation.signals(df, ("NO_VIOLATIONS",))).first()[0] == ["vpn or proxy", "graph", "velocity", "kyc aml"]


@pytest.mark.parametrize(
    "agent, text",
    [
        ("velocity", "Transaction a: no velocity score is available."),
        ("kyc_aml", "Transaction a: No KYC/AML score is available for this transaction."),
        ("explanation", "No explanation is available for transaction a."),
    ],
)
def test_unscored_transactions(spark, agent, text):
    from riskweave.operators.alerts import empty_alerts

    ids = spark.createDataFrame([("a",)], "transaction_id string")
    assert explain(empty_alerts(spark), ids, agent).first()["explanation"] == text


def test_every_transaction_is_explained_by_its_own_score(spark, sf_dir):
    rows = QUERIES["o3_explain_all_transactions"](spark, sf_dir).collect()
    assert rows and not any("no geographic score" in r.explanation for r in rows)


def test_every_sender_with_a_score_keeps_it(spark, sf_dir):
    scores = {r.transaction_id: r.node_score for r in QUERIES["j6_all_node_scores_to_transactions"](spark, sf_dir).collect()}
    some = {r.transaction_id: r.node_score for r in QUERIES["j6_node_score_to_transactions"](spark, sf_dir).collect()}
    assert scores.keys() == some.keys() and len(set(scores.values())) > len(set(some.values()))
