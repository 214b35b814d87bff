"""Business facts of the scorers on small tables."""

import pytest
from pyspark.sql import functions as F

from riskweave.operators.alerts import ALERT_SCHEMA
from riskweave.plans.views import ac, tx
from riskweave.scorers import behaviour, compliance, geo, network, velocity
from riskweave.scorers.together import score_together
from riskweave.settings import alert_threshold


@pytest.fixture(scope="module")
def kyc(spark):
    rows = [
        # id, sender, amount, cross, corridor, pep, sanctioned, verified, grade, age
        ("T001", "A1", 950_000.0, 0, None, 0, 0, 1, "low", 400),
        ("T002", "A2", 1_000.0, 1, "USA->Nepal", 1, 0, 1, "high", 30),
        ("T003", "A2", 999_000.0, 1, "USA->Nepal", 1, 0, 1, "high", 30),
        ("T004", "A3", 500.0, 0, None, 0, 0, 1, "low", 1000),
        ("T005", "A4", 500.0, 0, None, 0, 1, 1, "low", 1000),
        ("T006", "A5", 500.0, 0, None, 0, 0, 0, "low", 1000),
    ]
    return spark.createDataFrame(
        rows,
        "transaction_id string, sender_account_id string, amount_npr double, is_cross_border int, remittance_corridor string, "
        "is_pep int, is_sanctioned int, kyc_verified int, kyc_risk_grade string, account_age_days int",
    )


def by_id(df):
    return {r["transaction_id"]: r for r in df.collect()}


def test_compliance_facts(kyc):
    out = by_id(compliance.score(kyc))
    assert out["T001"]["reason_code"] == "STRUCTURING"
    assert out["T003"]["reason_code"] == "PEP|NEW_ACCOUNT|HIGH_RISK_GRADE|STRUCTURING|LAYERING"
    assert out["T005"]["reason_code"] == "SANCTIONS"
    assert out["T005"]["risk_score"] == pytest.approx(1.0 / 3.8)
    assert out["T005"]["alert_flag"] == 0
    assert out["T004"]["risk_score"] == 0.0
    assert out["T004"]["reason_code"] == "NO_VIOLATIONS"
    assert out["T004"]["explanation"] == "No KYC/AML violations detected."
    assert out["T006"]["explanation"] == "KYC/AML violations: kyc unverified."


def test_layering_survives_splitting_the_pair(kyc):
    small = by_id(compliance.score(kyc, {"hot_key_rows": 1}))
    assert {k: v["reason_code"] for k, v in small.items()} == {
        k: v["reason_code"] for k, v in by_id(compliance.score(kyc)).items()
    }


def test_geo_facts(spark):
    rows = [("t1", "Nepal", "Nepal", 0, 0), ("t2", "Nepal", "India", 0, 0), ("t3", "Nepal", "India", 0, 1), ("t4", "USA", "USA", 1, 0)]
    df = spark.createDataFrame(rows, "transaction_id string, sender_country string, ip_country string, is_cross_border int, ip_is_vpn int")
    df = df.withColumn("remittance_corridor", F.when(F.col("is_cross_border") == 1, "USA->Nepal"))
    out = by_id(geo.score(df))
    assert [out[f"t{i}"]["reason_code"] for i in range(1, 5)] == [
        "DOMESTIC", "IP_COUNTRY_MISMATCH", "VPN_OR_PROXY", "HIGH_RISK_CORRIDOR",
    ]
    assert out["t4"]["risk_score"] == pytest.approx(0.45 * 0.85 + 0.2)
    assert geo.score(df.select("transaction_id")).agg(F.max("risk_score")).first()[0] == 0.0


@pytest.mark.parametrize("scorer", ["geo", "compliance", "velocity", "behaviour", "network"])
def test_missing_id_gives_an_empty_table(spark, sf_dir, scorer):
    t = tx(spark, sf_dir).drop("transaction_id")
    calls = {
        "geo": lambda: geo.score(t), "compliance": lambda: compliance.score(t),
        "velocity": lambda: velocity.score(t, None), "behaviour": lambda: behaviour.score(t, None),
        "network": lambda: network.score(t),
    }
    out = calls[scorer]()
    assert out.columns == [f.name for f in ALERT_SCHEMA]
    assert out.count() == 0


def test_id_only_row_scores_zero(spark):
    one = spark.createDataFrame([("x",)], "transaction_id string")
    feats = velocity.features(one)
    assert velocity.fit(feats) is None
    assert velocity.score_features(feats, None).first()["risk_score"] == 0.0
    assert network.score(one).first()["reason_code"] == "NO_GRAPH_FEATURES"
    assert compliance.score(one).first()["reason_code"] == "NO_VIOLATIONS"


def test_isolation_forest_is_repeatable_and_ranks_outliers(spark, sf_dir, tmp_path):
    feats = velocity.features(tx(spark, sf_dir)).cache()
    settings = {"velocity_isolation_estimators": 25}
    model = velocity.fit(feats, settings)
    again = velocity.fit(feats.repartition(7), settings)
    assert model.nodes.sort_values(["tree", "node"]).reset_index(drop=True).equals(
        again.nodes.sort_values(["tree", "node"]).reset_index(drop=True)
    )
    model.save(spark, f"{tmp_path}/forest")
    loaded = velocity.IsolationForest.load(spark, f"{tmp_path}/forest")
    scored = feats.select("amount_zscore", velocity.model_score(feats, model).alias("a"), velocity.model_score(feats, loaded).alias("b"))
    stats = scored.agg(F.min("a"), F.max("a"), F.max(F.abs(F.col("a") - F.col("b")))).first()
    assert (stats[0], stats[1], stats[2]) == (0.0, 1.0, 0.0)
    means = scored.groupBy(F.col("amount_zscore") > 3).agg(F.avg("a").alias("m")).collect()
    assert {r[0]: r["m"] for r in means}[True] > {r[0]: r["m"] for r in means}[False] + 0.2


def test_isolation_scores_match_a_plain_walk(spark, sf_dir):
    feats = velocity.features(tx(spark, sf_dir)).limit(40).cache()
    model = velocity.fit(feats, {"velocity_isolation_estimators": 5})
    trees = {t: g.set_index("node") for t, g in model.nodes.groupby("tree")}
    rows = feats.withColumn("s", velocity.model_score(feats, model)).collect()
    raw = []
    for r in rows:
        depth = 0.0
        for g in trees.values():
            node = g.loc[0]
            while node["feature"] >= 0:
                left = r[model.columns[int(node["feature"])]] <= node["threshold"]
                node = g.loc[int(node["left"] if left else node["right"])]
            depth += node["depth_value"]
        raw.append(2.0 ** (-(depth / len(trees)) / velocity._mean_depth(model.sample)))
    low, high = min(raw), max(raw)
    for r, x in zip(rows, raw):
        assert r["s"] == pytest.approx((x - low) / (high - low), abs=1e-9)


def test_sequence_model_beats_chance(spark, sf_dir, tmp_path):
    t = tx(spark, "/root/testdata/sf0.01")
    model = behaviour.fit(t, {"behaviour_max_iter": 20})
    model.save(spark, f"{tmp_path}/seq")
    loaded = behaviour.SequenceModel.load(spark, f"{tmp_path}/seq")
    out = behaviour.score(t, loaded).join(t.select("transaction_id", "is_fraud"), "transaction_id")
    means = {r["is_fraud"]: r["m"] for r in out.groupBy("is_fraud").agg(F.avg("risk_score").alias("m")).collect()}
    assert out.count() == t.count()
    assert means[1] > means[0]


def test_behaviour_heuristic_never_below_half(spark, sf_dir):
    low = behaviour.score(tx(spark, sf_dir), None).agg(F.min("risk_score")).first()[0]
    assert low >= 0.5


@pytest.mark.parametrize("limits", [{}, {"dense_key_rows": 8, "hot_key_rows": 5}])
def test_one_shuffle_scores_equal_the_single_scorers(spark, sf_dir, limits):
    t, a = tx(spark, sf_dir), ac(spark, sf_dir)
    got = by_id(score_together(t, a, settings=limits))
    single = {
        "velocity": velocity.score(t, None),
        "geo_risk": geo.score(t),
        "behaviour": behaviour.score(t, None),
        "kyc_aml": compliance.score(compliance.join_accounts(t, a)),
        "graph": network.score(t),
    }
    for name, alerts in single.items():
        rows = by_id(alerts)
        assert len(rows) == len(got)
        for tid, row in rows.items():
            assert got[tid][f"{name}_score"] == pytest.approx(row["risk_score"], abs=1e-9)
            if name != "behaviour":
                assert got[tid][f"{name}_reason_code"] == row["reason_code"]


def test_geo_models_fit_and_fall_back(spark, sf_dir):
    t = tx(spark, sf_dir)
    model = geo.fit(t, {"geo_risk_iterations": 5})
    out = geo.score(t, model)
    assert out.filter(~F.col("risk_score").between(0, 1)).count() == 0
    assert out.select("risk_score").distinct().count() > 1
    assert geo.fit(t.withColumn("is_fraud", F.lit(0))) is None
    # Categories never seen in the fit are scored too.
    assert geo.score(t.withColumn("ip_country", F.lit("Atlantis")), model).count() == t.count()


def test_thresholds():
    assert alert_threshold("velocity") == 0.7
    assert alert_threshold("velocity", {"alert_threshold": 0.2}) == 0.2
    assert alert_threshold("custom_agent", {"custom_alert_threshold": 0.3}) == 0.3
    assert alert_threshold("custom") == 0.5
    with pytest.raises(ValueError):
        alert_threshold("geo_risk", {"geo_risk_alert_threshold": 1.5})
