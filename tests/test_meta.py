"""Stacking, calibration, attributions, persistence."""

import random

import pytest
from pyspark.sql import functions as F

from riskweave.plans import q_scorers
from riskweave.plans.views import tx
from riskweave.scorers import meta

FIVE = [f"{a}_score" for a in meta.AGENTS]
FAST = {"meta_learner_n_estimators": 10, "meta_learner_max_depth": 4}


@pytest.fixture(scope="module")
def wide(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(240):
        y = int(i % 5 == 0)
        rows.append((f"T{i:03d}", *[min(1.0, max(0.0, rnd.gauss(0.3 + 0.35 * y, 0.15))) for _ in FIVE], y))
    return spark.createDataFrame(rows, f"transaction_id string, {', '.join(f'{c} double' for c in FIVE)}, is_fraud int").cache()


@pytest.mark.parametrize(
    "settings",
    [FAST, {**FAST, "meta_learner_calibration_cv": 1}, {**FAST, "meta_learner_model_type": "xgboost"}],
    ids=["folds", "holdout", "boosted"],
)
def test_models_rank_and_survive_storage(spark, wide, tmp_path, settings):
    model = meta.fit(wide, settings)
    out = meta.score(wide, model)
    assert out.count() == wide.count()
    assert out.filter(~F.col("risk_score").between(0, 1)).count() == 0
    means = {
        r["is_fraud"]: r["m"]
        for r in out.join(wide, "transaction_id").groupBy("is_fraud").agg(F.avg("risk_score").alias("m")).collect()
    }
    assert means[1] > means[0] + 0.3
    model.save(spark, f"{tmp_path}/meta")
    again = meta.score(wide, meta.MetaModel.load(spark, f"{tmp_path}/meta"))
    gap = out.join(again.select("transaction_id", F.col("risk_score").alias("b")), "transaction_id")
    assert gap.agg(F.max(F.abs(F.col("risk_score") - F.col("b")))).first()[0] < 1e-12
    imp = model.importances(spark).collect()
    assert sum(r["importance"] for r in imp) == pytest.approx(1.0)
    assert [r["importance"] for r in imp] == sorted((r["importance"] for r in imp), reverse=True)


def test_few_positives_use_the_holdout(spark, wide):
    one = wide.withColumn("is_fraud", (F.col("transaction_id") == "T000").cast("int"))
    model = meta.fit(one, FAST)
    assert len(model.members) == 1
    assert meta.score(one, model).count() == 240


def test_one_class_falls_back_to_the_average(wide):
    model = meta.fit(wide.withColumn("is_fraud", F.lit(0)))
    assert model.members == []
    row = model.transform(wide).first()
    assert row["meta_score"] == pytest.approx(sum(row[c] for c in FIVE) / 5)


def test_long_input_gives_one_row_per_input_row(spark):
    rows = [(f"T{i}", a, 0.1 * (j + 1), i % 2) for i in range(20) for j, a in enumerate(meta.AGENTS)]
    long = spark.createDataFrame(rows, "transaction_id string, agent_name string, risk_score double, is_fraud int")
    model = meta.fit(long, FAST)
    out = meta.score(long, model)
    assert out.count() == 100
    assert out.select("transaction_id", "risk_score").distinct().count() == 20


def test_missing_scores_count_zero(spark):
    df = spark.createDataFrame([("a", 1.0)], "transaction_id string, geo_risk_score double")
    row = meta.feature_matrix(df, FIVE).first()
    assert [row[c] for c in FIVE] == [0.0, 1.0, 0.0, 0.0, 0.0]


def test_other_score_columns_only_by_name(wide):
    df = wide.withColumn("meta_risk_score", F.lit(1.0))
    assert meta.feature_columns(df) == FIVE
    assert meta.feature_columns(df, ["meta_risk_score"])[-1] == "meta_risk_score"


def test_attributions_add_up(wide):
    model = meta.fit(wide, FAST)
    means = meta.feature_means(wide, FIVE)
    some = wide.limit(15)
    phi = meta.attributions(some, FIVE, model.transform, means)
    baseline = wide.limit(1).select("transaction_id", *[F.lit(means[c]).alias(c) for c in FIVE])
    base = model.transform(baseline).first()["meta_score"]
    full = {r["transaction_id"]: r["meta_score"] for r in model.transform(some.select("transaction_id", *FIVE)).collect()}
    rows = phi.collect()
    assert len(rows) == 15
    for r in rows:
        assert sum(r[f"phi_{c}"] for c in FIVE) == pytest.approx(full[r["transaction_id"]] - base, abs=1e-9)


def test_top_reasons_are_positive_and_ordered(spark):
    phi = spark.createDataFrame([("a", 0.1, -0.2, 0.3, 0.0, 0.05)], "transaction_id string, " + ", ".join(f"phi_{c} double" for c in FIVE))
    assert meta.top_reasons(phi, FIVE).first()["attribution_reasons"] == ["behaviour", "velocity", "graph"]


def test_attributions_and_importances_of_all_rows_by_the_default_model(spark, sf_dir, monkeypatch):
    asked = []

    def fit(table, settings=None):
        asked.append(settings)
        return q_scorers._average_model()

    monkeypatch.setattr(q_scorers.meta, "fit", fit)
    monkeypatch.setattr(meta.MetaModel, "importances", lambda self, spark: None)
    rows = tx(spark, sf_dir).count()
    assert q_scorers.me8_forest(spark, sf_dir).count() == rows
    assert q_scorers.ex3(spark, sf_dir).count() == rows
    q_scorers.me7(spark, sf_dir)
    assert asked == [None] * 3


def test_training_rows_grow_with_the_cells_and_count_all_rows(spark):
    """4,000 rows of 12 kinds: a few training rows a kind, with the weight of all of them."""
    df = spark.range(4000).select(F.lit(1.0).alias("label"), (F.col("id") % 4 / 4).alias("a"), (F.col("id") % 3 / 3).alias("b"))
    cells = meta._training_cells(df, ["a", "b"], F.lit(0))
    assert cells.count() <= 12 * meta.BLOCKS and cells.agg(F.sum("n")).first()[0] == pytest.approx(4000)
    assert {(r.a, r.b) for r in cells.collect()} == {(r.a, r.b) for r in df.collect()}


def test_trees_send_a_row_where_they_send_its_mark(spark):
    rnd = random.Random(5)
    df = spark.createDataFrame([(f"T{i}", x := rnd.random() ** 3, int(x + rnd.gauss(0, 0.2) > 0.4)) for i in range(900)], "transaction_id string, geo_risk_score double, is_fraud int")
    model = meta.fit(df, {**FAST, "meta_learner_n_estimators": 3})
    marks = meta._marks(df, ["geo_risk_score"])["geo_risk_score"]
    assert len(marks) == meta.BINS
    near = df.withColumn("geo_risk_score", meta._nearest("geo_risk_score", marks))
    both = model.transform(df, "p").join(model.transform(near, "q").select("transaction_id", "q"), "transaction_id")
    assert both.filter("p <> q").count() == 0
