"""Metrics against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from riskweave.evaluation import metrics as M


def frame(spark, rows):
    return spark.createDataFrame(rows, "transaction_id string, is_fraud int, s double")


def test_perfect_ranking(spark):
    df = frame(spark, [("a", 1, 0.9), ("b", 1, 0.8), ("c", 0, 0.2), ("d", 0, 0.1)])
    row = M.evaluate(df, {"x": "s", "absent": "nope"}).collect()
    assert len(row) == 1
    r = row[0]
    assert (r["auc_roc"], r["auc_pr"], r["f1_at_optimal_threshold"], r["optimal_threshold"]) == (1.0, 1.0, 1.0, 0.8)
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (2, 0, 0, 2)
    assert r["precision_at_k"] == 1.0


def plain(rows, fraction):
    y = [r[1] for r in rows]
    s = [min(1.0, max(0.0, r[2])) for r in rows]
    pos = [b for a, b in zip(y, s) if a]
    neg = [b for a, b in zip(y, s) if not a]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))

    def f1(t):
        tp = sum(1 for a, b in zip(y, s) if a and b >= t)
        n = sum(1 for b in s if b >= t)
        return 2 * tp / (n + len(pos)) if n + len(pos) else 0.0

    candidates = [0.0, *sorted(set(s)), 1.0]
    values = [f1(t) for t in candidates]
    best = values.index(max(values))
    ap, seen = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        tp = sum(1 for a, b in zip(y, s) if a and b >= t)
        n = sum(1 for b in s if b >= t)
        ap += (tp / len(pos) - seen) * tp / n
        seen = tp / len(pos)
    k = max(1, min(len(y), -int(-len(y) * fraction // 1)))
    order = sorted(range(len(y)), key=lambda i: (-s[i], rows[i][0]))[:k]
    brier = sum((a - b) ** 2 for a, b in zip(y, s)) / len(y)
    return auc, ap, candidates[best], values[best], sum(y[i] for i in order) / k, brier


@pytest.mark.parametrize("seed", [1, 2])
def test_metrics_match_plain_python(spark, seed):
    rnd = random.Random(seed)
    # A third of the rows share one score, some lie outside [0, 1].
    rows = []
    for i in range(250):
        y = int(rnd.random() < 0.2)
        s = 0.4 if rnd.random() < 0.34 else round(rnd.gauss(0.4 + 0.3 * y, 0.3), 2)
        rows.append((f"T{i:03d}", y, s))
    r = M.evaluate(frame(spark, rows), {"x": "s"}, fraction=0.3).first()
    auc, ap, t, f1, pk, brier = plain(rows, 0.3)
    assert r["auc_roc"] == pytest.approx(auc)
    assert r["auc_pr"] == pytest.approx(ap)
    assert (r["optimal_threshold"], r["f1_at_optimal_threshold"]) == (pytest.approx(t), pytest.approx(f1))
    assert r["precision_at_k"] == pytest.approx(pk)
    assert r["brier_score"] == pytest.approx(brier)
    assert r["tn"] + r["fp"] + r["fn"] + r["tp"] == len(rows)


@pytest.mark.parametrize("label", [0, 1])
def test_one_class(spark, label):
    r = M.evaluate(frame(spark, [("a", label, 0.3), ("b", label, 0.6)]), {"x": "s"}).first()
    assert r["auc_roc"] == 0.5
    assert r["auc_pr"] == float(label)
    assert r["optimal_threshold"] == 0.0


def test_missing_label_is_an_error(spark):
    with pytest.raises(ValueError):
        M.evaluate(frame(spark, [("a", 1, 0.5)]).drop("is_fraud"), {"x": "s"})
    with pytest.raises(ValueError):
        M.precision_at_fraction(frame(spark, [("a", 1, 0.5)]), {"x": "s"}, 0.0)


def test_comparisons(spark):
    table = spark.createDataFrame([("velocity", 0.7), ("graph", 0.6), ("meta_learner", 0.8)], "agent_name string, auc_roc double")
    r = M.compare_system(table).first()
    assert (r["best_individual_auc_roc"], r["meta_auc_roc"]) == (0.7, 0.8)
    assert r["auc_roc_delta"] == pytest.approx(0.1)
    only_meta = M.compare_system(table.filter("agent_name = 'meta_learner'")).first()
    assert only_meta["best_individual_auc_roc"] == 0.0
    drop = {x["agent_name"]: x["auc_roc_delta"] for x in M.auc_drop(table, 0.8).collect()}
    assert drop["velocity"] == pytest.approx(0.1)


def test_detection_rates(spark):
    df = frame(spark, [("a", 1, 0.9), ("b", 1, 0.1), ("c", 0, 0.9)]).withColumn(
        "fraud_type", F.when(F.col("is_fraud") == 1, "aml_layering")
    )
    rows = M.detection_rates(df, {"x": "s", "absent": "nope"}).collect()
    assert [(r["agent_name"], r["pattern"], r["detection_rate"], r["count"]) for r in rows] == [("x", "aml_layering", 0.5, 2)]
    assert M.detection_rates(df.drop("fraud_type"), {"x": "s"}).count() == 0
