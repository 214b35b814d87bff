"""Ordered target statistics and the boosted trees on them."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from riskweave.operators import target_stats as T
from riskweave.scorers import geo, ordered


@pytest.fixture(scope="module")
def rows():
    """One value holds half of the rows; nulls in a category and in the label."""
    rnd = random.Random(3)
    return [
        (f"T{i:03d}", "hot" if i % 2 else rnd.choice(["a", "b", None, "null"]), f"u{i % 7}", rnd.choice([0, 1, 1, None]))
        for i in range(300)
    ]


def test_means_of_the_rows_before(spark, rows):
    df = spark.createDataFrame(rows, "id string, c string, d string, y int")
    out = {r["id"]: r for r in T.ordered_means(df, ["c", "d"], "y", "id", 0.4, 2.0, 7).collect()}
    assert len(out) == len(rows)
    seen = {}
    for tie, c, d, y in sorted(rows, key=lambda r: hashlib.md5(f"7:{r[0]}".encode()).hexdigest()):
        for name, value in (("c", c), ("d", d)):
            known, positives = seen.get((name, value), (0, 0))
            assert out[tie][f"{name}_mean"] == pytest.approx((positives + 0.8) / (known + 2.0), rel=1e-12)
            if y is not None:
                seen[name, value] = (known + 1, positives + y)


@pytest.mark.parametrize("broadcast", [True, False])
def test_stored_totals_for_new_rows(spark, rows, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(T, "MAX_BROADCAST_KEYS", 1)
    df = spark.createDataFrame(rows, "id string, c string, d string, y int")
    totals = T.category_totals(df, ["c"], "y")
    new = spark.createDataFrame([("N1", "a"), ("N2", None), ("N3", "unseen")] + [(f"H{i}", "hot") for i in range(20)], "id string, c string")
    got = {r["id"]: r["c_mean"] for r in T.with_totals(new, totals, ["c"], "id", 0.4, 1.0, 5).collect()}
    assert len(got) == 23 and got["N3"] == pytest.approx(0.4)
    for tie, value in (("N1", "a"), ("N2", None), ("H7", "hot")):
        ys = [y for _, c, _, y in rows if c == value and y is not None]
        assert got[tie] == pytest.approx((sum(ys) + 0.4) / (len(ys) + 1))


def test_many_categories(spark):
    """A value of its own for nearly every row: no list of values on the driver, means stay near the prior."""
    df = spark.range(200_000).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("v"), F.col("id") % 190_000).alias("c"), (F.col("id") % 2).alias("y"))
    out = T.ordered_means(df, ["c"], "y", "id", 0.5)
    assert out.agg(F.count("*"), F.count_if(F.col("c_mean") == 0.5)).first()[:] == (200_000, 190_000)
    assert T.ordered_means(df.limit(0), ["c"], "y", "id", 0.5).count() == 0


def test_trees_on_the_earlier_rows_rank_the_later_ones(spark, tmp_path):
    """Fraud follows the corridor, one of 200; later rows are ranked by it, and a stored model scores alike."""
    n = 6_000
    tx = spark.range(n).select(
        F.concat(F.lit("T"), F.format_string("%05d", "id")).alias("transaction_id"),
        F.concat(F.lit("X->Y"), F.col("id") * 7919 % 200).alias("remittance_corridor"),
        (F.pmod(F.xxhash64("id"), F.lit(10)) < F.when(F.col("id") * 7919 % 200 < 40, 8).otherwise(1)).cast("int").alias("is_fraud"),
        F.lit("Nepal").alias("sender_country"),
    )
    small = {"geo_risk_iterations": 8, "geo_risk_depth": 3, "geo_risk_learning_rate": 0.3}
    early, late = tx.filter("transaction_id < 'T04800'"), tx.filter("transaction_id >= 'T04800'")
    model = ordered.fit(early, small)
    first = {r.transaction_id: r.risk_score for r in geo.score(late, model).collect()}
    label = {r.transaction_id: r.is_fraud for r in late.collect()}
    assert first.keys() == label.keys()
    good, bad = ([s for t, s in first.items() if label[t] == k] for k in (1, 0))
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.75
    model.save(spark, str(tmp_path / "m"))
    again = geo.score(late, ordered.OrderedTrees.load(spark, str(tmp_path / "m")))
    assert {r.transaction_id: r.risk_score for r in again.collect()} == first
    assert {r.risk_score for r in geo.score(late, ordered.fit(early, small)).select("risk_score").collect()} == set(first.values())
    assert ordered.fit(tx.filter("is_fraud = 0")) is None
