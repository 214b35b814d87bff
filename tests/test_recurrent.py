"""The gated recurrent unit: gradients, refits, storage, and an order it has to learn."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators.sequences import normalisation
from riskweave.scorers import behaviour
from riskweave.scorers.recurrent import GatedUnit, summed_gradient, train


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(1)
    unit = GatedUnit.fresh(5, 4, 2)
    x, y = rng.normal(size=(7, 6, 5)), np.array([1.0, 0, 0, 1, 0, 1, 0])
    _, g = unit.gradient(x, y, 2.5)
    for i in range(len(unit.flat)):
        up, down = unit.flat.copy(), unit.flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (GatedUnit(5, 4, up).gradient(x, y, 2.5)[0] - GatedUnit(5, 4, down).gradient(x, y, 2.5)[0]) / 2e-6
        assert g[i] == pytest.approx(slope, abs=1e-6)


@pytest.fixture(scope="module")
def ordered(spark):
    """Windows of one number a step: positive where a high value comes before a low one, which no sum of steps tells."""
    rnd = random.Random(3)
    rows = []
    for i in range(600):
        x = [rnd.gauss(0, 0.3) for _ in range(8)]
        a, b = sorted(rnd.sample(range(8), 2))
        y = i % 3 == 0
        x[a], x[b] = (2.0, -2.0) if y else (-2.0, 2.0)
        rows.append((f"A{i:03d}", [f"T{i}"], x, float(y)))
    return spark.createDataFrame(rows, "account string, ids array<string>, features array<double>, label double").repartition(4, "account").cache()


def test_sum_over_tasks_is_the_sum_over_windows(ordered):
    unit = GatedUnit.fresh(1, 6, 5)
    rows = ordered.collect()
    x, y = np.array([r.features for r in rows])[:, :, None], np.array([r.label for r in rows])
    loss, g = unit.gradient(x, y, 1.5)
    total, summed = summed_gradient(ordered, unit, 8, 1.5)
    assert total == pytest.approx(loss, abs=1e-8) and np.abs(g - summed).max() < 1e-8


def test_learns_the_order_and_refits_alike(ordered):
    held = F.col("account") >= "A450"
    windows = ordered.filter(~held).cache()
    fitted = [train(windows, 1, 8, 12, 45, 0.05, 7, 1.0, 450) for _ in range(2)]
    assert (fitted[0][0].flat == fitted[1][0].flat).all()
    unit, losses = fitted[0]
    assert losses[-1] < 0.5 * losses[0]
    rows = ordered.filter(held).collect()
    p = unit.probability(np.array([r.features for r in rows])[:, :, None])
    y = np.array([r.label for r in rows]) > 0
    auc = (p[y][:, None] > p[~y][None, :]).mean()
    assert auc > 0.95


def test_model_kinds_survive_storage(spark, tmp_path):
    rnd = random.Random(5)
    rows = []
    for i in range(900):
        acc = rnd.randrange(60)
        bad = acc % 4 == 0
        rows.append((f"T{i:04d}", f"A{acc}", 1e4 * (5 if bad and rnd.random() < 0.5 else 1) * rnd.uniform(0.5, 1.5), "transfer", "atm", i, int(bad)))
    t = spark.createDataFrame(rows, "transaction_id string, sender_account_id string, amount_npr double, transaction_type string, channel string, n long, is_fraud int")
    t = t.withColumn("txn_ts", F.timestamp_seconds(F.col("n") * 600)).drop("n")
    for kind in ("gru", "mlp"):
        model = behaviour.fit(t, {"behaviour_max_iter": 8, "behaviour_hidden_dim": 8, "behaviour_model_type": kind})
        assert isinstance(model.network, GatedUnit) == (kind == "gru")
        model.save(spark, f"{tmp_path}/{kind}")
        again = behaviour.SequenceModel.load(spark, f"{tmp_path}/{kind}")
        one, other = (behaviour.score(t, m).select("transaction_id", F.col("risk_score").alias(c)) for m, c in ((model, "a"), (again, "b")))
        both = one.join(other, "transaction_id")
        assert both.count() == 900 and both.filter(~F.col("a").eqNullSafe(F.col("b"))).count() == 0
        assert both.filter(~F.col("a").between(0, 1)).count() == 0
    assert behaviour.fit(t.withColumn("is_fraud", F.lit(0))) is None


def test_windows_take_few_tasks_and_a_short_message(spark, monkeypatch):
    """A round sends the parameters to every task and their gradient back: few windows need few tasks, however the session deals."""
    windows = spark.range(600).select(F.concat(F.lit("A"), "id").alias("account"), F.array(F.lit(0.5), F.lit(1.0)).alias("features"), F.lit(1.0).alias("label"))
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    try:
        assert behaviour._dealt(windows, 600).rdd.getNumPartitions() == 3
        monkeypatch.setattr(behaviour, "WINDOWS_PER_TASK", 100)
        dealt = behaviour._dealt(windows, 600)
        assert dealt.rdd.getNumPartitions() == 6
        monkeypatch.setattr(behaviour, "WINDOWS_PER_TASK", 1)
        assert behaviour._dealt(windows, 600).rdd.getNumPartitions() == 48
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    # More numbers than a block holds, and tasks without windows.
    unit = GatedUnit.fresh(1, 40, 5)
    loss, g = unit.gradient(np.tile([[0.5], [1.0]], (600, 1, 1)), np.ones(600), 1.5)
    total, summed = summed_gradient(dealt.unionByName(dealt.limit(0)), unit, 2, 1.5)
    assert len(g) > 4096 and total == pytest.approx(loss, abs=1e-7) and np.abs(g - summed).max() < 1e-7


def test_gates_far_from_zero_do_not_overflow():
    unit = GatedUnit(1, 2, np.full(GatedUnit.size(1, 2), 3.0))
    with np.errstate(all="raise", under="ignore"):
        for x in (-1e6, 1e6):
            loss, g = unit.gradient(np.full((3, 4, 1), x), np.array([0.0, 1.0, 0.0]), 1.0)
            assert np.isfinite(loss) and np.isfinite(g).all()


def _rows(spark, rows):
    return spark.createDataFrame(rows, "transaction_id string, account string, ts long, amount double")


def test_statistics_do_not_depend_on_how_rows_are_dealt(spark):
    """Tasks are added up as they arrive: a refit has the same mean and deviation to the last digit only if their order does not matter."""
    rnd = random.Random(11)
    rows = [(f"T{i:05d}", f"A{rnd.randrange(500)}", rnd.randrange(10**13), rnd.lognormvariate(9, 3)) for i in range(5000)]
    table, found = _rows(spark, rows).cache(), set()
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in (1, 3, 7, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            found.add(tuple(normalisation(table.repartition(n), 5_000_000).first()))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(found) == 1
    amounts, times = [r[3] for r in rows], {}
    for _, account, ts, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        times.setdefault(account, []).append(ts)
    deltas = [(b - a) / 1e6 for x in times.values() for a, b in zip(x, x[1:])]
    want = [f(x) for x in (amounts, deltas) for f in (statistics.fmean, statistics.stdev)]
    assert found.pop() == pytest.approx(want, rel=1e-13)


@pytest.mark.parametrize(
    ("amounts", "want"),
    [
        ([], (0.0, 1.0)),
        ([7.5], (7.5, 1.0)),
        ([0.1] * 9, (0.1, 1.0)),
        ([0.0, 0.0], (0.0, 1.0)),
        ([None, 2.0, -4.0], (-1.0, math.sqrt(18))),
        ([1e300, 3e300, 1e-300], (4e300 / 3, statistics.stdev([1.0, 3.0, 0.0]) * 1e300)),
        ([1e-300, 3e-300], (2e-300, math.sqrt(2) * 1e-300)),
        ([1.0, math.inf], (math.inf, math.nan)),
    ],
)
def test_statistics_of_odd_amounts(spark, amounts, want):
    rows = _rows(spark, [(f"T{i}", "A", 1_500_000 * i * i, a) for i, a in enumerate(amounts)])
    state = normalisation(rows, 5_000_000).first()
    assert (state["amount_mean"], state["amount_std"]) == pytest.approx(want, rel=1e-14, nan_ok=True)
    deltas = [1.5 * (2 * i + 1) for i in range(len(amounts) - 1)]
    assert state["time_mean"] == pytest.approx(statistics.fmean(deltas) if deltas else 0.0)
    assert state["time_std"] == pytest.approx(statistics.stdev(deltas) if len(deltas) > 1 else 1.0)


def test_score_does_not_depend_on_the_windows_beside():
    rng = np.random.default_rng(3)
    unit = GatedUnit.fresh(14, 64, 42)
    unit = GatedUnit(14, 64, unit.flat * 3)
    x = rng.normal(size=(4000, 16, 14))
    together = unit.probability(x)
    assert (together[:50] == [unit.probability(x[i : i + 1])[0] for i in range(50)]).all()
    for piece in (512, 77):
        order = rng.permutation(len(x))
        dealt = np.concatenate([unit.probability(x[order[i : i + piece]]) for i in range(0, len(x), piece)])
        assert (dealt == together[order]).all()


def test_scored_windows_stay_above_zero():
    """A score of 0 is that of rows outside a window."""
    unit = GatedUnit(1, 2, np.zeros(GatedUnit.size(1, 2)))
    unit.parts()[-1][:] = -60.0
    assert 0 < unit.probability(np.ones((1, 3, 1)))[0] < 1e-25
