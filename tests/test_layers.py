"""Two trained layers: gradients through the graph, storage, and a pattern two steps away."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import graph as G
from riskweave.scorers import layers
from riskweave.scorers.layers import LayerModel, TwoLayers
from riskweave.scorers.network import MATRIX


def whole(net, share, x, y, weight):
    """(loss, gradient) on a dense graph; ``share`` holds payee by payer."""
    m1 = share @ x
    m2 = share @ net.states(x, m1)
    back = share.T @ net.slopes(x, m1, m2, y, weight)
    return net.gradient(x, m1, m2, back, y, weight)


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(3)
    share = rng.random((9, 9)) * (rng.random((9, 9)) < 0.4)
    share /= np.maximum(share.sum(1, keepdims=True), 1e-9)
    x, y = rng.normal(size=(9, 3)), (rng.random(9) < 0.4).astype(float)
    net = TwoLayers.fresh(3, 4, 1)
    net.flat += rng.normal(size=len(net.flat)) * 0.1
    _, g = whole(net, share, x, y, 3.0)
    for i in range(len(net.flat)):
        up, down = net.flat.copy(), net.flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (whole(TwoLayers(3, 4, up), share, x, y, 3.0)[0] - whole(TwoLayers(3, 4, down), share, x, y, 3.0)[0]) / 2e-6
        assert g[i] == pytest.approx(slope, abs=1e-5)


@pytest.fixture(scope="module")
def payments(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(500):
        src = "hub" if rnd.random() < 0.33 else f"n{rnd.randrange(40)}"
        dst = f"n{rnd.randrange(40)}"
        rows.append((f"T{i}", src, dst, rnd.uniform(10, 500), int(src in ("n1", "n2", "n3") and rnd.random() < 0.6), i % 2))
    df = spark.createDataFrame(rows, "transaction_id string, sender_account_id string, receiver_account_id string, amount_npr double, is_fraud int, is_cross_border int")
    return df.cache()


@pytest.mark.parametrize("rows_per_task", [5_000_000, 4])
def test_spark_sums_equal_the_dense_graph(payments, rows_per_task):
    graph, _ = layers._laid_out(G.edges(payments), {"hot_key_rows": rows_per_task}, None)
    net = TwoLayers.fresh(len(MATRIX), 5, 2)
    loss, g = layers.loss_and_gradient(graph, net, 4.0)
    accounts = sorted(graph.accounts.collect(), key=lambda r: r.node)
    at = {r.node: i for i, r in enumerate(accounts)}
    share = np.zeros((len(at), len(at)))
    for r in graph.forward.collect():
        share[at[r.dst], at[r.src]] = r.share
    x, m1, y = (np.array([r[c] for r in accounts]) for c in ("x", "m1", "y"))
    m2 = share @ net.states(x, m1)
    want = net.gradient(x, m1, m2, share.T @ net.slopes(x, m1, m2, y, 4.0), y, 4.0)
    assert loss == pytest.approx(want[0], rel=1e-9) and np.abs(g - want[1]).max() < 1e-8


def test_loss_falls_and_storage(spark, payments, tmp_path):
    model = layers.fit_layers(payments, {"graph_max_iter": 8, "graph_hidden_dim": 6})
    assert model.losses[-1] < 0.9 * model.losses[0]
    scores = layers.layer_scores(payments, model)
    model.save(spark, f"{tmp_path}/layers")
    again = layers.layer_scores(payments, LayerModel.load(spark, f"{tmp_path}/layers")).select("node", F.col("node_score").alias("b"))
    n, gap = scores.join(again, "node").agg(F.count("*"), F.max(F.abs(F.col("node_score") - F.col("b")))).first()
    assert n == G.nodes(G.edges(payments)).count() and gap < 1e-9
    assert layers.fit_layers(payments.withColumn("is_fraud", F.lit(0))) is None
