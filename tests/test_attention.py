"""Attention heads over payers: gradients, softmax over split hubs, and a pattern that money weights miss."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import graph as G
from riskweave.scorers import attention
from riskweave.scorers.attention import AttentionModel, HeadLayer


def whole(net, x, y, pairs, weight):
    """(loss, gradient) from pairs (payee, payer, money) sorted by payee."""
    v, u, money = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), np.array([p[2] for p in pairs])
    starts = np.append(0, np.flatnonzero(v[1:] != v[:-1]) + 1)
    top, total, mean = np.zeros((len(x), net.heads)), np.ones((len(x), net.heads)), np.zeros((len(x), net.heads * net.width))
    t, d, s = net.partial(x[u], x[v], money, starts)
    top[v[starts]], total[v[starts]], mean[v[starts]] = t, d, s / np.repeat(d, net.width, 1)
    loss, g, back = net.account_part(x, mean, y, weight)
    return loss, g + net.pair_part(x[u], x[v], money, top[v], total[v], mean[v], back[v])


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(4)
    pairs = sorted((int(v), int(u), float(rng.random() * 3)) for v in range(8) for u in range(8) if rng.random() < 0.4)
    x, y = rng.normal(size=(9, 3)), (rng.random(9) < 0.4).astype(float)
    net = HeadLayer.fresh(3, 2, 3, 1)
    net.flat += rng.normal(size=len(net.flat)) * 0.3
    _, g = whole(net, x, y, pairs, 3.0)
    for i in range(len(net.flat)):
        up, down = net.flat.copy(), net.flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        one, other = (whole(HeadLayer(3, 2, 3, f), x, y, pairs, 3.0)[0] for f in (up, down))
        assert g[i] == pytest.approx((one - other) / 2e-6, abs=2e-5)


def payments(spark, seed):
    """Accounts paid by a payer from abroad commit fraud, however little that payer sends them."""
    rnd = random.Random(seed)
    rows = []
    for i in range(160):
        bad = rnd.random() < 0.3
        for _ in range(4):
            rows.append((f"local{rnd.randrange(30)}", f"m{i}", rnd.uniform(500, 3000), 0, 0))
        rows.append((f"{'abroad' if bad else 'local'}{rnd.randrange(12)}", f"m{i}", rnd.uniform(1, 20), int(bad), 0))
        rows.append((f"m{i}", "shop", rnd.uniform(50, 90), 0, int(bad)))
        rows.append((f"m{i}", f"local{rnd.randrange(30)}", rnd.uniform(50, 90), 0, 0))
    rows = [(f"T{i}", *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(
        rows, "transaction_id string, sender_account_id string, receiver_account_id string, amount_npr double, is_cross_border int, is_fraud int"
    ).cache()


# Not the columns that hold the label itself.
COLUMNS = ("in_degree", "in_amount_mean_log", "cross_border_fraction", "fan_out_ratio")


@pytest.mark.parametrize("rows_per_task", [5_000_000, 7])
def test_spark_sums_equal_one_array(spark, rows_per_task):
    graph, _ = attention._laid_out(G.edges(payments(spark, 1)), COLUMNS, {"hot_key_rows": rows_per_task}, None)
    net = HeadLayer.fresh(len(COLUMNS), 4, 3, 2)
    net.flat += np.random.default_rng(5).normal(size=len(net.flat)) * 0.2
    loss, g = attention.loss_and_gradient(graph, net, 2.0)
    accounts = sorted(graph.accounts.collect(), key=lambda r: r.node)
    at = {r.node: i for i, r in enumerate(accounts)}
    pairs = sorted((at[r.src], at[r.dst], r.money) for r in graph.pairs.collect())
    want = whole(net, np.array([r.x for r in accounts]), np.array([r.y for r in accounts]), pairs, 2.0)
    assert loss == pytest.approx(want[0], rel=1e-9)
    assert np.abs(g - want[1]).max() < 1e-8


def auc(rows):
    good, bad = [r[0] for r in rows if not r[1]], [r[0] for r in rows if r[1]]
    return sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))


def test_learned_weights_beat_money_on_other_payments(spark, tmp_path):
    train, later = payments(spark, 2), payments(spark, 3)
    settings = {"graph_max_iter": 15, "graph_learning_rate": 0.08}
    truth = G.node_features(G.edges(later)).filter("node LIKE 'm%'").select("node", "label")
    found = {}
    for learned in (True, False):
        model = attention.fit_attention(train, settings, COLUMNS, learn_weights=learned)
        assert model.losses[-1] < model.losses[0]
        scored = attention.attention_scores(later, model).join(truth, "node").select("node_score", "label").collect()
        found[learned] = auc([(r[0], r[1]) for r in scored])
        if learned:
            kept = model
    assert found[True] > found[False] + 0.05 and found[True] > 0.9
    sums = attention.attention_weights(later, kept, {"hot_key_rows": 7}).groupBy("payee").agg(
        *[F.sum(f"head_{k}").alias(f"s{k}") for k in range(4)]
    )
    assert all(abs(r[f"s{k}"] - 1) < 1e-9 for r in sums.collect() for k in range(4))
    kept.save(spark, f"{tmp_path}/heads")
    again = AttentionModel.load(spark, f"{tmp_path}/heads")
    assert np.array_equal(again.net.flat, kept.net.flat) and again.columns == list(COLUMNS)
    assert attention.fit_attention(train.withColumn("is_fraud", F.lit(0)), settings, COLUMNS) is None


def test_few_numbers_of_a_payee_go_to_its_pairs(spark, monkeypatch):
    """A round joins to every pair two numbers a head and the slopes of its payee, and the sums stay the same."""
    graph, _ = attention._laid_out(G.edges(payments(spark, 2)), COLUMNS, None, None)
    net, sent = HeadLayer.fresh(len(COLUMNS), 4, 3, 2), []
    to_parts = attention._Graph.to_parts
    monkeypatch.setattr(attention._Graph, "to_parts", lambda self, states, names: sent.append(len(names)) or to_parts(self, states, names))
    _, g = attention.loss_and_gradient(graph, net, 2.0)
    assert sent == [2 * 4 + 4 * 3] and np.isfinite(g).all()
