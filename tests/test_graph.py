"""Graph operators against plain Python on small graphs with a hub."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from riskweave.operators import graph as G
from riskweave.operators.patterns import payment_chains
from riskweave.plans.catalog import ORACLES, QUERIES
from riskweave.scorers import network

HOUR = 3_600_000_000


@pytest.fixture(scope="module")
def raw():
    rnd = random.Random(11)
    rows = []
    for i in range(160):
        # A hub takes part in a third of all payments.
        src = "hub" if rnd.random() < 0.2 else f"n{rnd.randrange(14)}"
        dst = "hub" if rnd.random() < 0.15 else f"n{rnd.randrange(18)}"
        rows.append((f"T{i:03d}", src, dst, float(rnd.randrange(1, 500)), rnd.randrange(0, 96) * HOUR // 2))
    rows += [("X1", "p", "q", 5.0, 0), ("X2", "q", "r", 5.0, HOUR)]
    return rows


@pytest.fixture(scope="module")
def edges(spark, raw):
    df = spark.createDataFrame(raw, "transaction_id string, src string, dst string, amount double, ts bigint")
    return df.withColumn("cross", F.lit(0.0)).withColumn("fraud", F.lit(0.0)).cache()


def plain_pagerank(pairs, nodes, rounds):
    out = {n: {d for s, d in pairs if s == n} for n in nodes}
    pr = {n: 1 / len(nodes) for n in nodes}
    for _ in range(rounds):
        dangling = sum(pr[n] for n in nodes if not out[n])
        new = {n: 0.15 / len(nodes) + 0.85 * dangling / len(nodes) for n in nodes}
        for n in nodes:
            for d in out[n]:
                new[d] += 0.85 * pr[n] / len(out[n])
        pr = new
    return pr


@pytest.mark.parametrize("rows_per_task", [5_000_000, 4])
def test_pagerank(edges, raw, rows_per_task):
    pairs = {(r[1], r[2]) for r in raw}
    nodes = {n for p in pairs for n in p}
    got = {r["node"]: r["pagerank"] for r in G.pagerank(edges, max_iter=6, tol=0.0, rows_per_task=rows_per_task).collect()}
    want = plain_pagerank(pairs, nodes, 6)
    assert got.keys() == want.keys()
    assert all(got[n] == pytest.approx(want[n], abs=1e-12) for n in nodes)


def test_pagerank_stops_when_it_converges(edges):
    total, n = G.pagerank(edges).agg(F.sum("pagerank"), F.count("*")).first()
    assert total == pytest.approx(1.0)
    assert n == G.nodes(edges).count()


def test_components(edges, raw):
    label = {n: n for r in raw for n in r[1:3]}
    for _ in label:
        for _, s, d, *_ in raw:
            label[s] = label[d] = min(label[s], label[d])
    got = {r["node"]: r["component"] for r in G.components(edges).collect()}
    assert got == label
    assert len(set(got.values())) > 1


def test_long_path_is_one_component_in_few_rounds(spark, monkeypatch):
    rounds = []
    keep = G.materialise
    monkeypatch.setattr(G, "materialise", lambda df, label: rounds.append(1) or keep(df, label))
    order = [0, *range(300, 0, -1)]  # the least id sits at one end, the next at the other
    path = [(f"T{i}", f"v{a:03d}", f"v{b:03d}") for i, (a, b) in enumerate(zip(order, order[1:]))]
    e = spark.createDataFrame(path, "transaction_id string, src string, dst string")
    assert {r["component"] for r in G.components(e).collect()} == {"v000"}
    assert len(rounds) < 20


def test_cycles_and_triangles(edges, raw):
    pairs = {(r[1], r[2]) for r in raw if r[1] != r[2]}
    nodes = sorted({n for p in pairs for n in p})
    cycles = {
        (a, b, c)
        for a, b, c in itertools.permutations(nodes, 3)
        if a < b and a < c and {(a, b), (b, c), (c, a)} <= pairs
    }
    rows = G.payment_cycles(edges).collect()
    assert len(rows) == len(cycles)
    assert {(r["x"], r["y"], r["z"]) for r in rows} == cycles
    linked = {frozenset(p) for p in pairs}
    count = dict.fromkeys({n for r in raw for n in r[1:3]}, 0)
    for t in itertools.combinations(nodes, 3):
        if all(frozenset(p) in linked for p in itertools.combinations(t, 2)):
            for n in t:
                count[n] += 1
    assert {r["node"]: r["triangles"] for r in G.triangle_counts(edges).collect()} == count


@pytest.mark.parametrize("dense_rows", [20_000, 10])
def test_chains(edges, raw, dense_rows):
    span = 12 * HOUR
    moves = [r for r in raw if r[1] != r[2]]
    got = {r["transaction_id"]: r for r in payment_chains(edges, 12, dense_rows).collect()}
    assert len(got) == len(moves)
    for tid, b, c, _, t in moves:
        up = sum(1 for m in moves if m[2] == b and m[1] != c and t - span <= m[4] < t)
        down = sum(1 for m in moves if m[1] == c and m[2] != b and t < m[4] <= t + span)
        assert (got[tid]["upstream"], got[tid]["downstream"], got[tid]["chains"]) == (up, down, up * down)


@pytest.mark.parametrize("rows_per_task", [5_000_000, 4])
def test_neighbour_means(edges, raw, rows_per_task):
    feats = G.node_features(edges)
    deg = {n: sum(1 for r in raw if r[1] == n) for r in raw for n in r[1:3]}
    out = G.neighbour_means(G.pair_weights(edges), feats, ["out_degree"], rows_per_task).collect()
    for row in out:
        inn = [deg[r[1]] for r in raw if r[2] == row["node"]]
        assert row["nbr_out_degree"] == pytest.approx(sum(inn) / len(inn) if inn else 0.0)


def test_fan_patterns(edges, raw):
    hub = G.fan_patterns(edges, 3).filter("node = 'hub'").first()
    assert hub["receivers"] == len({r[2] for r in raw if r[1] == "hub"})
    assert hub["senders"] == len({r[1] for r in raw if r[2] == "hub"})
    assert (hub["fan_out"], hub["fan_in"]) == (1, 1)


def test_unknown_account_takes_the_mean_score(spark):
    scores = spark.createDataFrame([("a", 0.2, 1.0), ("b", 0.6, 1.0)], "node string, node_score double, out_degree double")
    t = spark.createDataFrame([("1", "a"), ("2", "zz"), ("3", None)], "transaction_id string, sender_account_id string")
    got = {r["transaction_id"]: r["node_score"] for r in network.map_to_transactions(t, scores).collect()}
    assert got == {"1": 0.2, "2": pytest.approx(0.4), "3": pytest.approx(0.4)}


def test_few_fraud_nodes_keep_the_heuristic(spark, raw):
    t = spark.createDataFrame(
        [(r[0], r[1], r[2], r[3], 0) for r in raw],
        "transaction_id string, sender_account_id string, receiver_account_id string, amount_npr double, is_fraud int",
    )
    model, scores = network.fit(t)
    assert model is None
    assert scores.filter(~F.col("node_score").between(0, 1)).count() == 0


def test_node_model_round_trip(spark, sf_dir, tmp_path):
    from riskweave.plans.views import tx

    t = tx(spark, sf_dir)
    model, scores = network.fit(t)
    model.save(spark, f"{tmp_path}/node")
    loaded = network.NodeModel.load(spark, f"{tmp_path}/node")
    e = G.edges(t)
    hops = network.hop_features(e, network.node_matrix(e), weight=loaded.weight)
    again = network.node_scores(hops, loaded).select("node", F.col("node_score").alias("b"))
    gap = scores.join(again, "node").agg(F.max(F.abs(F.col("node_score") - F.col("b"))), F.count("*")).first()
    assert gap[0] < 1e-6 and gap[1] == scores.count()


def test_a_query_checks_pagerank_run_to_its_own_stop(spark, sf_dir):
    done = {r.node: r.pagerank for r in QUERIES["g8_pagerank_converged"](spark, sf_dir).collect()}
    assert "g8_pagerank_converged" in ORACLES and sum(done.values()) == pytest.approx(1.0, abs=1e-6)
