"""Core numbers and dense communities against plain peeling."""

import random

import pytest

from riskweave.operators import communities as C


def edges_of(spark, pairs):
    rows = [(f"T{i}", a, b) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "transaction_id string, src string, dst string")


def plain_links(pairs, least=1):
    count = {}
    for a, b in pairs:
        if a != b:
            key = (min(a, b), max(a, b))
            count[key] = count.get(key, 0) + 1
    near = {n: set() for p in pairs for n in p}
    for (a, b), n in count.items():
        if n >= least:
            near[a].add(b)
            near[b].add(a)
    return near


def plain_cores(near):
    left, out, k = {n: set(v) for n, v in near.items()}, {}, 0
    while left:
        node = min(left, key=lambda n: len(left[n]))
        k = max(k, len(left[node]))
        out[node] = k
        for other in left.pop(node):
            left[other].discard(node)
    return out


def plain_groups(near, members):
    label = {n: n for n in members}
    for _ in members:
        for n in members:
            label[n] = min([label[n], *(label[o] for o in near[n] if o in members)])
    return label


@pytest.fixture(scope="module")
def cliques():
    """60 cliques of five accounts in a chain, a tail that peels one account at a time, and accounts on their own."""
    pairs = []
    for c in range(60):
        ids = [f"c{c:02d}{x}" for x in "abcde"]
        pairs += [(ids[i], ids[j]) for i in range(5) for j in range(i)]
        pairs.append((ids[4], f"c{c + 1:02d}a" if c < 59 else "t00"))
    pairs += [(f"t{i:02d}", f"t{i + 1:02d}") for i in range(12)]
    return [*pairs, ("alone", "alone")]


@pytest.mark.parametrize("rows_per_task", [5_000_000, 3])
def test_chain_of_cliques(spark, cliques, rows_per_task):
    got = {r.node: r.core for r in C.core_numbers(edges_of(spark, cliques), rows_per_task=rows_per_task).collect()}
    assert got == plain_cores(plain_links(cliques))
    assert got["c30a"] == 4 and got["t05"] == 1 and got["alone"] == 0


def test_hub_with_a_third_of_the_links_and_repeated_payments(spark):
    rnd = random.Random(4)
    pairs = [("hub", f"n{i}") if rnd.random() < 0.5 else (f"n{i}", "hub") for i in range(120)]
    pairs += [(f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for _ in range(240)]
    pairs += [p for p in pairs if rnd.random() < 0.4]
    e = edges_of(spark, pairs)
    assert {r.node: r.core for r in C.core_numbers(e, rows_per_task=10).collect()} == plain_cores(plain_links(pairs))
    near = plain_links(pairs, 2)
    cores = plain_cores(near)
    members = {n for n, k in cores.items() if k >= 2}
    got = {r.node: (r.core, r.community) for r in C.dense_communities(e, 2, 2, rows_per_task=10).collect()}
    assert got == {n: (cores[n], g) for n, g in plain_groups(near, members).items()}


def test_separate_communities(spark):
    pairs = [(f"{g}{i}", f"{g}{j}") for g in "xy" for i in range(4) for j in range(i)] + [("x0", "z"), ("z", "y0")]
    got = {r.node: r.community for r in C.dense_communities(edges_of(spark, pairs), 3).collect()}
    assert got == {f"{g}{i}": f"{g}0" for g in "xy" for i in range(4)}


def test_no_payments(spark):
    e = edges_of(spark, [])
    assert C.core_numbers(e).count() == 0
    assert C.dense_communities(e, 1).count() == 0


def test_rounds_do_not_grow_with_the_core_numbers(spark, monkeypatch):
    """Cliques of 2 to 15 accounts: each is settled at once, whatever its number."""
    pairs = [(f"{n}-{i}", f"{n}-{j}") for n in range(2, 16) for i in range(n) for j in range(i)]
    calls, real = [], C.cut
    monkeypatch.setattr(C, "cut", lambda *a, **k: calls.append(1) or real(*a, **k))
    got = {r.node: r.core for r in C.core_numbers(edges_of(spark, pairs)).collect()}
    assert got == {f"{n}-{i}": n - 1 for n in range(2, 16) for i in range(n)}
    assert len(calls) <= 4
