"""Cycles in time against all triples of payments."""

import random

import pytest

from riskweave.operators.timecycles import _turning, cycle_counts, time_cycles

HOUR = 3_600_000_000


def edges_of(spark, rows):
    named = [(f"T{i}", *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(named, "transaction_id string, src string, dst string, ts bigint").repartition(5)


def plain(rows, hours):
    span, out = hours * HOUR, {}
    good = [r for r in rows if r[2] is not None and r[0] != r[1]]
    by_source = {}
    for r in good:
        by_source.setdefault(r[0], []).append(r)
    for a in good:
        for b in by_source.get(a[1], []):
            if a[2] < b[2] <= a[2] + span:
                for c in by_source.get(b[1], []):
                    if c[1] == a[0] and b[2] < c[2] <= a[2] + span:
                        key = (a[0], b[0], c[0])
                        out[key] = out.get(key, 0) + 1
    return out


def found(df):
    out = {}
    for r in df.collect():
        key = (r.x, r.y, r.z)
        out[key] = out.get(key, 0) + r.cycles
    return out


def test_hub_busy_pair_and_ties(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(900):
        kind = rnd.random()
        if kind < 0.33:  # a hub takes part in a third of all payments
            src, dst = ("hub", f"n{rnd.randrange(12)}") if rnd.random() < 0.5 else (f"n{rnd.randrange(12)}", "hub")
        elif kind < 0.6:  # one pair has a quarter of them
            src, dst = ("n0", "n1") if rnd.random() < 0.7 else ("n1", "n0")
        else:
            src, dst = f"n{rnd.randrange(12)}", f"n{rnd.randrange(12)}"
        rows.append((src, dst, rnd.randrange(-20, 60) * HOUR // 2))
    rows += [("n1", "hub", None), ("n3", "n3", 5)]
    want = plain(rows, 5)
    assert sum(want.values()) > 1000
    e = edges_of(spark, rows)
    assert found(cycle_counts(e, 5)) == want
    by_node = {r.node: (r.started, r.passed) for r in time_cycles(e, 5).collect()}
    assert by_node == {
        n: (sum(v for k, v in want.items() if k[0] == n), sum(v for k, v in want.items() if n in k[1:]))
        for n in {x for r in rows for x in r[:2]}
    }


@pytest.mark.parametrize(
    "times, count",
    [((0, 1, 2 * HOUR), 1), ((0, 1, 2 * HOUR + 1), 0), ((0, 0, 1), 0), ((0, 1, 1), 0), ((2, 1, 0), 0), ((-HOUR, -1, HOUR), 1), ((2 * HOUR - 1, 2 * HOUR, 4 * HOUR - 1), 1)],
)
def test_edges_of_the_window(spark, times, count):
    rows = [("a", "b", times[0]), ("b", "c", times[1]), ("c", "a", times[2])]
    assert found(cycle_counts(edges_of(spark, rows), 2)).get(("a", "b", "c"), 0) == count


def test_no_payments_and_no_cycles(spark):
    assert time_cycles(edges_of(spark, []), 24).count() == 0
    got = time_cycles(edges_of(spark, [("a", "b", 0), ("b", "a", 1)]), 24).collect()
    assert {(r.node, r.started, r.passed) for r in got} == {("a", 0, 0), ("b", 0, 0)}


def test_accounts_that_only_pay_or_only_are_paid_stay_out(spark):
    """Payments that can be on no cycle are gone before any is spread over time cells."""
    rows = [("a", "b", 1), ("b", "c", 2), ("c", "a", 3), ("a", "a", 4), (None, "a", 5)]
    rows += [(f"payer{i}", "a", 10 + i) for i in range(50)] + [("b", f"payee{i}", 10 + i) for i in range(50)] + [("c", "a", None)]
    e = spark.createDataFrame(rows, "src string, dst string, ts long").filter("src is not null")
    assert sorted(map(tuple, _turning(e).collect())) == [("a", "b", 1), ("b", "c", 2), ("c", "a", 3)]
    counted = {r.node: (r.started, r.passed) for r in time_cycles(e, 1).collect()}
    assert len(counted) == 103 and {n: v for n, v in counted.items() if any(v)} == {"a": (1, 0), "b": (0, 1), "c": (0, 1)}
