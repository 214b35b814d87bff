"""Whitening against a dense eigendecomposition."""

import math

import numpy as np
import pytest

from riskweave.llm import whitening


def plain(rows, k=32):
    """(x as integers, eigenvalues, eigenvectors, trace) of the rows that take part."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) and abs(c) < 2.0**56 for c in v)]
    dim = max((len(v) for _, v in good), default=0)
    xs = [[math.floor(64 * float(c)) + 1_000_000 for c in [*v, *[0.0] * (dim - len(v))]] for _, v in good]
    n = len(xs)
    sums = [sum(x[j] for x in xs) for j in range(dim)]
    deviations = [sum((n * x[j] - sums[j]) ** 2 for j in range(dim)) for x in xs]
    centred = np.array([[(n * x[j] - sums[j]) / n for j in range(dim)] for x in xs]).reshape(n, dim)
    v = centred.T @ centred / max(n, 1)
    values, vectors = np.linalg.eigh(v)
    return [i for i, _ in good], n, deviations, centred, values[::-1][:k], vectors[:, ::-1][:, :k], v


def check(spark, rows, schema="vec_id long, embedding array<float>", parts=5):
    df = spark.createDataFrame(rows, schema).repartition(parts)
    got = whitening.digest(df).collect()
    # As the table holds them: single precision where the column is.
    ids, n, deviations, centred, values, vectors, v = plain([(r.vec_id, r.embedding) for r in df.collect()])
    k = int((values > 1e-11 * max(values[0], 1e-300)).sum()) if len(values) and values[0] > 0 else 0
    assert len(got) == n * k
    if not k:
        return
    table = {}
    for r in got:
        assert r.n == n and r.identity_error < 1e-9
        assert abs(r.explained - values[r.component - 1] / np.trace(v)) < 1e-9
        table.setdefault((r.vec_id, r.deviation), []).append((r.component, r.whitened))
    assert sorted(d for i, d in table for _ in range(len(table[i, d]) // k)) == sorted(deviations)
    white = centred @ vectors[:, :k] / np.sqrt(values[:k])
    gaps = [min([abs(values[j] - e) for m, e in enumerate(np.linalg.eigvalsh(v)[::-1]) if m != j] or [1.0]) for j in range(k)]
    want = {}
    for row, i in enumerate(ids):
        want.setdefault((i, deviations[row]), white[row])
    for j in range(k):
        if gaps[j] < 1e-6 * values[0]:
            continue  # equal eigenvalues: any basis of their space
        mine = {key: w for key, found in table.items() for c, w in found if c == j + 1}
        sign = np.sign(sum(mine[key] * want[key][j] for key in mine))
        assert max(abs(mine[key] * sign - want[key][j]) for key in mine) < 1e-8


def test_more_dimensions_than_the_block_holds(spark):
    rng = np.random.default_rng(2)
    scale = np.linspace(3, 0.2, 70)
    check(spark, [(i, (rng.normal(size=70) * scale).tolist()) for i in range(900)])


def test_embeddings(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(spark, rows)


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    rows += [(60, None), (61, [1.0, None] * 4), (62, [float("nan")] * 8), (63, [float("inf")] * 8), (64, [1e300] * 8)]
    rows += [(65, [0.5, -0.25]), (66, []), (None, [1.0] * 8), (5, rows[5][1]), (5, [2.0] * 8)]
    check(spark, rows, "vec_id long, embedding array<double>")


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [1.0]), (2, [3.0])]])
def test_little(spark, rows):
    check(spark, rows)


def test_few_rows_and_equal_eigenvalues(spark):
    check(spark, [(i, [1.0 if j == i else 0.0 for j in range(50)]) for i in range(20)])


def test_a_third_of_one_vector_and_clashing_columns(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=45).tolist() if i % 3 else [0.5] * 45, i, "c", 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n long, y string, _c double")
    got = whitening.digest(df).collect()
    assert len(got) == 300 * 32 and {r.n for r in got} == {300}
    check(spark, [r[:2] for r in rows])


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(2**40 + i), float(i * i)]) for i in range(40)]
    check(spark, rows, "vec_id long, embedding array<double>")
    centre = whitening.Centre(3, [2**60, 5, -7])
    y = np.array([[2**59, 1, 1], [0, 0, 0]], dtype=np.int64)
    assert centre.deviations(y) == [None, None]


def solve(matrix, k=32):
    values, vectors = whitening.eigenpairs(lambda q: matrix @ q, len(matrix), k)
    true = np.linalg.eigvalsh(matrix)[::-1]
    assert np.abs(values - true[: len(values)]).max(initial=0) <= 1e-12 * true[0]
    assert np.linalg.norm(matrix @ vectors - vectors * values, axis=0).max(initial=0) <= 1e-12 * true[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max(initial=0) < 1e-12


@pytest.mark.parametrize("spectrum", ["decay", "flat", "one far above", "all equal", "low rank", "pairs"])
def test_solver(spectrum):
    rng = np.random.default_rng(5)
    e = {
        "decay": 0.9 ** np.arange(200.0), "flat": np.linspace(2, 1, 200), "one far above": np.r_[1e6, np.linspace(2, 1, 199)],
        "all equal": np.ones(200), "low rank": np.r_[np.linspace(5, 1, 20), np.zeros(180)], "pairs": np.repeat(np.linspace(3, 1, 100), 2),
    }[spectrum]
    o = np.linalg.qr(rng.normal(size=(200, 200)))[0]
    a = (o * e) @ o.T
    solve((a + a.T) / 2)


def test_filter_grows_above_the_edge_only():
    e = np.linspace(0, 1, 101)
    out = whitening.chebyshev(lambda q: e[:, None] * q, np.ones((101, 1)), e[:, None], 0.0, 0.5, 1.0)[:, 0]
    assert abs(out[-1] - 1) < 1e-9 and np.abs(out[e <= 0.5]).max() < 1e-9 and (np.diff(out[e > 0.5]) > 0).all()
