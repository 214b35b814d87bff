"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries are turned into whole numbers floor(64 * c) + 1000000. Their sums are exact,
and every product below starts from exactly centred entries, so the offset costs
no digits. The covariance V is never formed. A block of K wanted and some guard
vectors, a (dimension x block) matrix on the driver, is multiplied by it in one pass
over the rows: each task adds up its part of Xt (X Q), Spark adds the parts by
row, and a matrix of that same bounded size comes back.

A round multiplies the block by a Chebyshev polynomial of V, one pass per degree, that
stays within 1 on the unwanted part of the spectrum (from the lower edge, estimated
by Lanczos steps, to the least Ritz value of the block) and grows fast above it;
then QR and Rayleigh-Ritz. The degree is bounded so that the first eigenvector does not
drown the others. It ends when certified: every wanted pair has
|V q - e q| <= TOLERANCE * e_1 (more only where rounding in many dimensions asks for it), and power steps on fresh vectors orthogonal to the
block find nothing above the last wanted eigenvalue. A block that does not get there in
ROUNDS rounds is doubled, at last to the whole space, where Rayleigh-Ritz is exact.

Defined cases: a null vector, or one with a null, NaN or infinite entry, or
one whose number fits into no long, takes no part; shorter vectors count as filled
up with zeros (empty ones too); rows that repeat an id or a vector count one by one, a null
id stays null; eigenvalues not above LEAST * e_1 cannot be told from rounding and
are no components, so fewer than 33 different vectors, or equal ones, give fewer
components or none; a deviation beyond the range of long is null; no vectors, no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import stored

K, SCALE, OFFSET = 32, 64, 1_000_000
TOLERANCE, LEAST, ROUNDS, EDGE_STEPS, PROBES, PROBE_STEPS = 2e-14, 4e-12, 12, 12, 4, 3
#: Growth of the first eigenvector against the unwanted ones that one filter may bring, and its highest degree.
MAX_GROWTH, MAX_DEGREE = 1e12, 20
#: Entries of the pieces in which a task handles its rows.
_PIECE = 1 << 20


def prepared(df: DataFrame, vector: str = "embedding", row_id: str = "vec_id") -> DataFrame:
    """(vec_id, y): whole numbers without the offset, of the rows that take part."""
    scaled = F.transform(vector, lambda c: c.cast("double") * SCALE)
    rows = df.select(F.col(row_id).alias("vec_id"), scaled.alias("_c"))
    # A null entry makes forall null, so the row goes; NaN is greater than any number.
    fits = F.forall("_c", lambda c: c.isNotNull() & (F.abs(c) < float(1 << 62)))
    return rows.filter(fits).select("vec_id", F.transform("_c", lambda c: F.floor(c).cast("bigint")).alias("y"))


def _pieces(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Record batches in pieces of bounded size, with their vectors as rows of a matrix."""
    rows = max(1, _PIECE // max(dim, 1))
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            piece = batch.slice(start, rows)
            lists = piece.column(piece.schema.get_field_index("y"))
            lengths = lists.value_lengths().to_numpy()
            flat = lists.flatten().to_numpy()
            if (lengths == dim).all():
                yield piece, flat.reshape(-1, dim)
                continue
            full = np.zeros((len(lengths), dim), np.int64)
            full[np.arange(dim)[None, :] < lengths[:, None]] = flat
            yield piece, full


def _totals(rows: DataFrame, dim: int) -> list[int]:
    """Exact sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dim
        for _, y in _pieces(batches, dim):
            small = len(y) * int(np.abs(y).max(initial=0)) < 1 << 62
            sums = y.sum(0) if small else y.astype(object).sum(0)
            total = [a + int(b) for a, b in zip(total, sums, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dim), pa.int32()), pa.array(list(map(str, total)), pa.string())], names=["i", "s"]
        )

    parts = rows.select("y").mapInArrow(run, "i int, s string")
    found = parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # dim rows
    out = [0] * dim
    for r in found:
        out[r["i"]] = int(r["s"])
    return out


@dataclass
class Centre:
    """Row count and exact sums of the fit list."""

    n: int
    sums: list[int]

    def __post_init__(self):
        self.whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        self.rest = np.array([(s % self.n) / self.n for s in self.sums])

    def centred(self, y: np.ndarray) -> np.ndarray:
        return (y - self.whole).astype(np.float64) - self.rest

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * y - sum)^2, exact."""
        sums = np.array(self.sums, dtype=object)
        far = self.n * int(np.abs(y).max(initial=0)) + max((abs(s) for s in self.sums), default=0)
        if far < 1 << 31 and len(self.sums) * far * far < 1 << 62:
            gaps = self.n * y - sums.astype(np.int64)
            return (gaps**2).sum(1).tolist()
        exact = [int(v) for v in ((self.n * y.astype(object) - sums) ** 2).sum(1)]
        return [v if v < 1 << 63 else None for v in exact]


def _summed(rows: DataFrame, dim: int, partial: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Sum over all rows of a matrix of the given shape that ``partial`` makes of a piece of them.

    The only thing that comes to the driver is that matrix: its size depends on the
    dimension and the block, not on the rows.
    """
    height, width = shape
    names = [f"c{j}" for j in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, y in _pieces(batches, dim):
            total += partial(y)
        columns = [pa.array(np.arange(height, dtype=np.int32)), *[pa.array(total[:, j]) for j in range(width)]]
        yield pa.RecordBatch.from_arrays(columns, names=["i", *names])

    parts = rows.select("y").mapInArrow(run, "i int, " + ", ".join(f"{c} double" for c in names))
    table = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    out = np.zeros(shape)
    out[table["i"].to_numpy()] = np.stack([table[c].to_numpy() for c in names], 1)
    return out


def _orthonormal(block: np.ndarray) -> np.ndarray:
    # Twice: the first pass may leave columns that cancelled with few right digits.
    return np.linalg.qr(np.linalg.qr(block)[0])[0]


def _ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values in falling order, their vectors, and V times these."""
    h = q.T @ vq
    values, u = np.linalg.eigh((h + h.T) / 2)
    u = u[:, ::-1]
    return values[::-1], q @ u, vq @ u


def lower_edge(product: Callable, dim: int, rng: np.random.Generator) -> float:
    """Estimate of the least eigenvalue by Lanczos steps with full orthogonalisation, not below 0."""
    basis = [_orthonormal(rng.normal(size=(dim, 1)))]
    diagonal, off = [], []
    for _ in range(min(dim, EDGE_STEPS)):
        w = product(basis[-1])
        diagonal.append(float((basis[-1].T @ w)[0, 0]))
        q = np.hstack(basis)
        for _ in range(2):
            w = w - q @ (q.T @ w)
        off.append(float(np.linalg.norm(w)))
        if off[-1] <= 1e-12 * max(map(abs, diagonal)):
            break
        basis.append(w / off[-1])
    inner = off[: len(diagonal) - 1]
    values, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(inner, 1) + np.diag(inner, -1))
    return max(0.0, float(values[0] - off[-1] * abs(vectors[-1, 0])))


def chebyshev(product: Callable, q: np.ndarray, vq: np.ndarray, low: float, high: float, top: float) -> np.ndarray:
    """Polynomial of V times ``q``: within 1 on [low, high], growing above it; scaled to 1 at ``top``."""
    high = max(high, low + 1e-9 * (top - low))
    half, middle = (high - low) / 2, (high + low) / 2
    reach = max((top - middle) / half, 1.0 + 1e-12)
    degree = int(min(MAX_DEGREE, max(2, np.log(2 * MAX_GROWTH) / np.arccosh(reach))))
    first = sigma = 1 / reach
    before, now = q, (vq - middle * q) * (sigma / half)
    for _ in range(degree - 1):
        fresh = 1 / (2 / first - sigma)
        before, now = now, (product(now) - middle * now) * (2 * fresh / half) - sigma * fresh * before
        sigma = fresh
    return now


def eigenpairs(product: Callable, dim: int, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Certified (eigenvalues in falling order, eigenvectors as columns) of the first min(k, dim)."""
    rng = np.random.default_rng(seed)
    k = min(k, dim)
    block = min(dim, k + max(8, k // 4))
    q, low, rounds = _orthonormal(rng.normal(size=(dim, block))), None, 0
    tolerance = max(TOLERANCE, 4 * np.finfo(float).eps * dim**0.5)
    while True:
        values, q, vq = _ritz(q, product(q))
        if values[0] <= 0:
            return values[:0], q[:, :0]
        errors = np.linalg.norm(vq - q * values, axis=0)[:k]
        if block == dim:
            return values[:k], q[:, :k]
        fresh = np.zeros((dim, 0))
        if errors.max() <= tolerance * values[0]:
            greatest, fresh = _probe(product, q, rng)
            if greatest <= values[k - 1] + tolerance * values[0]:
                return values[:k], q[:, :k]
        rounds += 1
        if rounds % ROUNDS == 0:
            more = min(dim, 2 * block) - block
            fresh = np.hstack([fresh, rng.normal(size=(dim, more))])[:, :more]
        if fresh.shape[1]:
            block = min(dim, block + fresh.shape[1])
            q = _orthonormal(np.hstack([q, fresh])[:, :block])
            continue
        low = lower_edge(product, dim, rng) if low is None else low
        q = _orthonormal(chebyshev(product, q, vq, low, values[-1], values[0]))


def _probe(product: Callable, q: np.ndarray, rng: np.random.Generator) -> tuple[float, np.ndarray]:
    """Greatest Ritz value that power steps find orthogonal to ``q``, and the vectors."""
    inside = lambda w: w - q @ (q.T @ w)
    p = _orthonormal(inside(rng.normal(size=(len(q), min(PROBES, len(q) - q.shape[1])))))
    for _ in range(PROBE_STEPS):
        p = _orthonormal(inside(product(p)))
    values, p, _ = _ritz(p, product(p))
    return float(values[0]), p


@dataclass
class Whitening:
    """Fitted whitening: centre, eigenvalues and components (columns), and trace of the covariance."""

    centre: Centre
    dim: int
    values: np.ndarray
    components: np.ndarray
    trace: float

    def project(self, y: np.ndarray) -> np.ndarray:
        return self.centre.centred(y) @ (self.components / np.sqrt(self.values))

    def identity_error(self, rows: DataFrame) -> float:
        """Largest absolute entry of the covariance of the whitened rows less the identity."""
        k = len(self.values)

        def partial(y: np.ndarray) -> np.ndarray:
            w = np.hstack([self.project(y), np.ones((len(y), 1))])
            return w.T @ w

        m = _summed(rows, self.dim, partial, (k + 1, k + 1)) / self.centre.n
        mean = m[:k, k]
        return float(np.abs(m[:k, :k] - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))

    def transform(self, rows: DataFrame) -> DataFrame:
        """(vec_id, deviation, whitened: one double per component) of ``prepared`` rows."""
        k, types = len(self.values), rows.schema["vec_id"].dataType

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece, y in _pieces(batches, self.dim):
                white = self.project(y)
                offsets = pa.array(np.arange(len(y) + 1, dtype=np.int32) * k)
                lists = pa.ListArray.from_arrays(offsets, pa.array(white.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("vec_id"), pa.array(self.centre.deviations(y), pa.int64()), lists],
                    names=["vec_id", "deviation", "whitened"],
                )

        return rows.mapInArrow(run, f"vec_id {types.simpleString()}, deviation bigint, whitened array<double>")


def fit(rows: DataFrame, k: int = K, seed: int = 0) -> Whitening | None:
    """Fit on all ``prepared`` rows, stored; None without rows or entries."""
    n, dim = rows.agg(F.count("*"), F.max(F.size("y"))).first()
    if not n or not dim:
        return None
    centre = Centre(n, _totals(rows, dim))

    def product(q: np.ndarray) -> np.ndarray:
        def partial(y: np.ndarray) -> np.ndarray:
            x = centre.centred(y)
            return x.T @ (x @ q)

        return _summed(rows, dim, partial, q.shape) / n

    squares = _summed(rows, dim, lambda y: (centre.centred(y) ** 2).sum(0)[:, None], (dim, 1))
    values, components = eigenpairs(product, dim, k, seed)
    real = values > LEAST * values[0] if len(values) else np.zeros(0, bool)
    return Whitening(centre, dim, values[real], components[:, real], float(squares.sum() / n))


def whiten(vectors: DataFrame, k: int = K) -> tuple[Whitening | None, DataFrame]:
    """(fitted whitening, (vec_id, deviation, whitened) of every row that takes part)."""
    rows = stored(prepared(vectors), "whitening-rows")
    model = fit(rows, k)
    if model is None or not len(model.values):
        empty = F.array().cast("array<double>")
        return None, rows.select("vec_id", F.lit(0).cast("bigint").alias("deviation"), empty.alias("whitened")).limit(0)
    return model, model.transform(rows)


def digest(vectors: DataFrame) -> DataFrame:
    rows = stored(prepared(vectors), "whitening-rows")
    model = fit(rows)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    if model is None or not len(model.values):
        schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        return rows.sparkSession.createDataFrame([], schema)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    long = model.transform(rows).select("vec_id", "deviation", F.posexplode("whitened").alias("_k", "whitened"))
    return long.select(
        "vec_id", (F.col("_k") + 1).alias("component"), F.lit(model.centre.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("_k")).alias("explained"), F.lit(model.identity_error(rows)).alias("identity_error"),
    ).select(*names)
