"""Exact top-k by inner product with a pivot-distance index.

A vector x gets one more coordinate, sqrt(M - |x|^2) with M the largest squared
length; a query gets 0. Then the squared distance of query and vector is
|q|^2 + M - 2 <q, x>: the nearest vectors are those with the largest product, and
the triangle inequality holds.

Index. PIVOTS vectors, those with the least hash of their id (a bounded sample),
are pivots. Every vector is keyed by its nearest pivot and the distance to it;
in this order the vectors are cut into blocks, each a piece of one pivot's annulus.
Blocks are at most MAX_BLOCKS, so their directory (pivot, least and greatest
distance) is small at any size.

Search. Queries lie in blocks of their own. First every query sees the blocks
with the best bounds, which gives its k-th score so far. Then a block of queries
meets every index block that may still hold a better vector for one of its queries:
by the triangle inequality a distance is at least the gap between the query's
distance to the pivot and the annulus. Blocks come in the order of this bound,
and the k-th scores found on the way stop the later ones. Scores of integer vectors
are exact in doubles below 2**53.

Defined cases: a null vector, or one with a null, NaN or infinite component,
takes no part; shorter vectors count as filled up with zeros; equal rows count
once, rows that share an id but not the vector are separate vectors and separate queries,
and never candidates for their own id; ids that are null take no part; with no
other vector a query has no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import stored

K, PIVOTS, QUERY_ROWS, MAX_BLOCKS, LEAST_ROWS = 20, 64, 512, 1 << 16, 1024
_BLOCK = "block bigint, pivot int, lo double, hi double, n int, ids binary, marks binary, rows binary"


class Space:
    """What a task needs to place vectors: dimension, largest squared length, pivots."""

    def __init__(self, dim: int, most: float, pivots: np.ndarray):
        self.dim, self.most = dim, most
        self.pivots = np.hstack([pivots, np.sqrt(np.maximum(most - (pivots**2).sum(1), 0))[:, None]])

    def distances(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """To every pivot, from vectors or from queries."""
        length = (x**2).sum(1)
        own = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.most - length, 0))
        squares = length[:, None] + (own**2)[:, None] + (self.pivots**2).sum(1)[None, :]
        return np.sqrt(np.maximum(squares - 2 * (x @ self.pivots[:, :-1].T + own[:, None] * self.pivots[:, -1][None, :]), 0))


def _matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    if (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = flat
    return out


def _keyed(space: Space, query: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = space.distances(_matrix(batch.column("v"), space.dim), query)
            nearest = d.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("mark"), batch.column("v"), pa.array(nearest.astype(np.int32)), pa.array(d[np.arange(len(d)), nearest])],
                names=["id", "mark", "v", "pivot", "d"],
            )

    return run


def _blocks(space: Space, rows: int):
    """Cut a task's rows, sorted by (pivot, d), into blocks; rows of a block lie by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        def block(table: pa.Table) -> pa.RecordBatch:
            nonlocal number
            table = table.sort_by([("id", "ascending"), ("mark", "ascending")]).combine_chunks()
            lists = table["v"].chunk(0)
            d = table["d"].to_numpy()
            out = {
                "block": [number], "pivot": [table["pivot"][0].as_py()], "lo": [d.min()], "hi": [d.max()], "n": [len(table)],
                "ids": [table["id"].to_numpy().astype("<i8").tobytes()], "marks": [table["mark"].to_numpy().astype("<i8").tobytes()],
                "rows": [_matrix(lists, space.dim).astype("<f8").tobytes()],
            }
            number += 1
            types = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

        held, pivot = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            pivots = table["pivot"].to_numpy()
            cuts = [0, *(np.flatnonzero(pivots[1:] != pivots[:-1]) + 1).tolist(), len(pivots)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b == a:
                    continue
                if held is not None and pivots[a] != pivot:
                    yield block(held)
                    held = None
                pivot = pivots[a]
                part = table.slice(a, b - a)
                held = part if held is None else pa.concat_tables([held, part])
                while len(held) >= rows:
                    yield block(held.slice(0, rows))
                    held = held.slice(rows) if len(held) > rows else None
                    if held is None:
                        break
        if held is not None:
            yield block(held)

    return run


def _indexed(vectors: DataFrame, space: Space, rows: int, query: bool, label: str) -> DataFrame:
    keyed = vectors.mapInArrow(_keyed(space, query), "id bigint, mark bigint, v array<double>, pivot int, d double")
    keyed = stored(keyed, f"{label}-keys")
    # The hash of the id parts vectors at one distance, so that copies of one vector fill many tasks.
    order = ["pivot", "d", F.xxhash64("id", "mark")]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(dealt.mapInArrow(_blocks(space, rows), _BLOCK), label)


def _bounds(space: Space, directory: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Greatest score that any vector of a block can have with a query: (queries, blocks)."""
    d = space.distances(q, True)[:, directory["pivot"]]
    gap = np.maximum(np.maximum(d - directory["hi"], directory["lo"] - d), 0)
    most = ((q**2).sum(1)[:, None] + space.most - gap**2) / 2
    return most + 1e-6 * (1 + np.abs(most))


def _queries(row: dict, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["marks"], "<i8"), np.frombuffer(row["rows"], "<f8").reshape(-1, dim)


def _pairs(space: Space, directory: np.ndarray, k: int, second: bool):
    """(query block, index block, bound): first those that hold enough near vectors, then all that may still matter."""

    def seeds(bound: np.ndarray) -> np.ndarray:
        order = np.argsort(-bound, axis=1, kind="stable")
        enough = np.cumsum(directory["n"][order], axis=1) - directory["n"][order] < k + 1
        chosen = np.zeros(bound.shape, dtype=bool)
        np.put_along_axis(chosen, order, enough, axis=1)
        return chosen.any(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q = np.frombuffer(row["rows"], "<f8").reshape(-1, space.dim)
                bound = _bounds(space, directory, q)
                wanted = seeds(bound)
                if second:
                    least = np.frombuffer(row["least"], "<f8")
                    wanted = (bound >= least[:, None]).any(0) & ~wanted
                found = np.flatnonzero(wanted)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(found), row["block"], np.int64)), pa.array(directory["block"][found]),
                        pa.array(bound[:, found].max(0) if len(found) else np.zeros(0)),
                    ],
                    names=["q", "block", "bound"],
                )

    return run


def _search(space: Space, directory: np.ndarray, k: int):
    """Best k of every query over the pairs of a task, which come by query block and falling bound."""
    position = {b: i for i, b in enumerate(directory["block"].tolist())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best_score, best_id = None, None, None

        def result() -> pa.RecordBatch:
            ids, marks, _ = now[1]
            here = best_score > -np.inf
            row = np.nonzero(here)[0]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(row), now[0][0], np.int64)), pa.array(row.astype(np.int32)), pa.array(ids[row]), pa.array(marks[row]),
                    pa.array(best_id[here]), pa.array(best_score[here].astype(np.int64)),
                ],
                names=["q", "row", "query_id", "mark", "vec_id", "score"],
            )

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or now[0] != (row["q"], row["part"]):
                    if now is not None:
                        yield result()
                    now = ((row["q"], row["part"]), _queries({"ids": row["q_ids"], "marks": row["q_marks"], "rows": row["q_rows"]}, space.dim))
                    best_score = np.full((len(now[1][0]), k), -np.inf)
                    best_id = np.zeros(best_score.shape, np.int64)
                    if row["least"] is not None:
                        floor = np.frombuffer(row["least"], "<f8")
                    else:
                        floor = np.full(len(best_score), -np.inf)
                ids, _, q = now[1]
                own, _, x = _queries(row, space.dim)
                at = position[row["block"]]
                least = np.maximum(floor, best_score.min(1))
                live = np.flatnonzero(_bounds(space, directory[at : at + 1], q)[:, 0] >= least)
                if not len(live):
                    continue
                score = q[live] @ x.T
                score[ids[live][:, None] == own[None, :]] = -np.inf
                # Rows of a block lie by id: among equal scores the earlier row wins.
                take = min(k, len(own))
                if take < len(own):
                    kth = -np.partition(-score, take - 1, axis=1)[:, take - 1]
                    above = score > kth[:, None]
                    ties = (score == kth[:, None]) & (np.cumsum(score == kth[:, None], axis=1) <= (take - above.sum(1))[:, None])
                    cols = np.nonzero(above | ties)[1].reshape(len(live), take)
                else:
                    cols = np.broadcast_to(np.arange(len(own)), (len(live), len(own)))
                all_score = np.hstack([best_score[live], np.take_along_axis(score, cols, 1)])
                all_id = np.hstack([best_id[live], own[cols]])
                order = np.lexsort((all_id, -all_score), axis=1)[:, :k]
                best_score[live] = np.take_along_axis(all_score, order, 1)
                best_id[live] = np.take_along_axis(all_id, order, 1)
        if now is not None:
            yield result()

    return run


_FOUND = "q bigint, row int, query_id bigint, mark bigint, vec_id bigint, score bigint"


def integer_vectors(rows: DataFrame) -> DataFrame:
    """(id, mark, v): floor(64 x) of the valid vectors; mark tells rows with one id apart."""
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * 64).cast("double"))
    valid = rows.filter(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad)
    return valid.select(F.col("vec_id").cast("bigint").alias("id"), whole.alias("v")).select("id", F.xxhash64("v").alias("mark"), "v").distinct()


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries`` against ``vectors``, both (id, mark, v) of whole numbers."""
    spark = vectors.sparkSession
    vectors = stored(vectors, "vectors")
    squares = F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)
    n, dim, most = vectors.agg(F.count("*"), F.max(F.size("v")), F.max(squares)).first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if not n or not dim:
        return empty
    chosen = vectors.groupBy("mark").agg(F.min_by("v", "id").alias("v")).orderBy(F.xxhash64("mark"), "mark").limit(PIVOTS).collect()
    space = Space(dim, most, np.array([list(r.v) + [0.0] * (dim - len(r.v)) for r in chosen]))
    blocks = _indexed(vectors, space, max(LEAST_ROWS, -(-n // MAX_BLOCKS)), False, "index-blocks")
    asked = _indexed(queries, space, QUERY_ROWS, True, "query-blocks")
    listed = blocks.select("block", "pivot", "lo", "hi", "n").orderBy("block").collect()  # at most about MAX_BLOCKS rows
    kinds = [("block", np.int64), ("pivot", np.int32), ("lo", np.float64), ("hi", np.float64), ("n", np.int64)]
    directory = np.array([tuple(r) for r in listed], dtype=kinds)

    def meet(asked_now: DataFrame, second: bool) -> DataFrame:
        pairs = asked_now.mapInArrow(_pairs(space, directory, k, second), "q bigint, block bigint, bound double")
        # A query block with very many index blocks is worked on in parts.
        pairs = stored(pairs.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(max(1, len(listed) // 256)))), "pairs")
        side = asked_now.select(
            F.col("block").alias("q"), F.col("ids").alias("q_ids"), F.col("marks").alias("q_marks"), F.col("rows").alias("q_rows"), "least"
        )
        joined = pairs.join(blocks.select("block", "ids", "marks", "rows"), "block").join(side, "q")
        dealt = joined.repartition("q", "part").sortWithinPartitions("q", "part", F.col("bound").desc())
        return stored(dealt.mapInArrow(_search(space, directory, k), _FOUND), "found")

    first = meet(asked.withColumn("least", F.lit(None).cast("binary")), False)
    ranked = Window.partitionBy("q", "row").orderBy(F.col("score").desc(), "vec_id")
    kth = first.withColumn("r", F.row_number().over(ranked)).filter(F.col("r") == k).select("q", "row", F.col("score").cast("double").alias("s"))
    # One list per query block, at most QUERY_ROWS long.
    lists = kth.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("row", "s"))).alias("kth"))
    known = asked.join(lists.withColumnRenamed("q", "block"), "block", "left")
    second = meet(known.mapInArrow(_with_least, asked.withColumn("least", F.lit(None).cast("binary")).schema), True)
    final = Window.partitionBy("query_id", "mark").orderBy(F.col("score").desc(), "vec_id", "q")
    both = first.unionByName(second).withColumn("rank", F.row_number().over(final))
    return both.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _with_least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each query's k-th score so far, minus infinity where it has fewer, as bytes."""
    for batch in batches:
        least = []
        for n, known in zip(batch.column("n").to_pylist(), batch.column("kth").to_pylist(), strict=True):
            row = np.full(n, -np.inf)
            for i, s in known or ():
                row[i] = s
            least.append(row.astype("<f8").tobytes())
        at = batch.schema.get_field_index("kth")
        names = [c for c in batch.schema.names if c != "kth"]
        columns = [batch.column(i) for i in range(batch.num_columns) if i != at]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(least, pa.binary())], names=[*names, "least"])


def digest(rows: DataFrame) -> DataFrame:
    vectors = integer_vectors(rows)
    return search(vectors, vectors.filter(F.col("id") % 20 == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
