"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators.ranking import global_rank
from riskweave.runtime import materialise

#: A word is a longest run of characters other than space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


stored = materialise


def whole_text(df: DataFrame, name: str = "text") -> Column:
    return F.coalesce(df[name], F.lit(""))


def clear_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """(rows with a unique non-null long ``id``, rows (id, original id, hash of the text) or None).

    Ids that are already unique are kept as they are; finding out reads the id
    column only. Otherwise ids are replaced by ranks in the order of (id, hash
    of the text), null last; rows equal in both share a rank.
    """
    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), whole_text(docs, text_col).alias("text"))
    odd = slim.groupBy("id").count().filter("count > 1 or id is null")
    if odd.isEmpty():
        return slim, None
    marked = slim.withColumn("_th", F.xxhash64("text"))
    keys = marked.select("id", "_th").distinct()
    order = [F.col("id").asc_nulls_last(), F.col("_th")]
    ranks = stored(global_rank(keys, order, "rank").select("id", "_th", "rank"), "ids")
    same = marked["id"].eqNullSafe(ranks["id"]) & (marked["_th"] == ranks["_th"])
    cleared = marked.join(ranks, same).select(F.col("rank").alias("id"), "text").distinct()
    return cleared, marked.join(ranks, same).select(F.col("rank").alias("id"), marked["id"].alias("original"), marked["_th"].alias("hash"))


def restore_ids(out: DataFrame, ids: DataFrame | None, columns: list[str], row: str) -> DataFrame:
    """Put original ids back: one row of ``out`` per original row, other id columns mapped too."""
    if ids is None:
        return out
    names = out.columns
    for c in columns:
        known = ids.select(F.col("id").alias(c), F.col("original").alias("_o"))
        known = known if c == row else known.distinct()
        out = out.join(known, c, "left" if c != row else "inner").drop(c).withColumnRenamed("_o", c)
    return out.select(*names)


# ---- bytes in tasks ---------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column end to end, and where each row starts (n + 1 offsets)."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a piece holds about ``limit`` bytes of text, or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Roll:
    """Polynomial hashes of any substring of a byte buffer, modulo 2**64.

    Both power tables grow to the longest buffer seen: 16 bytes per byte of it.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, fold_case: bool = False):
        table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
        if fold_case:
            table[65:91] = table[97:123]
        self.table, self.size = table, 0
        self.power = self.inverse = np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, 1 << 16)
            for name, base in (("power", self.BASE), ("inverse", pow(self.BASE, -1, 1 << 64))):
                steps = np.full(self.size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def load(self, data: np.ndarray) -> None:
        self._grow(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[: len(data)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def windows(self, k: int) -> np.ndarray:
        """Hash of every k-byte window."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n])


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, index of the first word of each row, n + 1 long); words never cross rows."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(roll: Roll, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word in row order, index of each row's first word)."""
    roll.load(data)
    starts, ends, bounds = word_spans(data, offsets)
    return mix(roll.spans(starts, ends) + (ends - starts).astype(np.uint64)), bounds
