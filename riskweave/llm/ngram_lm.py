"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped for scoring.

Counting. Tasks count the word pairs of a few million tokens at a time and send
them, packed, to buckets by a hash of the first word; words that make up over half a percent of
a bounded sample of rows are also dealt by their second word, so that no bucket holds a
common word alone (the list changes where counts meet, not what they are). A
bucket adds up its pairs, writes them as sorted arrays of 64-bit pair hashes
and counts, and passes on, per word, what the model needs of it: its count, the
distinct words before it, and as a context its total and how many words followed
it once, twice and more often. These meet in buckets by word and become sorted
arrays as well. No table is ever in one task or on the driver; only totals are.

Model. A pair's probability takes the discounts D1, D2, D3+ from the counts of
counts; what they free goes to the distribution of the second word, in which a word
counts the distinct words before it, discounted likewise, and what that frees
is even over the known words and one unknown word. So the probabilities after any
context add up to 1. The context of a first word is the start of the text, which is no token.

Scoring. Workers map the arrays they need from the shared folder and look up the
sorted distinct pairs of a batch. Where the folder is no local or mounted file system the arrays are
read through pyarrow.fs instead.

Defined cases: null and empty texts have the end token only; a null doc_id counts as
the empty text for the split, so it is in training; rows that repeat a doc_id
are scored and counted one by one; with no training rows N is 0, every word is
unknown and scores are those of one unknown word; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import Roll, mix, slices, text_bytes, whole_text, word_hashes
from riskweave.runtime import scratch_path

FOLDS, HELD_OUT = 7, 2
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
#: Tokens counted together in a task, text bytes per bucket, rows of the sample for common words.
TOKENS, BUCKET_BYTES, COMMON_ROWS = 2_500_000, 12 << 20, 1000
_COMMON_SHARE, _SPREAD = 0.005, 64
_PAIR, _WIDE_PAIR = (np.dtype([("key", "<u8"), ("count", kind)]) for kind in ("<u4", "<u8"))
_WORD = np.dtype([("key", "<u8"), ("count", "<u8"), ("before", "<u4"), ("total", "<u8"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4")])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


@lru_cache(maxsize=1)
def _roll() -> Roll:
    return Roll(fold_case=True)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of words and ends of all rows, offsets)."""
    data, offsets = text_bytes(column)
    words, bounds = word_hashes(_roll(), data, offsets)
    out = np.insert(words, bounds[1:], END)
    return out, bounds + np.arange(len(bounds))


def contexts(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[offsets[:-1]] = START
    return before


def pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(u * np.uint64(0x9E3779B97F4A7C15) + w)


def _bucket(u: np.ndarray, w: np.ndarray, common: np.ndarray, buckets: int) -> np.ndarray:
    where = mix(u)
    if len(common):
        hot = common[np.minimum(np.searchsorted(common, u), len(common) - 1)] == u
        where = np.where(hot, mix(where + w % np.uint64(_SPREAD)), where)
    return (where % np.uint64(buckets)).astype(np.int64)


def _summed(keys: tuple[np.ndarray, ...], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct key rows, sorted, and the sums of the values."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    begins = np.flatnonzero(new)
    return [k[begins] for k in keys], [np.add.reduceat(v[order], begins) if len(begins) else v for v in values]


# ---- counting ----------------------------------------------------------------


def _pack(u: np.ndarray, w: np.ndarray, count: np.ndarray) -> bytes:
    """Pairs sorted by (u, w): each u once; counts in one byte, larger ones as 255 and four bytes at the end."""
    begins = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
    runs = np.diff(np.append(begins, len(u))).astype("<u4")
    small = np.minimum(count, 255).astype("<u1")
    big = count[small == 255].astype("<u4")
    head = np.array([len(begins), len(u), len(big)], dtype="<u8")
    return b"".join(x.tobytes() for x in (head, u[begins], runs, w, small, big))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    heads, n, big = (int(x) for x in np.frombuffer(blob, "<u8", 3))
    at = 24
    parts = []
    for kind, size in (("<u8", heads), ("<u4", heads), ("<u8", n), ("<u1", n), ("<u4", big)):
        parts.append(np.frombuffer(blob, kind, size, at))
        at += parts[-1].nbytes
    count = parts[3].astype(np.int64)
    count[count == 255] = parts[4]
    return np.repeat(parts[0], parts[1]), parts[2], count


def _count_pairs(buckets: int, common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            u, w = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            where = _bucket(u, w, common, buckets)
            (where, u, w), (count,) = _summed((where, u, w), [np.ones(len(u), np.int64)])
            cuts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]]))
            blobs = [_pack(u[a:b], w[a:b], count[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(where[cuts[:-1]]), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for batch in slices(batches, "text", 2 << 20):
            words, offsets = tokens(batch.column("text"))
            held.append((contexts(words, offsets), words))
            if sum(len(w) for _, w in held) >= TOKENS:
                yield flush()
        if held:
            yield flush()

    return run


def _save(folder: str, name: str, rows: np.ndarray) -> None:
    """Write under another name and move: a task that runs twice leaves one whole file."""
    system, path = fs.FileSystem.from_uri(folder)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(rows.tobytes())
    system.move(part, f"{path}/{name}")


@lru_cache(maxsize=4096)
def _load(folder: str, name: str, words: bool) -> np.ndarray:
    system, path = fs.FileSystem.from_uri(folder)
    kind = _WORD if words else _PAIR
    if not words and system.get_file_info(f"{path}/{name}-wide").size:
        name, kind = f"{name}-wide", _WIDE_PAIR
    if system.get_file_info(f"{path}/{name}").size in (None, 0):
        return np.zeros(0, kind)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(f"{path}/{name}", dtype=kind, mode="r")
    with system.open_input_file(f"{path}/{name}") as f:
        return np.frombuffer(f.read(), dtype=kind)


_PART = "bucket bigint, kind string, blob binary"


def _add_pairs(folder: str, buckets: int):
    """One bucket of pairs: write its arrays, pass on what it knows about words."""

    def run(table: pa.Table) -> pa.Table:
        u, w, count = (np.concatenate(x) for x in zip(*map(_unpack, table["blob"].to_pylist()), strict=True))
        (u, w), (count,) = _summed((u, w), [count])
        wide = count.max() >= 1 << 32
        rows = np.empty(len(u), _WIDE_PAIR if wide else _PAIR)
        rows["key"], rows["count"] = pair_key(u, w), count
        rows = rows[np.argsort(rows["key"])]
        _save(folder, f"pairs-{table['bucket'][0].as_py()}" + "-wide" * bool(wide), rows)
        (ctx,), (total, n1, n2, n3) = _summed((u,), [count, (count == 1).astype(np.int64), (count == 2).astype(np.int64), (count > 2).astype(np.int64)])
        (word,), (seen, before) = _summed((w,), [count, np.ones(len(w), np.int64)])
        out = np.zeros(len(ctx) + len(word), _WORD)
        first, second = out[: len(ctx)], out[len(ctx) :]
        first["key"], first["total"], first["n1"], first["n2"], first["n3"] = ctx, total, n1, n2, n3
        second["key"], second["count"], second["before"] = word, seen, before
        where = (mix(out["key"].copy()) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        where, out = where[order], out[order]
        cuts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]]))
        blobs = [out[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        of_counts = np.array([(count == i).sum() for i in range(1, 5)], dtype="<i8").tobytes()
        own = table["bucket"][0].as_py()
        return pa.table(
            {
                "bucket": pa.array([*where[cuts[:-1]].tolist(), own], pa.int64()),
                "kind": pa.array(["word"] * len(blobs) + ["pairs"]),
                "blob": pa.array([*blobs, of_counts], pa.binary()),
            }
        )

    return run


def _add_words(folder: str):
    """One bucket of words: write its arrays, return totals."""

    def run(table: pa.Table) -> pa.Table:
        kinds, blobs = table["kind"].to_pylist(), table["blob"].to_pylist()
        pairs = sum((np.frombuffer(b, "<i8") for k, b in zip(kinds, blobs, strict=True) if k == "pairs"), np.zeros(4, np.int64))
        parts = [np.frombuffer(b, _WORD) for k, b in zip(kinds, blobs, strict=True) if k == "word"]
        rows = np.concatenate(parts) if parts else np.zeros(0, _WORD)
        names = _WORD.names[1:]
        (key,), sums = _summed((rows["key"],), [rows[n].astype(np.int64) for n in names])
        out = np.empty(len(key), _WORD)
        out["key"] = key
        for n, s in zip(names, sums, strict=True):
            out[n] = s
        if len(out):
            _save(folder, f"words-{table['bucket'][0].as_py()}", out)
        before, count = out["before"].astype(np.int64), out["count"].astype(np.int64)
        totals = [*pairs.tolist(), *[int((before == i).sum()) for i in range(1, 5)], int((before > 2).sum()), int(before.sum()), int(count.sum()), int((count > 0).sum())]
        return pa.table({"totals": pa.array([totals], pa.list_(pa.int64()))})

    return run


def _discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of entries seen 1, 2, 3 and 4 times; 0.5, 1, 1.5 where a number is missing."""
    if min(n) == 0:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    found = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return [min(max(d, 0.0), float(k)) for k, d in enumerate(found, 1)]


class Model:
    """Totals of a trained model and where its arrays lie; small enough to go to every task."""

    def __init__(self, folder: str, buckets: int, common: np.ndarray, totals: list[int]):
        self.folder, self.buckets, self.common = folder, buckets, common
        self.pair_discount, self.word_discount = _discounts(totals[:4]), _discounts(totals[4:8])
        freed = totals[4] * self.word_discount[0] + totals[5] * self.word_discount[1] + totals[8] * self.word_discount[2]
        self.pairs, self.tokens, self.known = totals[9], totals[10], totals[11]
        self.even = (freed / self.pairs if self.pairs else 1.0) / (self.known + 1)

    def _rows(self, prefix: str, keys: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Entries of sorted-by-bucket keys, zeros where there is none."""
        out = np.zeros(len(keys), _WORD if prefix == "words" else _WIDE_PAIR)
        order = np.lexsort((keys, where))
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(where[order]) != 0, [True]])) if len(order) else np.zeros(1, int)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = order[a:b]
            table = _load(self.folder, f"{prefix}-{where[own[0]]}", prefix == "words")
            if len(table):
                at = np.minimum(np.searchsorted(table["key"], keys[own]), len(table) - 1)
                found = table["key"][at] == keys[own]
                out[own[found]] = table[at[found]]
        return out

    def words(self, keys: np.ndarray) -> np.ndarray:
        return self._rows("words", keys, (mix(keys) % np.uint64(self.buckets)).astype(np.int64))

    def score(self, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, log10 probability) of every word after its context."""
        both, at = np.unique(np.concatenate([u, w]), return_inverse=True)
        entries = self.words(both)
        context, word = entries[at[: len(u)]], entries[at[len(u) :]]
        pair = pair_key(u, w)
        distinct, first, back = np.unique(pair, return_index=True, return_inverse=True)
        where = _bucket(u[first], w[first], self.common, self.buckets)
        seen = self._rows("pairs", distinct, where)["count"].astype(np.float64)[back]

        def discounted(n: np.ndarray, by: list[float]) -> np.ndarray:
            return np.maximum(n - np.array([0.0, *by])[np.minimum(n, 3).astype(np.int64)], 0)

        lower = discounted(word["before"].astype(np.float64), self.word_discount) / max(self.pairs, 1) + self.even
        total = context["total"].astype(np.float64)
        d = self.pair_discount
        freed = d[0] * context["n1"] + d[1] * context["n2"] + d[2] * context["n3"]
        followed = total > 0
        total = np.where(followed, total, 1.0)
        p = np.where(followed, discounted(seen, d) / total + freed / total * lower, lower)
        return word["count"].astype(np.int64), np.log10(p)


def train(rows: DataFrame) -> Model:
    """Count the pairs of all ``rows`` (text) and store the model in the shared folder."""
    spark = rows.sparkSession
    folder = scratch_path(spark, "ngram-model")
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // BUCKET_BYTES))
    sample = rows.select("text").limit(COMMON_ROWS).mapInArrow(_common, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    whole = sample.agg(F.sum("n")).first()[0] or 0
    often = sample.filter(F.col("n") > _COMMON_SHARE * whole).select("key").collect()  # at most 200 words
    common = np.sort(np.array([r.key for r in often], dtype=np.int64).view(np.uint64)) if often else np.zeros(0, np.uint64)
    pairs = rows.select("text").mapInArrow(_count_pairs(buckets, common), "bucket bigint, blob binary")
    parts = pairs.groupBy("bucket").applyInArrow(_add_pairs(folder, buckets), _PART)
    totals = parts.groupBy("bucket").applyInArrow(_add_words(folder), "totals array<bigint>")
    summed = totals.agg(*[F.sum(F.get("totals", F.lit(i))) for i in range(12)]).first()
    return Model(folder, buckets, common, [int(x or 0) for x in summed])


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        keys, counts = np.unique(tokens(batch.column("text"))[0], return_counts=True)
        often = counts >= max(2, counts.sum() * _COMMON_SHARE / 4)
        rest = np.array([counts[~often].sum()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(keys[often].view(np.int64), 0)), pa.array(np.append(counts[often], rest))], names=["key", "n"]
        )


def _score(model: Model):
    unseen = model.tokens + model.known + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            words, offsets = tokens(batch.column("text"))
            count, logs = model.score(contexts(words, offsets), words)
            at = offsets[:-1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(offsets)),
                    pa.array(np.add.reduceat((count > 0).astype(np.int64), at)), pa.array(np.full(len(at), model.tokens, np.int64)),
                    pa.array(np.add.reduceat(np.log10((count + 1) / unseen), at)), pa.array(np.add.reduceat(logs, at)),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


_SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Scores of all ``docs`` (doc_id, text, held_out)."""
    return docs.select("doc_id", "held_out", "text").mapInArrow(_score(model), _SCORED)


def digest(docs: DataFrame) -> DataFrame:
    slim = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), whole_text(docs).alias("text"), held_out(F.col("doc_id")).alias("held_out")
    )
    return score(slim, train(slim.filter("not held_out")))
