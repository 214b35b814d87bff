"""Removal of repeated 100-byte strings by prefix-free parsing and suffix order.

Parsing. A rolling hash over 24-byte windows sets the triggers: of every 100-byte
string, the trigger is its window with the least hash, leftmost on ties. So each
position (start of a 100-byte string) belongs to one trigger, equal strings have
equal triggers at equal places, and the positions of one trigger are a stretch.
A phrase is such a stretch with the 99 bytes after it: it overlaps its successors
and depends on nothing outside it.

Dictionary and parse. The parse is the list of (trigger, phrase, document,
place); equal phrases collapse to one dictionary entry, known by hash, with its
earliest place. All later places of a phrase are repeats as a whole. A trigger
with one dictionary entry is done: it holds no string of any other phrase.

Corpus order. Only the first 100 bytes of a suffix matter, and of their order only
which suffixes fall together, so suffixes are sorted by a 128-bit key of these
bytes, and entries whose trigger has several are sorted first by groups of eight
neighbouring suffixes, then, where groups with a common part differ, one by one.
Each task sorts what it holds (its part of the suffix array, with places) and
passes on the earliest place of each key; these lists combine in a sort by key
and place, where the first is an original and the others are repeats.

Batches of a task settle their own repeats before any shuffle, so a trigger has
at most one row per batch and phrase: a line that every document holds costs a
task no more than a rare one. Prefixes and phrases are compared by 128 bits of
hash in all.

Defined cases: texts under 100 bytes, null and empty ones keep all their bytes;
in a run of one byte every string but the first repeats; rows that repeat a
doc_id count as different documents if their texts differ (ordered by a hash of
the text) and as one if they are equal; null ids come last; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import Roll, clear_ids, mix, restore_ids, slices, text_bytes
from riskweave.runtime import materialise, release

LENGTH, TRIGGER, GROUP = 100, 24, 8
_PIECE = 1 << 20  # bytes worked on at a time; positions within one fit 20 bits


@lru_cache(maxsize=1)
def _roll() -> Roll:
    return Roll()


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by windows of doubling width."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    if rest := width - have:
        x = np.minimum(x[: len(x) - rest], x[rest:])
    return x


def parse(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Phrases of all rows: [trigger hash, phrase hash, row, first position, positions, place of the trigger in it]."""
    row_of = np.searchsorted(offsets, np.arange(0, len(data), _PIECE), side="right") - 1
    out: list[list[np.ndarray]] = [[], [], [], [], [], []]
    for first in range(0, len(data) - LENGTH + 1, _PIECE):
        part = data[first : first + _PIECE + LENGTH - 1]
        roll = _roll()
        roll.load(part)
        grams = roll.windows(TRIGGER)
        n = len(part) - LENGTH + 1
        width = LENGTH - TRIGGER + 1
        # Hash above, place below: equal hashes order by place. Places take 21 bits as a piece has 99 bytes more.
        keyed = (grams & ~np.uint64((1 << 21) - 1)) | np.arange(len(grams), dtype=np.uint64)
        place = (_sliding_min(keyed, width)[:n] & np.uint64((1 << 21) - 1)).astype(np.int64)
        lo = int(row_of[first // _PIECE])
        hi = int(np.searchsorted(offsets, first + n, side="left"))
        ends = offsets[lo + 1 : hi + 1] - first
        row = np.repeat(np.arange(lo, hi), np.diff(np.concatenate([[0], np.minimum(ends, n)])))
        whole = np.arange(LENGTH, n + LENGTH) <= ends[row - lo]
        change = np.ones(n, dtype=bool)
        change[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
        begins = np.flatnonzero(change)
        # A position whose string leaves its document is none; such positions end a document's stretch.
        good = np.add.reduceat(whole.astype(np.int64), begins) if n else np.zeros(0, np.int64)
        begins, good = begins[good > 0], good[good > 0]
        out[0].append(grams[place[begins]])
        out[1].append(mix(roll.spans(begins, begins + good + LENGTH - 1) + good.astype(np.uint64)))
        out[2].append(row[begins])
        out[3].append(begins + first - offsets[row[begins]])
        out[4].append(good)
        out[5].append(place[begins] - begins)
    kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64)
    return [np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(out, kinds, strict=True)]


def _repeats(high: np.ndarray, low: np.ndarray, ident: np.ndarray, at: np.ndarray) -> np.ndarray:
    """True where an equal (high, low) lies at an earlier (ident, at)."""
    order = np.lexsort((at, ident, low, high))
    h, w, i, a = high[order], low[order], ident[order], at[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    heads = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    later = np.zeros(len(order), dtype=bool)
    later[order] = (i != i[heads]) | (a != a[heads])
    return later


def _joined(ident: np.ndarray, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge stretches of positions that follow each other in a document."""
    order = np.lexsort((at, ident))
    ident, at, count = ident[order], at[order], count[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (ident[1:] != ident[:-1]) | (at[1:] != at[:-1] + count[:-1])
    begins = np.flatnonzero(new)
    return ident[begins], at[begins], (np.add.reduceat(count, begins) if len(begins) else count)


#: A row of any stage. ``spot`` holds a position and two small numbers; settled repeats have their length in ``low``.
_ROWS = "high bigint, low bigint, id bigint, spot bigint, repeat boolean"


def _spot(at: np.ndarray, a: np.ndarray | int = 0, b: np.ndarray | int = 0) -> np.ndarray:
    return at << 16 | a << 8 | b


def _batch(high, low, ident, spot, at, count) -> pa.RecordBatch:
    """Settle a batch: its originals, to be compared with other batches, and its own repeats as stretches."""
    later = _repeats(high, low, ident, spot)
    settled = _joined(ident[later], at[later], count[later])
    spread = mix(settled[0].view(np.uint64)).view(np.int64)
    columns = [
        np.concatenate([high[~later].view(np.int64), spread]), np.concatenate([low[~later].view(np.int64), settled[2]]),
        np.concatenate([ident[~later], settled[0]]), np.concatenate([spot[~later], _spot(settled[1])]),
        np.arange(len(later) - later.sum() + len(spread)) >= len(later) - later.sum(),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["high", "low", "id", "spot", "repeat"])


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 16 << 20):
        data, offsets = text_bytes(batch.column("text"))
        high, low, row, at, count, trigger = parse(data, offsets)
        yield _batch(high, low, batch.column("id").to_numpy()[row], _spot(at, trigger, count), at, count)


_ENTRY = "id bigint, at bigint, spot bigint, phrase binary"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the open dictionary entries of each row."""
    for batch in slices(batches, "text"):
        data, offsets = text_bytes(batch.column("text"))
        spots = batch.column("spots")
        row = np.repeat(np.arange(batch.num_rows), np.diff(spots.offsets.to_numpy()))
        spot = spots.flatten().to_numpy()
        begin, size = offsets[row] + (spot >> 16), (spot & 255) + LENGTH - 1
        ends = np.cumsum(size)
        take = np.repeat(begin - ends + size, size) + np.arange(int(size.sum()))
        bounds = np.concatenate([[0], ends]).astype(np.int32)
        phrases = pa.Array.from_buffers(pa.binary(), len(spot), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[take]))])
        ident = batch.column("id").to_numpy()[row]
        yield pa.RecordBatch.from_arrays([pa.array(ident), pa.array(spot >> 16), pa.array(spot), phrases], names=["id", "at", "spot", "phrase"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes of the entries, GROUP neighbours at a time by their distance before the trigger.

    The key's high half is what all suffixes of a group have in common, whichever of them an entry has.
    """
    for batch in slices(batches, "phrase", _PIECE):
        data, offsets = text_bytes(batch.column("phrase"))
        roll = _roll()
        roll.load(data)
        spot = batch.column("spot").to_numpy()
        trigger, count = spot >> 8 & 255, spot & 255
        # Suffix s lies o = trigger - s before it; the groups of an entry are those of its first to its last suffix.
        last, first = trigger // GROUP, (trigger - count + 1) // GROUP
        row = np.repeat(np.arange(len(spot)), last - first + 1)
        number = np.repeat(first, last - first + 1) + np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1)
        t = trigger[row]
        far = np.minimum(number * GROUP + GROUP - 1, LENGTH - TRIGGER)
        begin = np.maximum(t - far, 0)
        end = np.minimum(t - number * GROUP, count[row] - 1)
        core = roll.spans(offsets[row] + t - number * GROUP, offsets[row] + t - far + LENGTH)
        size = end - begin + 1
        whole = roll.spans(offsets[row] + begin, offsets[row] + end + LENGTH)
        high, low = mix(core + number.astype(np.uint64)), mix(whole + size.astype(np.uint64))
        at = (spot >> 16)[row]
        yield _batch(high, low, batch.column("id").to_numpy()[row], _spot(at, begin, size), at + begin, size)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every suffix of the groups that are still open."""
    for batch in slices(batches, "phrase", _PIECE):
        data, offsets = text_bytes(batch.column("phrase"))
        roll = _roll()
        roll.load(data)
        spots = batch.column("spots")
        row = np.repeat(np.arange(batch.num_rows), np.diff(spots.offsets.to_numpy()))
        flat = spots.flatten()
        spot, high = flat.field("spot").to_numpy(), flat.field("high").to_numpy().view(np.uint64)
        count = spot & 255
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        inner = np.repeat(spot >> 8 & 255, count) + step
        begin = np.repeat(offsets[row], count) + inner
        at = np.repeat(spot >> 16, count) + inner
        ident = np.repeat(batch.column("id").to_numpy()[row], count)
        yield _batch(np.repeat(high, count), roll.spans(begin, begin + LENGTH), ident, _spot(at), at, np.ones(len(at), np.int64))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        data, offsets = text_bytes(batch.column("text"))
        names = ("id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        out: dict[str, list] = {k: [] for k in names}
        for i, (ident, spans) in enumerate(zip(batch.column("id").to_pylist(), batch.column("spans"), strict=True)):
            text = data[offsets[i] : offsets[i + 1]]
            removed = runs = 0
            kept = hashlib.sha256()
            done = 0
            if spans.is_valid:
                begin = spans.values.field("at").to_numpy()
                end = begin + spans.values.field("n").to_numpy() + LENGTH - 1
                order = np.argsort(begin, kind="stable")
                begin, end = begin[order], np.maximum.accumulate(end[order])
                new = np.ones(len(begin), dtype=bool)
                new[1:] = begin[1:] > end[:-1]
                heads = np.flatnonzero(new)
                for a, b in zip(begin[heads].tolist(), end[np.append(heads[1:], len(end)) - 1].tolist(), strict=True):
                    kept.update(text[done:a])
                    removed, runs, done = removed + b - a, runs + 1, b
            kept.update(text[done:])
            for k, v in zip(names, (ident, len(text), removed, runs, kept.hexdigest()), strict=True):
                out[k].append(v)
        yield pa.RecordBatch.from_pydict(out)


def _settle(rows: DataFrame, label: str) -> DataFrame:
    """Compare batches; keep repeats, and originals whose high half has more than one low half (``several``)."""
    phrase = Window.partitionBy("high", "low").orderBy("id", "spot")
    entry = Window.partitionBy("high")
    own = F.when(~F.col("repeat"), F.col("low"))
    ranked = rows.repartition("high").withColumn("_rank", F.rank().over(phrase)).select(
        "*", (F.min(own).over(entry) != F.max(own).over(entry)).alias("several")
    )
    # A repeat found here has its length in the low byte of its spot.
    later = ~F.col("repeat") & (F.col("_rank") > 1)
    kept = ranked.filter(F.col("repeat") | later | F.col("several")).select(
        "high", "low", "id", "spot", "repeat", later.alias("later"), "several"
    )
    out = materialise(kept, label)
    release(rows.sparkSession)
    return out


def _stretches(settled: DataFrame, inner: bool) -> DataFrame:
    """(id, at, n) of the repeats; ``inner``: the spot's middle byte is part of the place."""
    at = F.shiftright("spot", 16)
    offset = F.shiftright("spot", 8).bitwiseAND(255) if inner else F.lit(0)
    place = F.when(F.col("repeat"), at).otherwise(at + offset)
    n = F.when(F.col("repeat"), F.col("low")).otherwise(F.col("spot").bitwiseAND(255))
    return settled.filter("repeat or later").select("id", place.alias("at"), n.alias("n"))


def repeats(docs: DataFrame) -> DataFrame:
    """(id, at, n): stretches of n positions from ``at`` whose 100-byte strings start earlier too."""
    spark = docs.sparkSession
    phrases = _settle(docs.mapInArrow(_phrases, _ROWS), "phrases")
    open_phrases = phrases.filter("not repeat and not later and several").groupBy("id").agg(F.collect_list("spot").alias("spots"))
    entries = materialise(docs.join(open_phrases, "id").mapInArrow(_entries, _ENTRY), "entries")
    release(spark)
    groups = _settle(entries.mapInArrow(_groups, _ROWS), "groups")
    open_groups = groups.filter("not repeat and not later and several").groupBy("id", F.shiftright("spot", 16).alias("at")).agg(
        F.collect_list(F.struct("spot", "high")).alias("spots")
    )
    suffixes = entries.select("id", "at", "phrase").join(open_groups, ["id", "at"]).mapInArrow(_suffixes, _ROWS)
    last = _settle(suffixes, "suffixes").withColumn("spot", F.when(F.col("repeat"), F.col("spot")).otherwise(F.col("spot") + 1))
    return _stretches(phrases, False).unionByName(_stretches(groups, True)).unionByName(_stretches(last, False))


def remove(docs: DataFrame) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of rows with a unique ``id``."""
    spans = repeats(docs).groupBy("id").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    return docs.join(spans, "id", "left").mapInArrow(
        _kept, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )


def digest(docs: DataFrame) -> DataFrame:
    cleared, ids = clear_ids(docs)
    return restore_ids(remove(cleared).withColumnRenamed("id", "doc_id"), ids, ["doc_id"], "doc_id")
