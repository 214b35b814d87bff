"""Near-duplicates by b-bit MinHash, every link confirmed on the full shingle sets.

1. Each document gets 128 minima over its 5-word shingles. Four minima make one
   of 32 band keys; a pair of similarity 0.75 misses every band with probability
   (1 - 0.75^4)^32 < 6e-6.
2. Documents with the same set are one class from here on (128-bit set hash).
   Classes that share a band key get 1024 minima, of which the low 2 bits are packed
   into 32 longs.
3. Band candidates: first the classes of a band key against the least class
   in it, then, once those links have joined most of a group, only classes of one
   band key that are still in different components. A candidate counts if the sizes
   allow the similarity and the collision-corrected estimate from the packed
   bits lies within 5 standard deviations (0.08) of it.
4. Candidates are confirmed on the whole sets, kept for the classes that share
   a band key. Components over the confirmed links give the groups.

No group is expanded into all its pairs: a group whose members are linked to its
least member costs one candidate per member and band.

Defined cases: null, empty or wordless texts have no shingles, stand alone and
are kept; under five words the whole sequence is the one shingle; rows that
repeat a doc_id are told apart by their text and equal rows count once
for linking; null ids come last. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import Roll, clear_ids, mix, restore_ids, slices, stored, text_bytes, word_hashes
from riskweave.operators.graph import connected

SHINGLE, PERCENT = 5, 75
PERMS, BANDS = 128, 32
SKETCH, BITS = 1024, 2
#: An estimate this far under the limit is 5 standard deviations off at 1024 minima of 2 bits.
SLACK = 0.08
_LONGS = SKETCH * BITS // 64


@lru_cache(maxsize=1)
def _roll() -> Roll:
    return Roll(fold_case=True)


def shingle_sets(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of every row end to end, offsets)."""
    data, offsets = text_bytes(column)
    words, bounds = word_hashes(_roll(), data, offsets)
    rolled = np.zeros(max(len(words) - shingle + 1, 0), np.uint64)
    for i in range(shingle):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(rolled)]
    rolled = mix(rolled)
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= shingle:
            own = np.sort(rolled[a : b - shingle + 1])
            sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            short = np.array([b - a], dtype=np.uint64)
            for w in words[a:b]:
                short = mix(short * np.uint64(31) ^ w)
            sets.append(short)
        else:
            sets.append(np.zeros(0, np.uint64))
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(lengths)])


def minima(values: np.ndarray, starts: np.ndarray, perms: int) -> np.ndarray:
    """``perms`` minima of every non-empty set, 32 bits each; sets are cut from ``values`` at ``starts``."""
    # Fixed odd multipliers and addends of the permutations, from a counter.
    seeds = mix(np.arange(1, perms + 1, dtype=np.uint64))
    factors, addends = (seeds >> np.uint64(32)).astype(np.uint32) | np.uint32(1), seeds.astype(np.uint32)
    short = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), perms), np.uint32)
    bounds = np.append(starts, len(short))
    first = 0
    while first < len(starts):  # as many sets as fit the processor's cache, or one larger set
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + (1 << 17), side="right")) - 1)
        part, own = short[bounds[first] : bounds[last]], starts[first:last] - bounds[first]
        work = np.empty_like(part)
        for p in range(perms):
            np.multiply(part, factors[p], out=work)
            np.add(work, addends[p], out=work)
            work ^= work >> np.uint32(15)
            np.multiply(work, np.uint32(0x846CA68B), out=work)
            out[first:last, p] = np.minimum.reduceat(work, own)
        first = last
    return out


def packed(mins: np.ndarray) -> np.ndarray:
    """Low BITS bits of all minima in longs."""
    low = (mix(mins.astype(np.uint64)) & np.uint64((1 << BITS) - 1)).reshape(len(mins), _LONGS, 64 // BITS)
    shifts = (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))[None, None, :]
    return np.bitwise_or.reduce(low << shifts, axis=2)


def band_keys(mins: np.ndarray) -> np.ndarray:
    rows = mins.astype(np.uint64).reshape(len(mins), BANDS, PERMS // BANDS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(mins), BANDS)).copy()
    for i in range(rows.shape[2]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, i])
    return key


def _released(run):
    """``run`` as a task that leaves no tables and unused memory behind in its worker."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _roll.cache_clear()
            pa.default_memory_pool().release_unused()

    return task


_SIGNATURE = "id bigint, n bigint, s1 bigint, s2 bigint, bands array<bigint>"


def _lists(rows: np.ndarray, filled: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(np.where(filled, rows.shape[1], 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1).view(np.int64)))


def _signatures(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, offsets = shingle_sets(batch.column("text"), shingle)
            counts = np.diff(offsets)
            filled = counts > 0
            starts = offsets[:-1][filled]
            sums = np.zeros((2, len(counts)), np.uint64)
            if len(starts):
                sums[0, filled] = np.add.reduceat(mix(values), starts)
                sums[1, filled] = np.add.reduceat(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.array(counts), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                    _lists(band_keys(minima(values, starts, PERMS)), filled),
                ],
                names=["id", "n", "s1", "s2", "bands"],
            )

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, offsets = shingle_sets(batch.column("text"), shingle)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))
            counts = np.diff(offsets)
            filled = counts > 0
            mins = minima(values, offsets[:-1][filled], SKETCH)
            bits, bands = _lists(packed(mins), filled), _lists(band_keys(mins[:, :PERMS]), filled)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts), lists, bits, bands], names=["id", "n", "shingles", "bits", "bands"]
            )

    return run


def _plausible(a: str, b: str, percent: int) -> Column:
    """Sizes allow the similarity, and the b-bit estimate does not rule it out."""
    lanes = F.lit(sum(1 << (BITS * i) for i in range(64 // BITS)))
    apart = F.lit(0)
    for i in range(_LONGS):
        x = F.get(f"{a}.bits", F.lit(i)).bitwiseXOR(F.get(f"{b}.bits", F.lit(i)))
        any_bit = x
        for shift in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, shift))
        apart = apart + F.bit_count(any_bit.bitwiseAND(lanes))
    chance = 1.0 / (1 << BITS)
    estimate = (F.lit(1.0) - apart / F.lit(float(SKETCH)) - F.lit(chance)) / F.lit(1.0 - chance)
    low, high = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (100 * low >= percent * high) & (estimate >= percent / 100 - SLACK)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the limit."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - shared
    return pairs.join(left, "a").join(right, "b").filter(100 * shared >= percent * union).select("a", "b")


def groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, n, component) per row of ``docs`` (unique id, text)."""
    marks = stored(docs.mapInArrow(_released(_signatures(shingle)), _SIGNATURE), "minhash")
    filled = marks.filter("n > 0")
    classes = stored(
        filled.groupBy("s1", "s2", "n").agg(F.min("id").alias("id")), "minhash-classes"
    )
    own = marks.join(classes.select("id"), "id", "left_semi")
    keys = own.select("id", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("members")).filter("members > 1")
    # Band keys of one class only, most of them, end here.
    members = stored(keys.join(shared.select("key", "hub"), "key"), "minhash-members")
    wanted = docs.join(members.select("id").distinct(), "id", "left_semi")
    sets = stored(wanted.mapInArrow(_released(_sets(shingle)), "id bigint, n bigint, shingles array<bigint>, bits array<bigint>, bands array<bigint>"), "minhash-sets")
    bits = sets.select("id", "n", "bits")

    def side(name: str) -> DataFrame:
        return bits.select(F.col("id").alias(name), F.struct("n", "bits").alias(f"{name}_"))

    stars = members.filter("id > hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    near = stars.join(side("a"), "a").join(side("b"), "b").filter(_plausible("a_", "b_", percent)).select("a", "b")
    links = stored(_confirmed(near, sets, percent), "minhash-links")
    comps = connected(links, "a", "b")
    placed = members.select("id", "key").join(comps.withColumnRenamed("node", "id"), "id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "id"))
    # Keys with one component have nothing left to find.
    spread = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    rest = stored(placed.join(spread.select("key"), "key"), "minhash-open").join(sets.select("id", "n", "bits", "bands"), "id")
    one = rest.select("key", F.col("id").alias("a"), F.col("component").alias("ca"), F.struct("n", "bits", "bands").alias("a_"))
    two = rest.select("key", F.col("id").alias("b"), F.col("component").alias("cb"), F.struct("n", "bits", "bands").alias("b_"))
    # Classes that share several band keys meet at the least of them only.
    once = F.array_min(F.array_intersect("a_.bands", "b_.bands")) == F.col("key")
    apart = one.join(two, "key").filter((F.col("ca") < F.col("cb")) & _plausible("a_", "b_", percent) & once)
    found = _confirmed(apart.select("a", "b"), sets, percent)
    links = links.unionByName(stored(found, "minhash-links"))
    comps = connected(links, "a", "b").select(F.col("node").alias("rep"), "component")
    reps = classes.select("s1", "s2", "n", F.col("id").alias("rep")).join(comps, "rep", "left")
    reps = reps.select("s1", "s2", "n", F.coalesce("component", "rep").alias("component"))
    joined = marks.select("id", "n", "s1", "s2").join(reps, ["s1", "s2", "n"], "left")
    return joined.select("id", "n", F.coalesce("component", "id").alias("component"))


def digest(docs: DataFrame) -> DataFrame:
    cleared, ids = clear_ids(docs)
    found = groups(cleared).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"),
    )
    return restore_ids(found, ids, ["doc_id", "component_id"], "doc_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each group of near-duplicates in ``docs`` the document with the least id, with its columns.

    Of rows that are equal in doc_id and text one stays.
    """
    cleared, ids = clear_ids(docs)
    kept = groups(cleared).filter("id = component").select("id")
    if ids is None:
        return docs.join(kept, docs["doc_id"] == kept["id"], "left_semi")
    rows = ids.join(kept, "id", "left_semi").select("original", "hash").distinct()
    same = docs["doc_id"].eqNullSafe(rows["original"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == rows["hash"])
    return docs.join(rows, same, "left_semi").dropDuplicates(["doc_id", "text"])


_W = r"[^\x20\x09-\x0D]+"
ORACLE = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS words
  FROM documents),
h AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(words[i : i + 4], ' ') END AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM h a JOIN h b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT e.b, r.seen FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, s.component_id, d.doc_id = s.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) s ON s.node = d.doc_id
"""
