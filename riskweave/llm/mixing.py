"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots of ``block`` words each. Slot i looks at the
golden-ratio point frac(i * phi); the point falls into one source's interval of
the cumulative target weights, so every stretch of slots holds each source in
about its share. The slots of a source are ranked; rank r takes block r of the
source's documents, which are shuffled by a keyed hash, laid end to end, and
repeated up to three times. The last block of a source is cut where its target
is reached.

No task sees a whole source: positions are running sums over (source, bucket of
the hash) with the bucket totals added, ranks of slots are running counts over
(source, stretch of slots) with the stretch counts added.

Defined cases: a null or wordless text has size 0 and is never taken; a null
source is a source of its own, last in order; a source without words has target
0; rows that repeat a doc_id are separate documents (equal rows are
interchangeable); an empty table gives an empty mix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import WORD, stored

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source's words are used at most this often.
MAX_EPOCHS = 3
_BUCKETS = 4096
_STRETCH = 65_536
#: The golden ratio's fraction, and that of 2**20 times it: in two steps the point stays exact for large slots.
_GOLDEN, _GOLDEN_20 = 0.6180339887498948482, 0.6077874097403728


@dataclass
class Mix:
    """``documents``: doc_id, size, source_size, target, taken. ``pieces``: slot, doc_id, epoch, first_word, words."""

    documents: DataFrame
    pieces: DataFrame


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Target words per source of (source, source_size): shares by weight, at most MAX_EPOCHS times the size.

    The excess of full sources goes to the others by weight. Sources are few;
    ordered by how soon they are full, source k is full when an even spread of
    what the fuller ones leave would give it more than its limit.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    named = sizes.withColumn("sid", F.row_number().over(rank).cast("bigint") - 1).withColumn(
        "weight", F.get(cycle, F.pmod("sid", F.lit(len(weights))).cast("int"))
    )
    limited = named.withColumn("limit", F.col("source_size") * MAX_EPOCHS)
    soonest = Window.orderBy(F.col("limit") / F.col("weight"), "sid")
    before = soonest.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = limited.select(
        "*",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0))).alias("rest"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("open"),
    )
    level = F.col("rest") / F.col("open")
    fits = left.withColumn("fits", level * F.col("weight") <= F.col("limit"))
    at = F.min(F.when(F.col("fits"), F.struct((F.col("limit") / F.col("weight")).alias("o"), "sid", "rest", "open"))).over(every)
    return fits.withColumn("at", at).select(
        "source", "source_size", "sid", "weight",
        F.least(
            F.col("limit").cast("double"),
            F.coalesce(F.col("at.rest") / F.col("at.open") * F.col("weight"), F.col("limit").cast("double")),
        ).alias("target"),
    )


def _positions(rows: DataFrame) -> DataFrame:
    """Add ``start``: words of the same source before the row in shuffled order."""
    ordered = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "size")
    upto = ordered.rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("sid", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    inside = rows.withColumn("_in", F.coalesce(F.sum("size").over(upto), F.lit(0)))
    return inside.join(offsets, ["sid", "bucket"]).withColumn("start", F.col("offset") + F.col("_in")).drop("_in", "offset")


def _slots(spark, goals: DataFrame, block: int) -> DataFrame:
    """(slot, sid, rank) of the slots that are used; at most one golden point per slot."""
    need = goals.withColumn("blocks", F.ceil(F.floor("target") / F.lit(block)).cast("bigint"))
    shares = need.filter("blocks > 0")
    bounds = shares.select(
        "sid", "blocks",
        F.sum("blocks").over(Window.orderBy("sid")).alias("hi"),
        F.sum("blocks").over(Window.partitionBy()).alias("all"),
    ).select("sid", "blocks", ((F.col("hi") - F.col("blocks")) / F.col("all")).alias("lo"), (F.col("hi") / F.col("all")).alias("hi"), "all")
    total, least = bounds.agg(F.max("all"), F.min("blocks")).first()
    if not total:
        return spark.createDataFrame([], "slot bigint, sid bigint, rank bigint")
    # Golden points miss an interval's share by about 2 log2(n) of n points at most, and an interval of
    # width w is met again within 2.7 / w slots. So this many slots give every source its blocks; what
    # a source has too many of is dropped by rank.
    slots = total + min((2 * total.bit_length() + 4) * -(-total // least), 2 * total + 8)
    high, low = F.shiftright("slot", 20), F.col("slot").bitwiseAND((1 << 20) - 1)
    point = (high * F.lit(_GOLDEN_20) + low * F.lit(_GOLDEN)) % 1.0
    edges = F.array_sort(F.collect_list(F.struct("lo", "hi", "sid", "blocks")))
    # One row per source: the edges are as many as there are sources.
    listed = bounds.agg(edges.alias("edges"))
    drawn = spark.range(slots).select(F.col("id").alias("slot")).withColumn("point", point).withColumn("edges", listed.scalar())
    hit = F.filter("edges", lambda e: (e["lo"] <= F.col("point")) & (F.col("point") < e["hi"]))
    dealt = drawn.select("slot", F.get(hit, F.lit(0)).alias("e")).select(
        "slot", F.col("e.sid").alias("sid"), F.col("e.blocks").alias("blocks"), F.floor(F.col("slot") / _STRETCH).alias("stretch")
    )
    counts = dealt.groupBy("sid", "stretch").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("sid").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("sid", "stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("sid", "stretch").orderBy("slot"))
    ranked = dealt.withColumn("_r", inside).join(offsets, ["sid", "stretch"])
    return ranked.withColumn("rank", F.col("offset") + F.col("_r") - 1).filter("rank < blocks").select("slot", "sid", "rank")


def mix(docs: DataFrame, block: int = 256, seed: int = 0) -> Mix:
    """Mix all rows of ``docs`` (doc_id, text, source) to the target weights."""
    spark = docs.sparkSession
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    slim = docs.select("doc_id", "source", F.xxhash64("text").alias("hash"), word_count(docs["text"]).alias("size"))
    slim = stored(slim, "mix-sizes")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = stored(targets(sizes), "mix-targets")
    # One row per source, as many as there are sources; Spark broadcasts it if it is small.
    known = slim.join(goals.drop("weight"), slim["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    keyed = known.withColumn("key", key).withColumn("bucket", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    placed = stored(_positions(keyed).drop("key", "bucket"), "mix-positions")

    limit = F.floor("target").cast("bigint")
    epochs = placed.filter("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(MAX_EPOCHS - 1))))
    runs = epochs.withColumn("from", F.col("start") + F.col("epoch") * F.col("source_size")).withColumn(
        "to", F.least(F.col("from") + F.col("size"), limit)
    ).filter(F.col("from") < F.col("to"))
    cuts = runs.withColumn(
        "rank", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block)))
    )
    first, last = F.greatest("from", F.col("rank") * block), F.least("to", (F.col("rank") + 1) * block)
    dealt = cuts.select("sid", "rank", "doc_id", "start", "size", "epoch", (first - F.col("from")).alias("first_word"), (last - first).alias("words"))
    pieces = dealt.join(_slots(spark, goals, block), ["sid", "rank"])
    taken = pieces.groupBy("sid", "start", "size").agg(F.sum("words").alias("taken"))
    documents = placed.join(taken, ["sid", "start", "size"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "hash", "start"
    )
    return Mix(documents, pieces.select("slot", "doc_id", "epoch", "first_word", "words", "sid", "start"))


def _numbered(rows: DataFrame, order: str) -> DataFrame:
    """Number rows that are equal in doc_id and text, so that each finds its own counterpart."""
    return rows.withColumn("_mix_copy", F.row_number().over(Window.partitionBy("doc_id", "_mix_hash").orderBy(order)))


def apply(docs: DataFrame, copy: str | None = None) -> DataFrame:
    """The mix as rows of ``docs``: a document once for every time it is taken, the last time maybe its first words only.

    ``copy`` adds a column that numbers the rows of equal doc_id and original text.
    """
    found = mix(docs).documents.filter("taken > 0").withColumnRenamed("hash", "_mix_hash")
    counted = _numbered(found, "start").select(
        F.col("doc_id").alias("_mix_id"), F.col("_mix_hash").alias("_mix_h"), F.col("_mix_copy").alias("_mix_c"),
        F.col("size").alias("_mix_size"), F.col("taken").alias("_mix_taken"),
    )
    rows = _numbered(docs.withColumn("_mix_hash", F.xxhash64("text")), "doc_id")
    same = rows["doc_id"].eqNullSafe(counted["_mix_id"]) & (rows["_mix_hash"] == counted["_mix_h"]) & (rows["_mix_copy"] == counted["_mix_c"])
    size, taken = F.col("_mix_size"), F.col("_mix_taken")
    dealt = rows.join(counted, same).withColumn("_mix_epoch", F.explode(F.sequence(F.lit(1), F.ceil(taken / size).cast("int"))))
    words = F.least(taken - (F.col("_mix_epoch") - 1) * size, size)
    gap = r"[\x20\x09-\x0D]"
    # A part at the end of a source: one row per source at most.
    pattern = F.concat(F.lit(rf"^{gap}*+(?:{WORD}+{gap}*+){{"), words.cast("string"), F.lit("}+"))
    cut = dealt.withColumn("_mix_words", words).withColumn("_mix_pattern", pattern)
    text = F.when(F.col("_mix_words") == size, F.col("text")).otherwise(F.regexp_substr("text", F.col("_mix_pattern")))
    changed = cut.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    # Rows equal in the documents, and within these the times each is taken.
    number = F.shiftleft(F.col("_mix_c").cast("bigint"), 32) + F.col("_mix_epoch")
    return changed.select(*docs.columns, *([number.alias(copy)] if copy else []))


def digest(docs: DataFrame) -> DataFrame:
    return mix(docs).documents.select("doc_id", "size", "source_size", "target", "taken")


_W = r"[^\x20\x09-\x0D]+"
ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_W}')), 0)::BIGINT AS size,
         md5('0:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss FROM d GROUP BY source),
w AS (SELECT source, ss, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
-- rounds of sharing: full sources keep three times their size, the others share the rest
r(n, full_sources) AS (
  SELECT 0, []::VARCHAR[]
  UNION ALL
  SELECT n + 1, (SELECT list(coalesce(source, chr(1)) ORDER BY source) FROM w,
      (SELECT (SELECT sum(ss) FROM w) - coalesce(sum(3 * ss) FILTER (list_contains(full_sources, coalesce(source, chr(1)))), 0) AS rest,
              sum(w) FILTER (NOT list_contains(full_sources, coalesce(source, chr(1)))) AS open FROM w)
      WHERE list_contains(full_sources, coalesce(source, chr(1))) OR rest / open * w > 3 * ss)
  FROM r WHERE n < (SELECT count(*) FROM w)),
f AS (SELECT coalesce(full_sources, []) AS fs FROM r ORDER BY n DESC LIMIT 1),
t AS (
  SELECT source, ss, CASE WHEN list_contains(fs, coalesce(source, chr(1))) THEN 3.0 * ss ELSE rest / open * w END::DOUBLE AS target
  FROM w, f, (SELECT (SELECT sum(ss) FROM w) - coalesce(sum(3 * ss) FILTER (list_contains(fs, coalesce(source, chr(1)))), 0) AS rest,
              sum(w) FILTER (NOT list_contains(fs, coalesce(source, chr(1)))) AS open FROM w, f)),
p AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM d)
SELECT doc_id, size, t.ss AS source_size, target,
  (SELECT sum(greatest(0, least(size, floor(target)::BIGINT - e * t.ss - a))) FROM (VALUES (0), (1), (2)) AS x(e))::BIGINT AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""
