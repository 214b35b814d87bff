"""How filters applied one after the other overlap, for every order of them, by contingency tensors.

Every row gets one bit per filter, set where it fails. Per part, rows, good and
toxic ones are counted by their bits: a tensor with one axis of length 2 (pass,
fail) per filter. Every figure of the audit is then a contraction of it with one
vector per axis, which selects pass (1, 0), fail (0, 1) or all (1, 1). For the
filter at step k of an order, the rows it removes pass the filters before it, fail
it, and may do anything later; the rows it finds redundant are all that fail it less these;
those that fail it alone pass all others. All orders and steps are one ``einsum``.

The texts are read once. Rows become (id, digest of the text, part, bits), equal
ones are counted together, and the repeated-text filter and the labels are joined
by id, never by text or part, so a text or part with a third of all rows is no hot
key. A task contracts the tensors of some parts at a time: 2 ** filters cells each.

Defined cases: a null text is empty; a null part is the empty string; a null
doc_id is no smaller id for any text, has none smaller itself, and has no label; of
labels that repeat a doc_id any good or toxic one counts, null labels count as 0;
rows that repeat a doc_id are judged one by one (with equal texts none of them is a
repeat of the other); an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import stored

#: Parts whose tensors a task contracts together.
PARTS_AT_ONCE = 64
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
_MARKS = "[#$%&*|]"
_FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_filters(text: Column) -> dict[str, Column]:
    """True where a text fails: A too short, B few distinct words, C capitals, D marks."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    n = F.size(words)
    return {
        "A": n < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > CAPITAL_PERCENT * F.length(text),
        "D": text.rlike(_MARKS),
    }


def cells(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None, part: str = "source") -> DataFrame:
    """(part, bits, n, good, toxic): rows by the filters they fail; the last bit is the repeated-text filter.

    ``filters`` are conditions over ``_text``; the k-th has bit 2 ** k.
    """
    rules = text_filters(F.col("_text")) if filters is None else dict(filters)
    bits = F.lit(0)
    for k, failed in enumerate(rules.values()):
        bits = bits + F.when(failed, 1 << k).otherwise(0)
    named = docs.select(
        F.col("doc_id").cast("bigint").alias("_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("_text"),
    )
    # A row without an id takes no part in the search for repeats: without a digest such rows count together.
    digest = F.when(F.col("_id").isNotNull(), F.unhex(F.sha2(F.col("_text"), 256)))
    marked = named.select("_id", "part", bits.alias("_bits"), digest.alias("_digest"))
    counted = stored(marked.groupBy("_id", "_digest", "part", "_bits").agg(F.count("*").alias("_n")), "audit-rows")
    first = counted.filter("_id is not null").groupBy("_digest").agg(F.min("_id").alias("_id")).withColumn("_first", F.lit(True))
    label = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("_good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_toxic"),
    )
    known = counted.join(first, ["_id", "_digest"], "left").join(label, "_id", "left")
    repeated = F.col("_id").isNotNull() & F.col("_first").isNull()
    whole = F.col("_bits") + F.when(repeated, 1 << len(rules)).otherwise(0)
    some = lambda c: F.sum(F.when(F.col(c), F.col("_n")).otherwise(0))
    return known.groupBy("part", whole.alias("bits")).agg(
        F.sum("_n").alias("n"), some("_good").alias("good"), some("_toxic").alias("toxic")
    )


def selectors(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(orders, and for each order and step one vector per axis: kept, removed, failing, failing only)."""
    passed, failed, either = (1, 0), (0, 1), (1, 1)
    orders = list(itertools.permutations(range(n)))
    kinds = ([], [], [], [])
    for order in orders:
        for k, f in enumerate(order):
            before = set(order[:k])
            for out, (earlier, own, later) in zip(
                kinds, ((passed, passed, either), (passed, failed, either), (either, failed, either), (passed, failed, passed)), strict=True
            ):
                out.append([own if a == f else earlier if a in before else later for a in range(n)])
    return np.array(orders), *(np.array(k, dtype=np.int64) for k in kinds)


def _contract(tensor: np.ndarray, select: np.ndarray) -> np.ndarray:
    """(parts, counts, 2, ..., 2) with (steps, axes, 2) to (parts, counts, steps)."""
    n = select.shape[1]
    axes = list(range(3, 3 + n))
    operands = [tensor, [0, 1, *axes]]
    for a in range(n):
        operands += [select[:, a, :], [2, axes[a]]]
    return np.einsum(*operands, [0, 1, 2])


def interactions(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """Figures per part, order and step from ``cells``; ``names`` are one letter or word for each bit."""
    n = len(names)
    listed = counts.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("cells"))
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in _FIGURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, kept, removed, failing, only = selectors(n)
        texts = ["".join(names[f] for f in order) for order in orders for _ in range(n)]
        steps = np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders))
        own = orders.reshape(-1)
        for batch in batches:
            for start in range(0, batch.num_rows, PARTS_AT_ONCE):
                piece = batch.slice(start, PARTS_AT_ONCE)
                size = piece.num_rows
                lists = piece.column("cells")
                flat, row = lists.flatten(), np.repeat(np.arange(size), lists.value_lengths().to_numpy())
                flags = flat.field("bits").to_numpy()
                tensor = np.zeros((size, 3, *[2] * n), np.int64)
                at = tuple((flags >> k) & 1 for k in range(n))
                for v, name in enumerate(("n", "good", "toxic")):
                    tensor[(row, v, *at)] = flat.field(name).to_numpy()
                gone = _contract(tensor, removed)
                every = tensor[:, :1]
                fails = _contract(every, failing)[:, 0]
                # Removed by each filter over all orders, at any step.
                shares = np.stack([gone[:, 0, own == f].sum(1) for f in range(n)], 1)
                figures = {
                    "kept": _contract(every, kept)[:, 0], "removed": gone[:, 0], "redundant": fails - gone[:, 0],
                    "unique_fails": _contract(every, only)[:, 0], "good_lost": gone[:, 1], "toxic_lost": gone[:, 2],
                    "shapley": shares[:, own],
                }
                columns = {
                    "part": piece.column("part").take(pa.array(np.repeat(np.arange(size), len(steps)))),
                    "filter_order": pa.array(texts * size, pa.string()),
                    "step": pa.array(np.tile(steps, size)),
                    **{c: pa.array(figures[c].reshape(-1)) for c in _FIGURES},
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return listed.mapInArrow(run, schema)


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The five filters A to E over all rows of ``docs`` (doc_id, text and ``part``) in every order."""
    return interactions(cells(docs, labels, part=part), "ABCDE")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(docs, labels)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, doc_id, (CASE WHEN len(w) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
  + (CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 16 ELSE 0 END) AS m FROM d),
c AS (SELECT part, m, count(*) AS n, sum(coalesce(good, 0)) AS g, sum(coalesce(toxic, 0)) AS x FROM f LEFT JOIN l USING (doc_id) GROUP BY part, m),
a AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
p AS (SELECT a1.letter || a2.letter || a3.letter || a4.letter || a5.letter AS filter_order, [a1.bit, a2.bit, a3.bit, a4.bit, a5.bit] AS bits
  FROM a a1, a a2, a a3, a a4, a a5 WHERE a1.bit | a2.bit | a3.bit | a4.bit | a5.bit = 31),
o AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM p, (SELECT unnest(range(1, 6))::INT AS step)),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN m & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN m & before = 0 AND m & bit <> 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN m & before <> 0 AND m & bit <> 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN m = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN m & before = 0 AND m & bit <> 0 THEN g ELSE 0 END) AS good_lost,
  sum(CASE WHEN m & before = 0 AND m & bit <> 0 THEN x ELSE 0 END) AS toxic_lost FROM c, o GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
