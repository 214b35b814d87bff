"""A training corpus from raw documents: five stages, each over all rows its predecessor kept.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written and read again as the next one's ``docs``.
All but the last return the columns of ``documents``; the mix adds ``mix_copy``, so that
repeats of a document are encoded by draws of their own (with as many ``_`` behind it as
keep it apart from columns that ``documents`` has). ``n_chars`` follows the text where a
stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import minhash, mixing, pieces, pii, quality
from riskweave.llm.common import table
from riskweave.runtime import materialise


def _copy_column(columns: list[str]) -> str:
    """The longest of ``mix_copy``, ``mix_copy_``, ... that is there without a gap before it; empty if none is."""
    names, found = {c.lower() for c in columns}, ""
    while (found + "_" if found else "mix_copy") in names:
        found = found + "_" if found else "mix_copy"
    return found


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the n-gram model."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near-duplicates."""
    return minhash.keep_one(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by marks."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: whole, up to three times, the last time as a part."""
    taken = _copy_column(docs.columns)
    return mixing.apply(docs, copy=taken + "_" if taken else "mix_copy")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row with merge-dropout, and whether they decode to its text."""
    return pieces.digest(docs, copy=_copy_column(docs.columns) or None)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("PII", redact_pii),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: SQL can express neither the n-gram model nor the merges; tests compare with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return docs
