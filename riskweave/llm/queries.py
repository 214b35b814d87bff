"""Named queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from riskweave.llm import (
    filter_audit, html_text, licenses, minhash, mixing, ngram_lm, pieces, pii, quality, suffix_dedup, token_files, topk,
    whitening,
)
from riskweave.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _documents(name: str, digest: Callable[[DataFrame], DataFrame], oracle: str | None = None) -> None:
    """Register a query whose input is the whole of ``documents``."""
    QUERIES[name] = lambda spark, sf_dir: digest(table(spark, sf_dir, "documents"))
    if oracle is not None:
        ORACLES[name] = oracle


_documents("op1_suffix_dedup", suffix_dedup.digest)
QUERIES["op2_html_text"] = lambda spark, sf_dir: html_text.extract(table(spark, sf_dir, "pages"))
_documents("op3_near_duplicates", minhash.digest, minhash.ORACLE)
_documents("op4_source_mix", mixing.digest, mixing.ORACLE)
_documents("op5_pii_spans", pii.digest)
QUERIES["op6_ngram_quality"] = lambda spark, sf_dir: quality.digest(
    table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
)
QUERIES["op7_exact_top_k"] = lambda spark, sf_dir: topk.digest(table(spark, sf_dir, "embeddings"))
ORACLES["op7_exact_top_k"] = topk.ORACLE
_documents("op8_token_files", token_files.digest)
_documents("op9_piece_dropout", pieces.digest)
_documents("op10_kneser_ney", ngram_lm.digest)
_documents("op11_license_scan", licenses.digest, licenses.ORACLE)
QUERIES["op12_filter_audit"] = lambda spark, sf_dir: filter_audit.digest(
    table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
)
ORACLES["op12_filter_audit"] = filter_audit.ORACLE
QUERIES["op13_embedding_whitening"] = lambda spark, sf_dir: whitening.digest(table(spark, sf_dir, "embeddings"))
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
