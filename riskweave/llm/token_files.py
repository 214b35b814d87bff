"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on ids.

Documents are dealt out by ranges of doc_id, encoded with a ``tokenizers`` file
word by word, closed with an end id, and written one row per document. Every
file covers one range of ids, in order, so minimum and maximum per stripe and
per row group prune by range and the Bloom filter prunes by single ids; stripes
are read in parallel.

The end id alone stands for a null or empty text. Rows without a doc_id come
first (their start counts from 0) as Spark sorts them; rows that repeat a doc_id follow
each other in the order of (n_tokens, ids_crc32). Extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.llm.common import slices, whole_text
from riskweave.llm.memo import Memo
from riskweave.runtime import scratch_path

END = 2
#: Bytes of ORC stripe and rows per row group; a reader's task takes one or more whole stripes.
STRIPE_BYTES = 16 << 20
ROW_GROUP = 2_000
#: ASCII marks that are one unit after letters; an apostrophe may open a unit of its own.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Latin, Greek, Cyrillic, Han and Hangul characters that are letters by any edition of Unicode and stay letters
#: when normalized (the capital I with a dot does not: its dot would be one unit with the marks after it).
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏΈ-ΊΌΎ-ΡΣ-ώА-ҁҊ-ӿ一-龥가-힣"
_BOTH = f"^[{_LETTERS}]+[" + "".join("\\" + c for c in _MARKS) + "]+$"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def _encoder(path: str) -> Memo:
    """The tokenizer behind a memory of parts of words; one per Python worker and file."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    tokenizer, plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
    # Words of a-z come out of the normalizer as they are and are one unit each: spaces part them as well.
    plain.normalizer = normalizers.Sequence([])
    plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
    closes = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
    closes[[i for piece, i in tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True

    def ids(by: Tokenizer, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in by.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(words: list[str], _) -> tuple[np.ndarray, np.ndarray]:
        out: list = [None] * len(words)
        letters = [i for i, w in enumerate(words) if w.isalpha()]
        latin = [i for i in letters if words[i].isascii() and words[i].islower()]
        # Words of letters alone are encoded many at a time and parted at the ends of their units.
        for by, chosen in ((plain, latin), (tokenizer, sorted(set(letters) - set(latin)))):
            for lo in range(0, len(chosen), 256):
                part = chosen[lo : lo + 256]
                joined = ids(by, [" ".join([words[i] for i in part])])[0]
                stops = (np.flatnonzero(closes[joined]) + 1).tolist()
                if len(stops) == len(part) and len(joined) == stops[-1]:
                    for i, a, b in zip(part, [0, *stops[:-1]], stops, strict=True):
                        out[i] = joined[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, own in zip(rest, ids(tokenizer, [words[i] for i in rest]), strict=True):
            out[i] = own
        lengths = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(chain.from_iterable(out), np.int32, int(lengths.sum())), lengths

    return Memo(encode)


def _parts(words: pa.Array) -> pa.Array:
    """Two strings for each word, all first ones before all second ones, whose ids are those of the word end to end.

    Letters are one unit of the tokenizer and the ASCII marks after them another; any other word stays whole.
    """
    cut = pc.match_substring_regex(words, _BOTH)
    both = words.filter(cut)
    stems, marks = pc.utf8_rtrim(both, characters=_MARKS), pc.replace_substring_regex(both, f"^[{_LETTERS}]+", "")
    return pa.concat_arrays([pc.replace_with_mask(words, cut, stems), pc.replace_with_mask(pa.repeat("", len(words)), cut, marks)])


def _taken(flat: np.ndarray, lengths: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(runs of ``flat`` that ``places`` name, end to end, their lengths); ``lengths`` parts ``flat`` into runs."""
    starts, long = (np.cumsum(lengths) - lengths)[places], lengths[places]
    ends = np.cumsum(long)
    at = np.repeat(starts - ends + long, long)
    at += np.arange(len(at))
    return flat[at], long


def encode_rows(path: str, end_id: int):
    """Task that turns (doc_id, text) batches into (doc_id, n_tokens, ids) batches.

    The tokenizer drops white space and never merges across it, so the ids of a
    text are the ids of its words end to end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _encoder(path)
        for batch in slices(batches, "text"):
            texts = batch.column("text").fill_null("")
            # The tokenizer lowers case; doing it first saves words, but could make a special token's name.
            texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
            split = pc.ascii_split_whitespace(texts)
            words = split.flatten().dictionary_encode()
            parts = _parts(words.dictionary).dictionary_encode()
            ids, long = memo.ids(parts.dictionary.to_pylist())
            pairs = parts.indices.to_numpy().reshape(2, -1).T.ravel()
            ids, long = _taken(ids, long, pairs)
            # One more word is the end id, which follows the words of every text.
            ids, long = np.append(ids, np.int32(end_id)), np.append(long.reshape(-1, 2).sum(1), 1)
            bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
            ids, long = _taken(ids, long, np.insert(words.indices.to_numpy(), bounds[1:], len(long) - 1))
            offsets = np.concatenate([[0], np.cumsum(long)])[bounds + np.arange(len(bounds))]
            n_tokens = np.diff(offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_tokens), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))],
                names=["doc_id", "n_tokens", "ids"],
            )

    return run


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END) -> None:
    """Encode all ``docs`` (doc_id, text) into ORC files in ascending doc_id order."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text(docs).alias("text"))
    ordered = slim.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    encoded = ordered.mapInArrow(
        encode_rows(tokenizer or default_tokenizer(), end_id), "doc_id bigint, n_tokens bigint, ids array<int>"
    )
    (
        encoded.write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", ROW_GROUP)
        .option("orc.stripe.size", STRIPE_BYTES)
        .orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files as a table; filters on doc_id reach the stripes' statistics and Bloom filters."""
    return spark.read.schema("doc_id bigint, n_tokens bigint, ids array<int>").orc(path)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        flat = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4")
        offsets = lists.offsets.to_numpy()
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("file"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())],
            names=["doc_id", "file", "n_tokens", "ids_crc32"],
        )


def index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, from the stored ids.

    Files cover disjoint ranges of ids, so a start is the tokens of the files
    before plus those before it in its own file.
    """
    rows = read(spark, path).select("doc_id", "ids", F.col("_metadata.file_path").alias("file"))
    sums = rows.mapInArrow(_checksums, "doc_id bigint, file string, n_tokens bigint, ids_crc32 bigint")
    ordered = Window.partitionBy("file").orderBy("doc_id", "n_tokens", "ids_crc32")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    local = sums.withColumn("_in", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    # One row per file, from the two narrow columns.
    files = read(spark, path).select("doc_id", "n_tokens", F.col("_metadata.file_path").alias("file"))
    totals = files.groupBy("file").agg(
        F.min("doc_id").alias("first"), F.sum("n_tokens").alias("n"), F.max(F.col("doc_id").isNull()).alias("nameless")
    )
    earlier = Window.orderBy(F.col("nameless").desc(), "first").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    return local.join(offsets, "file").select("doc_id", (F.col("_before") + F.col("_in")).alias("start"), "n_tokens", "ids_crc32")


def digest(docs: DataFrame) -> DataFrame:
    path = scratch_path(docs.sparkSession, "token-ids")
    write(docs, path)
    return index(docs.sparkSession, path)
