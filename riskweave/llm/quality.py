"""Quality rules: hashed n-gram log-likelihood ratio of trusted text to the raw corpus, and fixed base rules.

Words and runs of other marks are the units; single units and pairs are hashed
into BUCKETS buckets. Counts over all rows give the raw multinomial, counts over
the trusted rows (labels with quality 1 and toxic 0) the target; both with one
added to every bucket. A document's score is the mean log ratio over its
n-grams. It is kept if no base rule fails and its score is not below the
threshold. A fifth of the trusted rows is left out of the counts for it: the
threshold is the score that all but TRUSTED_LOSS of them reach, less MARGIN times
the distance from there to their median, so that clean documents outside the
labels stay. All trusted rows count; scores of the threshold are taken on a grid of 1e-4, counted by value. Counts, scores and
verdicts cover every row. Only DataFrame expressions are used.

Defined cases: a null, empty or wordless text has zeros throughout and fails the
rule on n_words; without labels, or with none that is trusted, only the base
rules decide; a null doc_id is never trusted; rows that repeat a doc_id are
judged one by one; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import stored, whole_text

BUCKETS = 1 << 14
TRUSTED_LOSS, MARGIN = 0.001, 0.5
#: Bits of the set of trusted ids for each of them, and the most longs it takes (8 MB); a full set only lets more rows pass to the join.
MARK_BITS, MARK_WORDS = 16, 1 << 20
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: Runs of letters, digits and all that is not ASCII; runs of ASCII marks.
_UNITS = r"[0-9_a-z\x{80}-\x{10FFFF}]+|[!-/:-@\[-^`{-~]+"


def _hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(_UNITS), F.lit(0)), lambda t: F.xxhash64(t))


def _pairs(hashes: str) -> Column:
    """Hash of every pair of neighbours."""
    return F.zip_with(
        F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))), F.slice(hashes, 2, F.size(hashes)), lambda a, b: F.xxhash64(a, b)
    )


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def _held(doc_id: Column) -> Column:
    """A fifth of the trusted rows sets the threshold and has no part in the target counts."""
    return F.pmod(F.xxhash64(doc_id, F.lit(1)), F.lit(5)) == 0


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids of all trusted labels."""
    return labels.filter("quality = 1 and toxic = 0 and doc_id is not null").select(F.col("doc_id").alias("_trusted")).distinct()


def _id_hash(doc_id: Column) -> Column:
    return F.xxhash64(doc_id.cast("string"))


def marks(trusted: DataFrame, limit: int = MARK_WORDS) -> DataFrame:
    """One row: a bit set, an array of at most ``limit`` longs, with a bit for each trusted id; other ids may share one."""
    size = max(1, min(limit, trusted.count() * MARK_BITS // 64))
    h = _id_hash(F.col("_trusted"))
    placed = trusted.select(F.pmod(F.shiftrightunsigned(h, 6), F.lit(size)).alias("id"), F.pmod(h, F.lit(64)).cast("int").alias("at"))
    words = placed.groupBy("id").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at"))).alias("bits"))
    filled = trusted.sparkSession.range(size).join(words, "id", "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    listed = filled.agg(F.array_sort(F.collect_list(F.struct("id", "bits"))).alias("all"))
    return listed.select(F.transform("all", lambda e: e["bits"]).alias("marks"))


def marked(text: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``text`` whose doc_id has its bit in the ``marks``: all that are trusted, and few others while the set has room."""
    h = _id_hash(F.col("doc_id"))
    placed = text.withColumns({"_marks": found.scalar(), "_h": h})
    word = F.get("_marks", F.pmod(F.shiftrightunsigned("_h", 6), F.size("_marks")).cast("int"))
    hit = F.call_function("shiftright", word, F.pmod(F.col("_h"), F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return placed.filter(hit).drop("_marks", "_h")


def weights(rows: DataFrame, target: DataFrame) -> DataFrame:
    """One row: the log ratio of every bucket, an array of BUCKETS doubles; both inputs have hashes."""

    def counts(of: DataFrame, name: str) -> DataFrame:
        grams = of.select(F.explode(F.concat("hashes", _pairs("hashes"))).alias("h"))
        return grams.select(_bucket(F.col("h")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))

    every = rows.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counts(rows, "raw"), "bucket", "left").join(counts(target, "target"), "bucket", "left")
    filled = filled.select("bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("raw", "target")])
    listed = filled.agg(
        F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("all"),
        F.sum("raw").alias("raw"), F.sum("target").alias("target"),
    )
    ratio = F.transform(
        "all",
        lambda e: F.round(
            F.log((e["target"] + 1) / (F.col("target") + BUCKETS)) - F.log((e["raw"] + 1) / (F.col("raw") + BUCKETS)), 9
        ),
    )
    return listed.select(ratio.alias("weights"))


def _windows(hashes: str) -> Column:
    """Hash of every 3-word window, from the hashes of the words."""
    h = lambda i: F.get(hashes, i)
    found = F.transform(F.sequence(F.lit(0), F.size(hashes) - 3), lambda i: F.xxhash64(h(i), h(i + 1), h(i + 2)))
    return F.when(F.size(hashes) >= 3, found).otherwise(F.array().cast("array<bigint>"))


def _order(windows: str) -> Column:
    """Hashes with their place in the bits that ``_above`` leaves free, sorted: windows that repeat lie side by side."""
    return F.sort_array(F.transform(windows, lambda h, i: h.bitwiseAND(F.col("_above")).bitwiseOR(i.cast("bigint"))))


def _repeat_places(order: str, windows: str) -> Column:
    """Sorted places of the windows whose whole hash equals a neighbour's."""
    place = lambda x: x.bitwiseAND(F.bitwise_not(F.col("_above"))).cast("int")
    whole = lambda x: F.get(windows, place(x))

    def repeats(x: Column, k: Column) -> Column:
        own = whole(x)
        return F.coalesce(own == whole(F.get(order, k + 1)), F.lit(False)) | F.coalesce(own == whole(F.get(order, k - 1)), F.lit(False))

    return F.sort_array(F.transform(F.filter(order, repeats), place))


def _covered(places: str) -> Column:
    gaps = F.transform(places, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - x, F.lit(3))))
    return F.aggregate(gaps, F.lit(0), lambda s, x: s + x).cast("bigint")


def base(rows: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to rows with ``text``."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    trimmed = F.btrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    parts = F.split(trimmed, r"[\x20\x09-\x0D]+")
    worded = rows.withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(parts))
    none = F.array().cast("array<bigint>")
    # Most texts repeat no window: a set of hashes tells, and only the others are sorted.
    keyed = worded.withColumn("_hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("_windows", _windows("_hashes"))
    keyed = keyed.withColumn("_above", F.expr("-shiftleft(1L, length(bin(size(words))))"))
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    counted = keyed.withColumn("_order", F.when(repeated, _order("_windows")).otherwise(none))
    placed = counted.withColumn("_places", _repeat_places("_order", "_windows"))
    measured = placed.withColumns(
        {
            "n_words": F.size("words").cast("bigint"),
            "word_chars": F.length(F.array_join("words", "")).cast("bigint"),
            "n_symbols": F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("bigint"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
            "n_repeat_words": _covered("_places"),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", failed).drop("words", "_hashes", "_windows", "_above", "_order", "_places")


_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _scores(model: DataFrame):
    """Expression of the score of a row with ``hashes``, as a function of the rows."""

    def add(rows: DataFrame) -> DataFrame:
        step = lambda s, h: s + F.get("_weights", _bucket(h))
        weighed = rows.withColumn("_weights", model.scalar())
        total = F.aggregate("hashes", F.lit(0.0), step) + F.aggregate(_pairs("hashes"), F.lit(0.0), step)
        return weighed.withColumn("score", F.round(total / F.nullif(2 * F.size("hashes") - 1, F.lit(-1)), 9)).drop("_weights")

    return add


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All rows of ``docs`` (doc_id, text), and its columns but for the text, with the base columns, score, threshold and kept.

    Four reads of the texts: counts of all rows, counts of the trusted ones, scores of trusted ones for
    the threshold, scores of all rows. Only texts of (nearly) trusted rows are shuffled, by id: a bounded
    set of bits keeps the others away from the joins, whatever the number of labels.
    """
    trusted = stored(trusted_ids(labels), "trusted-ids")  # its size tells Spark how to join
    text = docs.select("doc_id", whole_text(docs).alias("text"))
    near = marked(text, stored(marks(trusted), "trusted-marks"))
    held = _held(F.col("_trusted"))

    def known(ids: DataFrame) -> DataFrame:
        # The same join at every size: a broadcast of ids would give way to a shuffle somewhere.
        return near.join(ids.hint("merge"), near["doc_id"] == ids["_trusted"])

    hashes = _hashes(F.col("text")).alias("hashes")
    scores = _scores(stored(weights(text.select(hashes), known(trusted.filter(~held)).select(hashes)), "ngram-weights"))
    sample = known(trusted.filter(held)).select("text", hashes)
    good = F.when(~F.col("base_failed"), F.col("score"))
    counted = scores(base(sample)).select(F.round(good, 4).alias("good")).groupBy("good").agg(F.count("*").alias("n"))
    cut = counted.agg(F.percentile("good", TRUSTED_LOSS, F.col("n")).alias("low"), F.percentile("good", 0.5, F.col("n")).alias("mid"))
    limit = stored(cut.select((F.col("low") - MARGIN * (F.col("mid") - F.col("low"))).alias("threshold")), "quality-threshold")
    plain = docs.withColumn("text", whole_text(docs)).withColumn("hashes", _hashes(F.col("text")))
    judged = scores(base(plain)).withColumn("threshold", limit.scalar()).drop("hashes", "text")
    fits = F.coalesce(F.col("score") >= F.col("threshold"), F.lit(True))
    decided = judged.withColumn("kept", ~F.col("base_failed") & fits)
    # Stored: a filter pushed below would repeat the rules' expressions many times over.
    return stored(decided, "judged")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are kept, with their columns."""
    own = [F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    back = [F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return judge(docs.select(*own, "doc_id", "text"), labels).filter("kept").select(*back)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text"), labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )
