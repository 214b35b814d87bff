"""Document operators against plain versions, on the smallest tables and on odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import minhash, mixing, ngram_lm, pieces, pii, quality, suffix_dedup, token_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RULE_KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# ---- suffix dedup ---------------------------------------------------------------


def plain_dedup(rows):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(data[p : p + 100])
        runs = sum(1 for p in range(len(data)) if gone[p] and not (p and gone[p - 1]))
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out.append((i, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_dedup_on_pieced_texts(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("ab cdé") for _ in range(rng.choice([50, 120, 300, 900]))) for _ in range(12)]
    cut = lambda: rng.choice(base)[rng.randrange(40) :][: rng.randrange(400)]
    rows = [(i, "".join(cut() for _ in range(rng.randrange(6)))) for i in range(60)]
    rows += [(90, "a" * 1000), (91, "ab" * 300), (92, None), (93, ""), (94, "a" * 99), (95, "a" * 100)]
    got = suffix_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(tuple, got)) == plain_dedup(rows)


def test_suffix_dedup_on_documents(documents):
    assert sorted(map(tuple, suffix_dedup.digest(documents).collect())) == plain_dedup(rows_of(documents))


def test_suffix_dedup_odd_rows(spark, odd, none):
    got = suffix_dedup.digest(odd)
    assert got.count() == odd.count()
    by = collections.defaultdict(list)
    for r in got.collect():
        by[r.doc_id].append(r)
    assert [r.n_removed for r in by[8]] == [5000 - 0] or by[8][0].n_bytes == 5000
    assert by[8][0].n_removed == 4999  # every string but the first repeats
    assert suffix_dedup.digest(none).count() == 0


# ---- near-duplicates ---------------------------------------------------------------


def shingles(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def plain_groups(rows):
    sets = {i: shingles(t) for i, t in rows}
    head = {i: i for i in sets}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                head[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def test_near_duplicates_of_a_chain(spark):
    """A family of texts in which neighbours are linked and ends are not, next to exact copies."""
    rng = random.Random(5)
    words = [f"v{i}" for i in range(300)]
    rows, current = [], [rng.choice(words) for _ in range(120)]
    for i in range(40):
        rows.append((i, " ".join(current)))
        for _ in range(1):
            current = list(current)
            current[rng.randrange(120)] = f"n{i}"
    rows += [(100 + i, rows[7][1].upper()) for i in range(30)] + [(200, "a b"), (201, "A B"), (202, None), (203, "  ")]
    got = minhash.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = plain_groups(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want


def test_near_duplicates_odd_rows(odd, none):
    got = [tuple(r) for r in minhash.digest(odd).collect()]
    assert len(got) == odd.count()
    assert (1, 4, 1, True) in got and (2, 4, 1, False) in got and (3, 0, 3, True) in got
    assert minhash.digest(none).count() == 0
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert kept.filter("doc_id = 6").count() == 2 and kept.filter("doc_id = 2").count() == 0


# ---- mixing ----------------------------------------------------------------------


def test_mix_meets_targets_and_limits(documents):
    rows = mixing.digest(documents).collect()
    again = mixing.digest(documents.repartition(5)).collect()
    assert sorted(rows) == sorted(again)
    assert all(r.taken <= 3 * r.size for r in rows)
    source = {r.doc_id: r.source for r in documents.collect()}
    taken, target = collections.Counter(), {}
    for r in rows:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())


def test_mix_limits_small_sources(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(10, "a"), (5, "a"), (400, "b"), (300, "c"), (0, "d"), (9, None)])]
    got = mixing.digest(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {rows[r.doc_id][2]: r for r in got}
    assert by["a"].target == 45.0 and by["d"].target == 0.0 and by[None].target == 27.0
    rest = 724 - 45 - 27
    assert by["b"].target == pytest.approx(rest * 2 / 3) and by["c"].target == pytest.approx(rest / 3)


def test_mix_odd_rows(odd, none):
    assert mixing.digest(odd).count() == odd.count()
    assert mixing.digest(none).count() == 0
    mixed = mixing.apply(odd)
    assert mixed.columns == odd.columns
    taken = mixing.digest(odd).agg(F.sum("taken")).first()[0]
    assert sum(len(WORD.findall(r.text)) for r in mixed.collect()) == taken


def test_slots_hold_sources_evenly(documents):
    slots = mixing.mix(documents, block=32).pieces.select("slot", "sid").distinct().orderBy("slot").collect()
    first = collections.Counter(r.sid for r in slots[: len(slots) // 2])
    whole = collections.Counter(r.sid for r in slots)
    assert all(abs(first[s] - n / 2) <= 4 for s, n in whole.items())


# ---- personal data ------------------------------------------------------------------


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_pii(text):
    out = []
    for kind, pattern in RULE_KINDS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if fits:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base_spans(spark, documents):
    odd_texts = [
        None, "", "a@b.c_x@y.z a@b.c@d.e ..@x.y.", "1.2.3.4.5.6.7.8 300.1.1.1 001.2.3.4 1..2.3.4", "4111 1111 1111 1111 x 4111  1111",
        "+1 (988) 555-2485 +12 +1-------2 ++49 30 1234567", "é🎉 4111111111111111 é a@b.co", "1" * 30_000, "a" * 50_000 + "@", "x.y" * 3000,
    ]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(odd_texts, 9000)), "doc_id long, text string"))
    texts = dict(rows_of(docs))
    for r in pii.digest(docs).collect():
        want = plain_pii(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r.doc_id][:200]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in RULE_KINDS]
        assert set(want) <= set(r.spans.split(","))  or not want


def test_pii_redacts(odd, none):
    got = {r.doc_id: r.text for r in pii.redact(odd).collect() if r.doc_id == 9}
    assert got[9] == "é🎉 ▁ x  y\n\nmail me: <EMAIL> or <PHONE>"
    assert pii.redact(odd).columns == odd.columns and pii.digest(odd).count() == odd.count()
    assert pii.digest(none).count() == 0 and pii.redact(none).count() == 0


def test_pii_keeps_columns_named_like_its_own(spark):
    docs = spark.createDataFrame([(1, "mail a@b.org", 5, "x", 7), (2, None, None, "y", 8)], "doc_id long, text string, _base int, _spans string, _candidates int")
    got = {r.doc_id: tuple(r) for r in pii.redact(docs).collect()}
    assert got == {1: (1, "mail <EMAIL>", 5, "x", 7), 2: (2, None, None, "y", 8)}


def test_pii_adds_what_the_formats_miss(spark):
    forms = [
        "write to jane{i} (at) example (dot) com today", "call 055 {n} now", "no. {n}{n} of the list", "mail bob{i}@example.org or +1 (988) 555-{i}",
        "paid by 4222222222222 in May", "ref 4222222222223 in May",
    ]
    docs = [(i, forms[i % 6].format(i=1000 + i, n=1234567 + i)) for i in range(1800)]
    found = pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    added = collections.Counter((r.doc_id % 6, s.kind) for r in found for s in set(r.spans) - set(r.base))
    assert added[0, "email"] == 300 and added[1, "phone"] == 300 and added[4, "card"] == 300
    assert not any(form in (3, 5) for form, _ in added)


def test_pii_learns_from_every_candidate(spark, monkeypatch):
    docs = spark.range(24_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("call 055 "), 1_000_000 + F.col("id") % 900_000).alias("text"))
    seen, real = {}, pii.stored
    monkeypatch.setattr(pii, "stored", lambda df, label: seen.setdefault(label, real(df, label)))
    pii.fit(pii._proposals(docs))
    assert seen["pii-alike"].agg(F.sum("n")).first()[0] == 24_000


# ---- quality ----------------------------------------------------------------------


def plain_rules(text):
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    often = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def test_quality_rules(documents, labels):
    texts = dict(rows_of(documents))
    got = quality.digest(documents, labels).collect()
    kept = {}
    for r in got:
        rules = plain_rules(texts[r.doc_id])
        assert rules == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert r.base_failed == (rules[0] < 50 or 100 * rules[4] > 50 * rules[0])
        assert not (r.base_failed and r.kept)
        kept[r.doc_id] = r.kept, r.base_failed
    marked = [(kept[r.doc_id], r.quality) for r in labels.filter("toxic = 0").collect() if r.doc_id in kept]
    good = [k for (k, failed), q in marked if q == 1 and not failed]
    bad = [k for (k, failed), q in marked if q == 0 and not failed]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_quality_trusts_every_good_label(spark):
    good = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert quality.trusted_ids(good).count() == 30_000


def test_quality_moves_no_text_without_a_trusted_label(spark):
    """Whatever Spark may broadcast, texts of other documents stay out of the join."""
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(None, "no id"), (-7, "below zero")], "doc_id long, text string"))
    ids = docs.filter("doc_id % 10 = 0 or doc_id = -7").select(F.col("doc_id").alias("_trusted"))
    for limit, most in ((quality.MARK_WORDS, 6_000), (1, 30_002)):
        near = quality.marked(docs, quality.marks(ids, limit))
        assert near.columns == docs.columns and near.count() <= most
        assert near.join(ids, near["doc_id"] == ids["_trusted"]).count() == ids.count()
    assert quality.marked(docs, quality.marks(ids.filter("false"))).count() == 0


def test_quality_counts_alike_with_and_without_broadcasts(spark, documents, labels):
    found = []
    for limit in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            found.append(sorted(map(tuple, quality.digest(documents, labels).collect())))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found[0] == found[1]


def test_quality_odd_rows(odd, none, labels):
    no_labels = labels.filter("false")
    got = quality.digest(odd, no_labels)
    assert got.count() == odd.count()
    assert {r.kept for r in got.filter("n_words >= 50 and not base_failed").collect()} <= {True}
    assert quality.digest(none, labels).count() == 0
    assert quality.keep(odd, no_labels).columns == odd.columns


# ---- tokens ---------------------------------------------------------------------------


def test_token_files(spark, documents, odd, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.default_tokenizer())
    start = 0
    for (i, text), r in zip(sorted(rows_of(documents)), sorted(token_files.digest(documents).collect()), strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert tuple(r) == (i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    got = token_files.digest(odd).collect()
    assert len(got) == odd.count() and min(r.start for r in got) == 0
    assert [r.n_tokens for r in got if r.doc_id == 4] == [1]
    assert token_files.digest(none).count() == 0


def test_token_files_learn_parts_of_words_once():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = token_files.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    letters = [a + b + c for a in "abcdefghij" for b in "aeiou" for c in ("st", "né", "ΣΑΣ", "Æſ", "ßж")]
    marks = [".", ",", "!!", "&&&", "***", "%_|", "'", "'s", "<|", "1", "é", "\u0301", "\u0338"]
    texts = [" ".join(w + m for w in letters) for m in marks[:6]]
    texts += [" ".join(w + m for w in letters) for m in marks[6:]]
    texts += ["", None, "  \t ", "\n a\x0bb\x0c ", "don't I'LL THE 's !'s _a_ a_b", "x<|endoftext|>Y <|STARTOFTEXT|> <|startoftext|>", "a\u00a0b\u2003c, d\x85e \x1cf\x1f", "İ! SİI. क़! İI ǅ ª² Ⅷ 中文字。 ก็ 한글! e\u0301, \u1100\u1161 <\u0338 a<\u0338 K K."]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    memo = token_files._encoder(path)
    memo._reset()
    list(token_files.encode_rows(path, 2)(iter([batch.slice(0, 6)])))
    assert len(memo.numbers) <= len(letters) + 7
    (got,) = token_files.encode_rows(path, 2)(iter([batch]))
    want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert got.column("ids").to_pylist() == want
    assert got.column("n_tokens").to_pylist() == [len(w) for w in want]


def test_token_files_prune(spark, documents, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write(documents, path)
    one = token_files.read(spark, path).filter("doc_id = 7")
    assert one.count() == 1
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in one._jdf.queryExecution().toString()


def test_pieces_equal_the_library_without_dropout(documents):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    for r in pieces.encode(documents, dropout=0.0).limit(60).collect():
        assert r.ids == model.encode(r.text)


@pytest.mark.parametrize("dropout", [0.1, 0.7])
def test_pieces_decode_and_repeat(spark, odd, dropout):
    texts = sorted((r.doc_id or 0, r.text or "") for r in odd.collect())
    tokens = pieces.encode(odd, dropout=dropout)
    assert sorted((r.doc_id or 0, r.text) for r in pieces.decode(tokens).collect()) == texts
    first = sorted((r.doc_id or 0, r.text, r.ids) for r in tokens.collect())
    again = sorted((r.doc_id or 0, r.text, r.ids) for r in pieces.encode(odd.repartition(1), dropout=dropout).collect())
    assert first == again
    plain = sorted((r.doc_id or 0, r.text, r.ids) for r in pieces.encode(odd, dropout=0.0).collect())
    assert first != plain


def test_pieces_digest(documents, none):
    rows = pieces.digest(documents).collect()
    assert all(r.lossless and r.n_tokens == len(r.ids) for r in rows)
    assert pieces.digest(none).count() == 0


def test_many_words_at_a_time_merge_like_one():
    one = pieces.Segmenter(pieces.default_model(), 0.3, 11)
    words = ["hello", "x" * 40, "the\nend", "", " two", "▁mark", "日本語", "heanthe" * 12]
    for variant in range(3):
        flat, lengths = one.many(words, np.full(len(words), variant))
        assert np.split(flat, np.cumsum(lengths)[:-1])[0].tolist() == one.ids("hello", variant)
        assert flat.tolist() == [i for w in words for i in one.ids(w, variant)]
    long_word = ["▁", *"heanthe" * 30]
    assert one._short(list(long_word), 99) == one._long(list(long_word), 99)


def test_every_occurrence_has_a_draw_of_its_own(spark):
    docs = spark.createDataFrame([(i, "international " * 200) for i in range(30)], "doc_id long, text string")
    one = pieces.Segmenter(pieces.default_model(), 0.1, 17)
    draws = np.arange(6000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    words = ["international", "the", "日本語", " two", "x" * 30, "heanthe" * 20] * 1000
    flat, lengths = pieces.Drawn(one).ids(words, draws)
    assert flat.tolist() == [i for w, d in zip(words, draws.tolist(), strict=True) for i in one.ids(w, d)]
    # Each step is skipped with the chance given.
    ways = collections.Counter(tuple(one.ids("international", d)) for d in draws.tolist())
    steps = int(one.masked(["international"], np.zeros(1, np.uint64))[2][0])
    assert len(ways) > 30 and abs((one._gap(draws, 0) >= steps).mean() - 0.9**steps) < 0.03
    # Over a corpus a word has more ways than any fixed number of variants, and copies differ.
    assert len({tuple(r.ids) for r in pieces.encode(docs).collect()}) == 30
    copies = docs.filter("doc_id = 1").crossJoin(spark.range(3).toDF("copy"))
    assert len({tuple(r.ids) for r in pieces.encode(copies, copy="copy").collect()}) == 3


def test_a_text_column_named_copy_is_ignored(spark):
    docs = spark.createDataFrame([(1, "some words", "left"), (2, None, None)], "doc_id long, text string, copy string")
    assert sorted((r.doc_id, r.lossless) for r in pieces.digest(docs).collect()) == [(1, True), (2, True)]
    assert sorted(map(tuple, pieces.encode(docs).collect())) == sorted(map(tuple, pieces.encode(docs.drop("copy")).collect()))


def test_mix_numbers_its_copies(odd):
    rows = mixing.apply(odd.drop("copy"), copy="copy")
    assert rows.select("doc_id", F.xxhash64("text"), "copy").distinct().count() == rows.count() == mixing.apply(odd).count()


# ---- language model -------------------------------------------------------------------


def plain_model(rows):
    split = [(i, [*(t or "").encode().lower().split(), b"\0"]) for i, t in rows]
    train = [w for i, w in split if zlib.crc32(str(i).encode()) % 7 != 2]
    count = collections.Counter(w for ws in train for w in ws)
    pairs = collections.Counter(p for ws in train for p in zip([b"\1", *ws], ws))
    before = collections.Counter(w for _, w in pairs)
    total, kinds = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
    for (u, _), n in pairs.items():
        total[u] += n
        kinds[u][min(n, 3) - 1] += 1

    def discounts(values):
        n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
        if min(n) == 0:
            return [0, 0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [0, *[min(max(k - (k + 1) * y * n[k] / n[k - 1], 0), k) for k in (1, 2, 3)]]

    d, e = discounts(pairs.values()), discounts(before.values())
    even = sum(e[min(v, 3)] for v in before.values()) / len(pairs) / (len(count) + 1)

    def p(u, w):
        low = max(before[w] - e[min(before[w], 3)], 0) / len(pairs) + even
        if not total[u]:
            return low
        n = pairs[u, w]
        return max(n - d[min(n, 3)], 0) / total[u] + sum(d[k + 1] * kinds[u][k] for k in range(3)) / total[u] * low

    return split, count, p


def test_language_model(documents):
    split, count, p = plain_model(rows_of(documents))
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in ngram_lm.digest(documents).collect()}
    for i, words in split:
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in count for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words), rel=1e-9)
        assert r.score == pytest.approx(sum(math.log10(p(u, w)) for u, w in zip([b"\1", *words], words)), rel=1e-9)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert sum(p(b"the", w) for w in count) + p(b"the", b"never seen") == pytest.approx(1.0)


def test_language_model_odd_rows(odd, none):
    got = ngram_lm.digest(odd)
    assert got.count() == odd.count()
    assert {r.n_tokens for r in got.filter("doc_id in (3, 4, 5)").collect()} == {1}
    assert ngram_lm.digest(none).count() == 0
