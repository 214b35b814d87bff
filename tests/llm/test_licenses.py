"""License scans: automata against expressions and against phrases counted word by word."""

import random
import re

import pyarrow as pa
import pytest

from riskweave.llm import licenses
from riskweave.llm.licenses import Template, fewest, parse, regex, words_of

BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    starts, base = [], set()
    for label, phrase in BASE.items():
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += found
        base |= {label} if found else set()
    joined = " " + "".join(f"{w} " for w in words)
    hits = {t for t in licenses.TEMPLATES if re.search(" " + regex(parse(t.text)), joined)}
    score = max((fewest(parse(t.text)) / (fewest(parse(t.text)) + 4) for t in hits), default=0.0)
    first, last = (min(starts), max(starts)) if starts else (None, None)
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted({t.label for t in hits})), score


def check(df):
    got = sorted((repr(r.doc_id), *tuple(r)[1:]) for r in licenses.digest(df).collect())
    want = sorted((repr(r.doc_id), *plain(r.text)) for r in df.select("doc_id", "text").collect())
    assert list(map(repr, got)) == list(map(repr, want))


def filled(items, rng, fill=("acme", "inc", "2024", "é")):
    """A text that the template accepts."""
    out = []
    for item in items:
        if isinstance(item, licenses.Any):
            out += rng.choices(fill, k=rng.randint(item.least, item.most))
        elif isinstance(item, licenses.Choice):
            out += filled(rng.choice(item.ways), rng, fill)
        else:
            out.append(item)
    return out


def test_documents(documents):
    check(documents)


def test_odd_rows(odd, none):
    check(odd)
    assert licenses.digest(none).count() == 0


def test_every_template_filled_in_and_spoilt(spark):
    rng = random.Random(7)
    rows = []
    for t in licenses.TEMPLATES:
        for _ in range(4):
            words = filled(parse(t.text), rng)
            rows.append(" ".join(rng.choice([w, w.upper(), f"({w}),\n"]) for w in ["x", *words, "y"]))
            cut = rng.randrange(len(words))
            rows.append(" ".join([*words[:cut], rng.choice(["not", ""]), *words[cut + 1 :]]))
            rows.append(" ".join([*words[:cut], words[cut], "really", *words[cut + 1 :]]))
    rows += [" ".join(rng.choices(["under", "the", "mit", "license", "cc", "by", "nc", "licensed", "4", "0", "gnu"], k=60)) for _ in range(60)]
    rows += ["cc by nc cc by nc by nc", "cc by", "", None, "CC-BY-NC 4.0", "é".join(["under the mit license"] * 3)]
    check(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4))


def places(texts, templates):
    n, row, template, first, stop = licenses.Scanner(licenses.Automaton(templates)).scan(pa.array(texts, pa.string()))
    return [(int(r), templates[t].label, int(a), int(b)) for r, t, a, b in zip(row, template, first, stop)]


def test_regions():
    t = Template("x", "one <<beginOptional>>two <<beginOptional>>three<<endOptional>><<endOptional>> <<var;name=n;match=1-2>> four <<var;match=five|six six>>")
    accepted = ["one a four five", "one two a b four six six", "one two three a four five", "one two four five", "ONE, three a four; five!"]
    refused = ["one four five", "one three two a b four five", "one a b c four five", "one a four six", "one a"]
    got = places([*accepted, *refused], [t])
    assert [r for r, *_ in got] == list(range(len(accepted)))
    assert got[0] == (0, "x", 0, 4) and got[1] == (1, "x", 0, 7)


def test_texts_do_not_run_on_and_the_longest_place_counts():
    t = [Template("p", "a b", base=True), Template("q", "a <<beginOptional>>b a b<<endOptional>>")]
    assert places(["a", "b a", "b a b a b"], t) == [(0, "q", 0, 1), (1, "q", 1, 2), (2, "p", 1, 3), (2, "q", 1, 5), (2, "p", 3, 5)]


def test_whole_license(spark):
    mit = next(t for t in licenses.TEMPLATES if t.label == "mit" and len(t.text) > 500)
    text = " ".join(filled(parse(mit.text), random.Random(1)))
    df = spark.createDataFrame([(1, text), (2, "intro " + text), (3, text.replace("merge", "fork"))], "doc_id long, text string")
    got = {r.doc_id: [p.whole for p in r.places if p.label == "mit"] for r in licenses.scan(df).collect()}
    assert got == {1: [True], 2: [False], 3: []}


@pytest.mark.parametrize("text", ["", "<<var;match=0-3>> x", "<<beginOptional>>x<<endOptional>>", "<<beginOptional>>x", "x<<endOptional>>", "x <<what>>"])
def test_templates_that_are_none(text):
    with pytest.raises(ValueError):
        licenses.Automaton([Template("x", text)])


def test_case_folds_in_ascii_only_and_a_long_text(spark):
    long = "word " * 400_000 + "under the MIT License " + "İ " * 10
    rows = [(1, "UNDER THE MİT LICENSE"), (2, "Under\x00the\tMIT_License"), (3, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df)
    assert {r.doc_id: r.n_base for r in licenses.digest(df).collect()} == {1: 0, 2: 1, 3: 1}
    assert words_of("É-é a1_b") == ["É", "é", "a1", "b"]
