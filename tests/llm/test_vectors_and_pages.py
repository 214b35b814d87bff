"""Top-k search, page text and the pipeline against plain versions."""

import html
import itertools
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from riskweave.llm import html_text, minhash, quality, topk


def plain_top_k(rows, k=20):
    good = sorted({(i, tuple(np.floor(np.array(v, dtype=float) * 64))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)})
    dim = max((len(v) for _, v in good), default=0)
    full = [(i, np.array([*v, *[0.0] * (dim - len(v))])) for i, v in good]
    out = []
    for i, q in full:
        if i % 20 == 0:
            best = sorted((-int(q @ x), j) for j, x in full if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def test_top_k_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype("f4").tolist()) for i in range(300)]
    rows += [(i, [0.5] * 8) for i in range(300, 700)]  # one vector many times
    rows += [(1000, None), (1020, [float("nan")] * 8), (1040, [None] * 8), (None, [1.0] * 8), (1060, [0.25, -1.0]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.digest(df).collect())) == plain_top_k(rows)


@pytest.mark.parametrize("rows", [[], [(20, [1.0, 2.0])], [(20, [1.0]), (1, [2.0])]])
def test_top_k_of_little(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.digest(df).collect())) == plain_top_k(rows)


def test_pages_hold_their_article(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    got = html_text.extract(pages).collect()
    assert len(got) == len(source)
    for r in got:
        article = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(x for x in blocks if x)
        assert r.n_chars == len(r.text)


PAGE = """<html><head><title>x</title><style>p{}</style></head><body class="no-sidebar">
<div id="menu"><a href="/">Home</a> <a href="/b">Other pages</a></div><header><h1>The Site</h1></header>
<div class="post"><h2>Head &amp; line</h2><p>First   para with a <a href="#">link</a> and more words here.<p>Short.
<div class="ads">Buy this now, it is the best.</div><ul><li>one item<li>two items here</ul>
<p>Last paragraph of the text, which is long enough.</p><form>Your name and your address please.</form>
<div class="comments"><p>I like this very much, thank you.</p></div></div>
<aside>See also these pages, they are good.</aside><footer>Copyright 2020</footer><script>if (a<b) "</p>"</script></body></html>"""


def test_page_parts():
    assert html_text.main_text(PAGE).split("\n") == [
        "Head & line", "First para with a link and more words here.", "Short.", "one item", "two items here",
        "Last paragraph of the text, which is long enough.",
    ]


@pytest.mark.parametrize("page", [None, "", "<", "<p>", "<!-- x", "<script>x", "<a " * 50_000, "<a '" * 20_001, "<div>" * 50_000, "<p>word " * 20_000])
def test_broken_pages(page):
    text = html_text.main_text(page)
    assert "<p" not in text and "script" not in text


def test_min_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(40):
        n = rng.randrange(1, 9)
        rows = [html_text._Block("x", rng.uniform(-1, 1), (1, rng.randrange(2), i)) for i in range(n)]
        edges = html_text._edges(rows)

        def cost(side):
            own = sum(max(-b.score, 0) if s else max(b.score, 0) for b, s in zip(rows, side))
            return own + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(cost(s) for s in itertools.product([False, True], repeat=n))
        assert cost(html_text.labels(rows)) == pytest.approx(best)


def test_pages_odd_rows(spark):
    rows = [(1, "u", None, "t"), (1, "u", "", "t"), (None, None, "<p>Some words of a text, long enough to stay here.</p>", "t")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.n_chars for r in got)) == [0, 0, len("Some words of a text, long enough to stay here.")]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline_keeps_what_its_stages_decide(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = {r.doc_id for r in quality.digest(docs, labels).filter("kept").collect()}
    after = docs
    for _, stage in corpus_pipeline.STAGES[:1]:
        after = stage(spark, after, sf_dir)
    assert after.columns == docs.columns
    assert {r.doc_id for r in after.collect()} == kept
    single = {r.doc_id for r in minhash.digest(after).filter("kept").collect()}
    assert {r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, after, sf_dir).collect()} == single
    out = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} <= single
    assert out.filter("not lossless").count() == 0


def test_letters_that_grow_when_lower_cased_move_no_end_tag():
    page = "<p>" + "İ" * 20 + "</p><SCRIPT>x</ScRiPt><p>First paragraph</p><p>Second</p>"
    assert [b.text for b in html_text.blocks(page)] == ["İ" * 20, "First paragraph", "Second"]
