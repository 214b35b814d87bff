"""The filter audit against filters applied one by one."""

import itertools
import re
from collections import Counter

from pyspark.sql import functions as F

from riskweave.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fails(rows):
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    out = []
    for i, text, _ in rows:
        t = text or ""
        words = WORD.findall(t)
        out.append(
            {
                "A": len(words) < 50,
                "B": 100 * len(set(words)) < 65 * len(words),
                "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
                "D": any(c in "#$%&*|" for c in t),
                "E": i is not None and first[t] < i,
            }
        )
    return out


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    fails = plain_fails(rows)
    parts = {r[2] or "" for r in rows}
    out, gone_by = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        left = set(range(len(rows)))
        for step, f in enumerate(order, 1):
            removed = {k for k in left if fails[k][f]}
            earlier = set(range(len(rows))) - left
            left -= removed
            for part in parts:
                mine = {k for k in range(len(rows)) if (rows[k][2] or "") == part}
                out[part, order, step] = [
                    len(left & mine),
                    len(removed & mine),
                    sum(fails[k][f] for k in earlier & mine),
                    sum(fails[k][f] and sum(fails[k].values()) == 1 for k in mine),
                    sum(rows[k][0] in good for k in removed & mine),
                    sum(rows[k][0] in toxic for k in removed & mine),
                ]
                gone_by[part, f] += len(removed & mine)
    return {k: (*v, gone_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(df):
    return {(r[0], r[1], r[2]): tuple(r)[3:] for r in df.collect()}


def check(spark, docs, labels):
    got = filter_audit.digest(docs, labels)
    rows = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
    want = plain_audit(rows, [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert found(got) == want
    assert got.count() == len(want)


def test_documents(spark, sf_dir, documents):
    check(spark, documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def test_odd_rows_and_labels(spark, odd):
    labels = [(1, 1, 0), (1, 0, 1), (3, None, None), (6, 1, None), (8, 0, 1), (None, 1, 1), (999, 1, 1)]
    extra = "doc_id long, quality int, toxic int, part string, n long"
    check(spark, odd, spark.createDataFrame([(*r, "p", 3) for r in labels], extra))


def test_a_hot_text_and_a_hot_part(spark):
    rows = [(i, "same text again", "hot") for i in range(300)] + [(i, "same text again", f"s{i % 7}") for i in range(300, 330)]
    rows += [(None, "same text again", "hot"), (None, "same text again", "hot"), (0, "same text again", "hot")]
    rows += [(1000 + i, " ".join(f"w{i}x{k % 40}" for k in range(60 + i)), "hot") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    check(spark, docs, spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(0, 1100, 3)], "doc_id long, quality int, toxic int"))


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.digest(none, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert found(filter_audit.digest(one, labels)) == plain_audit([(1, None, None)], [])


def test_other_filters_and_more_parts_than_a_task_takes_at_once(spark):
    rows = [(i, f"text {i}", f"p{i % 150:03d}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd_end = {"X": F.col("_text").rlike("[13579]$"), "Y": F.col("_text").rlike("7")}
    got = found(filter_audit.interactions(filter_audit.cells(docs, labels, odd_end), "XYE"))
    assert len(got) == 150 * 6 * 3
    for (part, order, step), figures in got.items():
        texts = [t for _, t, p in rows if p == part]
        fail = {"X": lambda t: int(t[-1]) % 2 == 1, "Y": lambda t: "7" in t, "E": lambda t: False}
        left = [t for t in texts if not any(fail[f](t) for f in order[: step - 1])]
        gone = [t for t in left if fail[order[step - 1]](t)]
        assert figures[:3] == (len(left) - len(gone), len(gone), sum(fail[order[step - 1]](t) for t in texts) - len(gone))
