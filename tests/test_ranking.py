"""Global ranks, running sums and joins under skew."""

import random

import pytest
from pyspark.sql import functions as F

from riskweave.operators.ranking import first_rows, global_rank, running, temporal_split, top_fraction
from riskweave.operators.skew import split_heavy, spread_join


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    # A third of all rows share one group and one score.
    out = []
    for i in range(600):
        hot = rnd.random() < 0.34
        out.append((f"id{i:04d}", "hot" if hot else f"g{rnd.randrange(5)}", 0.5 if hot else rnd.random(), rnd.randrange(9)))
    return out


def test_global_rank_over_one_big_tie(spark, rows):
    df = spark.createDataFrame(rows, "id string, g string, s double, v int")
    got = {r["id"]: r["rank"] for r in global_rank(df, [F.col("s").desc(), F.col("id")]).collect()}
    want = {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])))}
    assert got == want


def test_running_sums_per_group(spark, rows):
    df = spark.createDataFrame(rows, "id string, g string, s double, v int")
    out = running(df, [F.col("s"), F.col("id")], {"upto": F.col("v")}, ["g"], {"before": F.col("v")}).collect()
    for r in out:
        mine = [x for x in rows if x[1] == r["g"]]
        assert r["upto"] == sum(x[3] for x in mine if (x[2], x[0]) <= (r["s"], r["id"]))
        assert r["before"] == max((x[3] for x in mine if (x[2], x[0]) < (r["s"], r["id"])), default=None)


def test_spread_join_keeps_every_row(spark, rows):
    df = spark.createDataFrame(rows, "id string, g string, s double, v int")
    stats = df.groupBy("g").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    out = spread_join(df, stats, ["g"], "n", "id", rows_per_task=50).collect()
    totals = {}
    for r in rows:
        totals[r[1]] = totals.get(r[1], 0) + r[3]
    assert len(out) == len(rows)
    assert all(r["total"] == totals[r["g"]] for r in out)


def test_split_heavy(spark, rows):
    df = spark.createDataFrame(rows, "id string, g string, s double, v int")
    light, heavy = split_heavy(df, "g", 150)
    assert {r["g"] for r in heavy.select("g").distinct().collect()} == {"hot"}
    assert light.count() + heavy.count() == len(rows)
    assert split_heavy(df, "g", 10_000)[1] is None


def test_temporal_split_and_top_fraction(spark, rows):
    df = spark.createDataFrame(rows, "id string, g string, s double, v int")
    assert temporal_split(df, "s", "id").agg(F.sum("is_train")).first()[0] == 480
    top = top_fraction(df, "s", "id", 0.011).collect()
    want = [r[0] for r in sorted(rows, key=lambda r: (-r[2], r[0]))[:7]]
    assert sorted(r["id"] for r in top) == sorted(want)
    assert top_fraction(df, "s", "id", 0.0001).count() == 1


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("cell_rows", [10, 1_000_000])
def test_first_rows_equal_a_full_sort(spark, rows, descending, cell_rows):
    inf, nan = float("inf"), float("nan")
    odd = [("a1", nan), ("a2", inf), ("a3", -inf), ("a4", None), ("a5", None), ("a6", -0.0), ("a7", 0.0), ("a8", nan)]
    data = [(r[0], r[2]) for r in rows] + odd
    df = spark.createDataFrame(data, "id string, s double").cache()

    def place(r):
        if r[1] is None:
            return (1, 0.0, 0.0, r[0])
        number = (2.0, 0.0) if r[1] != r[1] else (1.0, r[1])
        sign = -1 if descending else 1
        return (0, sign * number[0], sign * number[1], r[0])

    want = [r[0] for r in sorted(data, key=place)]
    for k in (0, 3, 300, 604, 607):
        got = {r["id"] for r in df.filter(first_rows(df, "s", "id", k, descending, cell_rows)).collect()}
        assert got == set(want[:k]), k


def test_first_rows_by_time_plan_has_no_sort(spark):
    df = spark.range(1000).select(F.timestamp_micros(F.col("id") * 7_919_333 % 1_000_003).alias("t"), F.col("id")).cache()
    split = temporal_split(df, "t", "id", 0.8)
    assert split.agg(F.sum("is_train")).first()[0] == 800
    assert split.filter("is_train = 1").agg(F.max("t")).first()[0] <= split.filter("is_train = 0").agg(F.min("t")).first()[0]
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan
