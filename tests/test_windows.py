"""Rolling windows, previous times and counts: native and chunked paths."""

import random

import pytest

from riskweave.operators import rolling as R

HOUR = R.HOUR_MICROS


def brute(rows, hours):
    out = {}
    for key, ts, tie, value in rows:
        mine = [r for r in rows if r[0] == key and (r[1], r[2]) <= (ts, tie)]
        rec = {}
        for h in hours:
            frame = [r for r in mine if r[1] > ts - h * HOUR]
            rec[h] = (len(frame), sum(r[3] for r in frame))
        earlier = [r for r in mine if r[2] != tie]
        rec["prev"] = max((r[1] for r in earlier), default=None)
        out[tie] = rec
    return out


@pytest.fixture(scope="module")
def skewed():
    """Half of the rows belong to one key; many equal times."""
    rnd = random.Random(5)
    rows = []
    for i in range(400):
        key = "hot" if rnd.random() < 0.5 else f"k{rnd.randrange(20)}"
        rows.append((key, rnd.randrange(0, 600) * HOUR // 4, f"T{i:04d}", float(rnd.randrange(1, 10_000)) / 4))
    return rows


@pytest.mark.parametrize("dense_rows", [20_000, 30])
def test_windows_match_brute_force(spark, skewed, dense_rows):
    df = spark.createDataFrame(skewed, "key string, ts bigint, tie string, v double")
    out = R.activity_windows(df, "key", "ts", "tie", "v", (1, 6, 24, 168), dense_rows, 40).collect()
    want = brute(skewed, (1, 6, 24, 168))
    assert len(out) == len(skewed)
    for row in out:
        for h in (1, 6, 24, 168):
            n, total = want[row["tie"]][h]
            assert row[f"count_{h}h"] == n
            assert row[f"sum_{h}h"] == pytest.approx(total)
        assert row["previous_ts"] == want[row["tie"]]["prev"]


def test_native_and_chunked_moments_agree(spark, skewed):
    df = spark.createDataFrame(skewed, "key string, ts bigint, tie string, v double")
    one, two = (
        {r["tie"]: r for r in R.activity_windows(df, "key", "ts", "tie", "v", (1,), limit, 50).collect()}
        for limit in (20_000, 30)
    )
    for tie, row in one.items():
        assert row["key_mean"] == pytest.approx(two[tie]["key_mean"])
        assert row["key_std"] is None or row["key_std"] == pytest.approx(two[tie]["key_std"])


def test_both_paths_sum_alike(spark):
    """Amounts far below a cent, and amounts that are no number."""
    amounts = [4e-7] * 10 + [float("inf"), float("nan"), None, 1.0]
    rows = [("a", i * 60_000_000, f"T{i:02d}", v) for i, v in enumerate(amounts)]
    df = spark.createDataFrame(rows, "key string, ts bigint, tie string, v double")
    small, dense = (
        {r["tie"]: r for r in R.activity_windows(df, "key", "ts", "tie", "v", (1,), limit, 10).collect()} for limit in (100, 1)
    )
    for tie, row in small.items():
        for c in ("count_1h", "sum_1h", "key_mean", "key_std"):
            assert row[c] == pytest.approx(dense[tie][c], rel=1e-9), (tie, c)
    assert small["T09"]["sum_1h"] == pytest.approx(4e-6) and small["T13"]["sum_1h"] == pytest.approx(1.000004)
    assert small["T13"]["count_1h"] == 14


AMOUNTS = [1e-13, 3e-13, 1e27, 2.5, 1e-13, -1e27, 1e300, 7e-7, float("inf"), float("nan"), None, 1e-13, 0.1, 1e12]


@pytest.mark.parametrize("dense_rows", [1_000, 1])
@pytest.mark.parametrize("minutes", [0, 7, 15, 60, 600])
def test_each_window_holds_its_own_amounts_only(spark, dense_rows, minutes):
    """Tiny, huge and non-finite amounts beside each other: exact sums of the frame, whatever else the key has."""
    import math

    rows = [("a" if i % 3 else "b", i * minutes * HOUR // 60 - 5 * HOUR, f"T{i:02d}", v) for i, v in enumerate(AMOUNTS * 3)]
    df = spark.createDataFrame(rows, "key string, ts bigint, tie string, v double")
    out = R.activity_windows(df, "key", "ts", "tie", "v", (1, 6, 24), dense_rows, 4).collect()
    assert len(out) == len(rows)
    for r in out:
        for h in (1, 6, 24):
            frame = [
                v for k, ts, tie, v in rows
                if k == r["key"] and (ts, tie) <= (r["ts"], r["tie"]) and ts > r["ts"] - h * HOUR
            ]
            finite = [v for v in frame if v is not None and math.isfinite(v)]
            assert r[f"count_{h}h"] == len(frame)
            # Rounding grows with the amounts of the frame, never with others.
            assert abs(r[f"sum_{h}h"] - math.fsum(finite)) <= 1e-14 * sum(map(abs, finite))


def test_sums_to_the_end_of_a_group(spark):
    from pyspark.sql import functions as F

    from riskweave.operators.ranking import running

    rows = [("hot" if i % 4 else "cold", i * 7 % 90, float(i)) for i in range(90)]
    df = spark.createDataFrame(rows, "g string, o int, v double")
    out = running(df, [F.col("o")], {"up": F.col("v")}, group=["g"], after={"down": F.col("v")}).collect()
    for r in out:
        assert r["up"] == sum(v for g, o, v in rows if g == r["g"] and o <= r["o"])
        assert r["down"] == sum(v for g, o, v in rows if g == r["g"] and o >= r["o"])


@pytest.mark.parametrize("dense_rows", [100, 1])
def test_tied_times_count_up_to_the_row(spark, dense_rows):
    half = HOUR // 2
    times = [0, half, half, 2 * half, 3 * half]
    rows = [("a", t, f"T{i}", 1.0) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "key string, ts bigint, tie string, v double")
    out = R.activity_windows(df, "key", "ts", "tie", "v", (1,), dense_rows, 10).orderBy("tie").collect()
    assert [r["count_1h"] for r in out] == [1, 2, 3, 3, 2]


@pytest.mark.parametrize("limit", [10_000, 30])
def test_previous_time(spark, skewed, limit):
    df = spark.createDataFrame(skewed, "key string, ts bigint, tie string, v double")
    want = brute(skewed, ())
    for row in R.with_previous_time(df, "key", "ts", "tie", "prev", limit).collect():
        assert row["prev"] == want[row["tie"]]["prev"]


@pytest.mark.parametrize("limit", [10_000, 30])
def test_counts_before_and_after(spark, skewed, limit):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(skewed, "key string, ts bigint, tie string, v double")
    out = R.window_counts(df, "key", "ts", "tie", {"big": (F.col("v") > 1000, -24 * HOUR, -1), "next": (F.col("v") > 0, 1, HOUR)}, limit).collect()
    assert len(out) == len(skewed)
    for r in out:
        want = sum(1 for k, ts, _, v in skewed if k == r["key"] and r["ts"] - 24 * HOUR <= ts < r["ts"] and v > 1000)
        assert r["big"] == want
        assert r["next"] == sum(1 for k, ts, _, v in skewed if k == r["key"] and r["ts"] < ts <= r["ts"] + HOUR)


def test_missing_times_take_the_position(spark):
    rows = [("T1", 5), ("T2", None), ("T3", None)]
    out = R.fill_missing_time(spark.createDataFrame(rows, "id string, ts bigint"), "ts", "id").orderBy("id").collect()
    assert [r["ts"] for r in out] == [5, 1_000_000, 2_000_000]


def test_chunks_grow_in_number_not_in_size(spark, skewed, monkeypatch):
    from riskweave.operators import ranking

    made, range_chunks = [], ranking.range_chunks

    def kept(*args):
        made.append(range_chunks(*args))
        return made[-1]

    monkeypatch.setattr(ranking, "range_chunks", kept)
    monkeypatch.setattr(ranking, "CHUNK_ROWS", 50, raising=False)
    df = spark.createDataFrame(skewed, "key string, ts bigint, tie string, v double")
    out = R.activity_windows(df, "key", "ts", "tie", "v", (1, 6, 24, 168), 30, 40).collect()
    sizes = [[r["count"] for r in chunks.groupBy("_chunk").count().collect()] for chunks in made]
    assert len(sizes) == 2 and max(map(max, sizes)) <= 150
    want = brute(skewed, (1, 6, 24, 168))
    for row in out:
        assert [row[f"count_{h}h"] for h in (1, 6, 24, 168)] == [want[row["tie"]][h][0] for h in (1, 6, 24, 168)]
        assert row["sum_168h"] == pytest.approx(want[row["tie"]][168][1])
        assert row["previous_ts"] == want[row["tie"]]["prev"]
