"""Files, raw mapping, alert tables."""

import pytest
from pyspark.sql import functions as F

from riskweave.operators import alerts as A
from riskweave.plans.views import raw_tx, tx
from riskweave.sources import canonical, files, schemas


def test_source_choice(spark, sf_dir, tmp_path):
    t = tx(spark, sf_dir)
    raw = raw_tx(spark, sf_dir)
    csv, nested, interim = f"{tmp_path}/raw.csv", f"{tmp_path}/in/a/b/transactions.parquet", f"{tmp_path}/interim.parquet"
    with pytest.raises(FileNotFoundError):
        files.load_transactions(spark, interim, f"{tmp_path}/in", csv, schemas.RAW_TRANSACTIONS)
    raw.write.csv(csv, header=True)
    args = (spark, interim, f"{tmp_path}/in", csv, schemas.RAW_TRANSACTIONS)
    assert files.load_transactions(*args, csv_rows=17).count() == 17
    assert files.load_transactions(*args, csv_rows=None).count() == raw.count()
    t.limit(5).write.parquet(nested)
    assert files.load_transactions(*args).count() == 5
    t.limit(3).write.parquet(interim)
    assert files.load_transactions(*args).count() == 3


def test_unknown_codes_take_the_default(spark):
    row = ("0", None, None, None, 1.0, "NPR", "Barter", None, None, "Qatar")
    schema = "transaction_id string, Date date, Time string, Sender_account string, amount_local_npr double, Payment_currency string, Payment_type string, transmode_code string, cross_border_flag int, Sender_bank_location string"
    df = spark.createDataFrame([row], schema).withColumn("Receiver_account", F.lit("9"))
    got = canonical.transactions(df).first()
    assert (got["transaction_type"], got["channel"], got["is_cross_border"], got["remittance_corridor"]) == ("payment", "branch", 0, None)
    assert got["timestamp"] is None


def test_scores_are_clipped_and_flagged(spark):
    df = spark.createDataFrame([("a", -0.5), ("b", 0.65), ("c", 7.0)], "transaction_id string, x double")
    out = {r["transaction_id"]: r for r in A.build_alerts(df, "custom", F.col("x"), 0.65).collect()}
    assert [out[i]["risk_score"] for i in "abc"] == [0.0, 0.65, 1.0]
    assert [out[i]["alert_flag"] for i in "abc"] == [0, 1, 1]
    assert df.columns == ["transaction_id", "x"]


def test_pivot_is_deterministic_with_duplicates(spark):
    rows = [("a", "velocity", 0.2), ("a", "velocity", 0.9), ("b", "graph", 0.4)]
    df = spark.createDataFrame(rows, "transaction_id string, agent_name string, risk_score double")
    got = {r["transaction_id"]: (r["velocity_score"], r["graph_score"]) for r in A.pivot_scores(df, ["velocity", "graph"]).collect()}
    assert got == {"a": (0.9, 0.0), "b": (0.0, 0.4)}


def test_partitioned_scores(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",)], "transaction_id string")
    both = A.build_alerts(df, "x", F.lit(0.1), 0.5).unionByName(A.build_alerts(df, "y", F.lit(0.9), 0.5))
    files.write_scores(both, f"{tmp_path}/scores")
    back = files.read_scores(spark, f"{tmp_path}/scores").filter("agent_name = 'y'")
    assert back.count() == 2 and back.agg(F.min("risk_score")).first()[0] == 0.9


def test_row_scorers_run_on_a_file_stream(spark, sf_dir, tmp_path):
    from riskweave.operators.contracts import with_violations
    from riskweave.scorers import geo

    path = f"{tmp_path}/stream"
    tx(spark, sf_dir).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    scored = geo.score(with_violations(stream, "transactions"))
    run = scored.writeStream.format("memory").queryName("scored_stream").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("scored_stream").count() == 1000
