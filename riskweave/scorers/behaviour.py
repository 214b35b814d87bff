"""Account behaviour: amount anomaly, or a classifier over the last steps."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions import dims
from riskweave.functions.scalars import account_column, amount_column, amount_of, words
from riskweave.operators.alerts import build_alerts, empty_alerts, has_columns
from riskweave.operators.sequences import behaviour_rows, normalisation, sequences
from riskweave.runtime import cut, partitions
from riskweave.scorers.recurrent import GatedUnit, scored, train
from riskweave.settings import alert_threshold, resolve

AGENT = "behaviour"
#: Windows from which a training round takes another task, up to the session's shuffle partitions.
WINDOWS_PER_TASK = 256
UNIT_STATS = {"amount_mean": 0.0, "amount_std": 1.0, "time_mean": 0.0, "time_std": 1.0}


def fit_stats(tx: DataFrame, settings: Mapping | None = None) -> dict[str, float]:
    """Mean and deviation of amount and time delta."""
    if account_column(tx, "sender") is None:
        return amount_stats(tx)
    rows = behaviour_rows(tx)
    return normalisation(rows, int(resolve(settings)["hot_key_rows"])).first().asDict()


def amount_stats(tx: DataFrame) -> dict[str, float]:
    """Mean and deviation of the amount only, all the heuristic needs; no shuffle."""
    row = tx.agg(F.avg(amount_of(tx)), F.stddev_samp(amount_of(tx))).first()
    return {**UNIT_STATS, "amount_mean": row[0] or 0.0, "amount_std": row[1] or 1.0}


def heuristic(tx: DataFrame, stats: Mapping[str, float]) -> Column:
    """Logistic of half the absolute amount z-score; 0 without an amount column."""
    if amount_column(tx) is None:
        return F.lit(0.0)
    z = (amount_of(tx) - stats["amount_mean"]) / max(stats["amount_std"], 1e-9)
    return 1.0 / (1.0 + F.exp(-0.5 * F.abs(z)))


def score_heuristic(
    tx: DataFrame, stats: Mapping[str, float], settings: Mapping | None = None, scored_at: dt.datetime | None = None
) -> DataFrame:
    if not has_columns(tx, ("transaction_id",)):
        return empty_alerts(tx.sparkSession)
    threshold = alert_threshold(AGENT, settings)
    if account_column(tx, "sender") is None:
        return build_alerts(tx, AGENT, heuristic(tx, stats), threshold, "BEHAVIOUR_HEURISTIC", scored_at=scored_at)
    reason = F.when(F.col("risk_score") >= threshold, "HEURISTIC_ANOMALY").otherwise("NORMAL_BEHAVIOUR")
    text = F.concat(F.lit("Behaviour analysis (heuristic): "), words(F.col("reason_code")), F.lit("."))
    return build_alerts(tx, AGENT, heuristic(tx, stats), threshold, reason, text, scored_at)


def _one_hot(col: Column, size: int) -> Column:
    return F.array(*[(col == i).cast("double") for i in range(size + 1)])


#: Numbers of a step: one for each category and for none, and the amount and the time.
STEP_WIDTH = len(dims.TRANSACTION_TYPES) + 1 + len(dims.CHANNELS) + 1 + 2


def sequence_arrays(seq: DataFrame) -> DataFrame:
    """Flatten the steps: one-hot categories and the two numbers of each step."""
    step = F.transform(
        "steps",
        lambda s: F.concat(
            _one_hot(s["type_id"], len(dims.TRANSACTION_TYPES)),
            _one_hot(s["channel_id"], len(dims.CHANNELS)),
            F.array(s["amount_norm"], s["time_norm"]),
        ),
    )
    return seq.select("account", "ids", "label", F.flatten(step).alias("features"))


def sequence_vectors(seq: DataFrame) -> DataFrame:
    return sequence_arrays(seq).withColumn("features", array_to_vector("features"))


@dataclass
class SequenceModel:
    """Fitted network (recurrent or feed-forward), normalisation and sequence length."""

    network: GatedUnit | MultilayerPerceptronClassificationModel
    stats: dict[str, float]
    length: int

    def save(self, spark: SparkSession, path: str) -> None:
        recurrent = isinstance(self.network, GatedUnit)
        if recurrent:
            self.network.save(spark, f"{path}/unit")
        else:
            self.network.write().overwrite().save(f"{path}/network")
        spark.createDataFrame([(recurrent,)], "recurrent boolean").write.parquet(f"{path}/kind")
        row = {**self.stats, "length": self.length}
        schema = ", ".join(f"{k} double" for k in UNIT_STATS) + ", length int"
        spark.createDataFrame([tuple(row.values())], schema).write.parquet(f"{path}/stats")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SequenceModel:
        row = spark.read.parquet(f"{path}/stats").first().asDict()
        length = row.pop("length")
        if spark.read.parquet(f"{path}/kind").first()["recurrent"]:
            return cls(GatedUnit.load(spark, f"{path}/unit"), row, length)
        return cls(MultilayerPerceptronClassificationModel.load(f"{path}/network"), row, length)


def _dealt(windows: DataFrame, n: int) -> DataFrame:
    """Windows by account in a fixed order, so that a refit adds up the same windows in the same tasks.

    A round sends the parameters to every task and their gradient back, so tasks are no more than windows need.
    """
    tasks = min(partitions(windows.sparkSession), -(-n // WINDOWS_PER_TASK))
    return cut(windows.repartition(tasks, "account").sortWithinPartitions("account"))


def fit(tx: DataFrame, settings: Mapping | None = None) -> SequenceModel | None:
    """Sequence classifier over account windows; None without two classes.

    A gated recurrent unit for ``behaviour_model_type='gru'``, else a feed-forward
    network over the flattened window. Both train across executors.
    """
    cfg = resolve(settings)
    if account_column(tx, "sender") is None or "is_fraud" not in tx.columns:
        return None
    stats = fit_stats(tx, settings)
    stats = {k: stats[k] for k in UNIT_STATS}
    length = int(cfg["behaviour_seq_len"])
    windows = sequence_arrays(sequences(behaviour_rows(tx), stats, length)).drop("ids")
    rows = cut(windows.withColumn("label", (F.col("label") > 0).cast("double")))
    n, positive = rows.agg(F.count("*"), F.sum("label")).first()
    if not n or not 0 < positive < n:
        return None
    rows = _dealt(rows, n)
    if str(cfg["behaviour_model_type"]).lower() == "gru":
        unit, _ = train(
            rows, STEP_WIDTH, length, int(cfg["behaviour_hidden_dim"]), int(cfg["behaviour_max_iter"]),
            float(cfg["behaviour_learning_rate"]), int(cfg["random_seed"]), 0.5 * (n - positive) / positive, n,
        )
        return SequenceModel(unit, stats, length)
    network = MultilayerPerceptronClassifier(
        layers=[length * STEP_WIDTH, int(cfg["behaviour_hidden_dim"]), 2],
        maxIter=int(cfg["behaviour_max_iter"]),
        seed=int(cfg["random_seed"]),
    ).fit(rows.withColumn("features", array_to_vector("features")))
    return SequenceModel(network, stats, length)


def sequence_scores(tx: DataFrame, model: SequenceModel) -> DataFrame:
    """(account, ids, seq_score), one row per account."""
    seq = sequences(behaviour_rows(tx), model.stats, model.length)
    if isinstance(model.network, GatedUnit):
        return scored(sequence_arrays(seq), model.network, model.length)
    seq = sequence_vectors(seq)
    return model.network.transform(seq).select(
        "account", "ids", vector_to_array("probability")[1].alias("seq_score")
    )


def spread_back(tx: DataFrame, scored: DataFrame) -> DataFrame:
    """Window score for the transactions inside the window, 0.0 for older ones.

    The at most 16 ids per account are joined by transaction id, a unique key,
    so busy accounts cause no skew.
    """
    inside = scored.select(F.explode("ids").alias("transaction_id"), "seq_score")
    return (
        tx.select(F.col("transaction_id").cast("string").alias("transaction_id"))
        .join(inside, "transaction_id", "left")
        .fillna(0.0, ["seq_score"])
    )


def score(
    tx: DataFrame,
    model: SequenceModel | None,
    stats: Mapping[str, float] | None = None,
    settings: Mapping | None = None,
    scored_at: dt.datetime | None = None,
) -> DataFrame:
    """Alert rows from the sequence model, or from the heuristic without one."""
    if not has_columns(tx, ("transaction_id",)):
        return empty_alerts(tx.sparkSession)
    if model is None or account_column(tx, "sender") is None:
        return score_heuristic(tx, stats or amount_stats(tx), settings, scored_at)
    threshold = alert_threshold(AGENT, settings)
    mapped = spread_back(tx, sequence_scores(tx, model))
    kind = str(resolve(settings)["behaviour_model_type"]).upper()
    reason = F.when(F.col("risk_score") >= threshold, "SEQUENCE_ANOMALY").otherwise("NORMAL_BEHAVIOUR")
    text = F.concat(F.lit(f"Behaviour analysis ({kind}): "), words(F.col("reason_code")), F.lit("."))
    return build_alerts(mapped, AGENT, F.col("seq_score"), threshold, reason, text, scored_at)
