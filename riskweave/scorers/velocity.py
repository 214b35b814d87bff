"""Velocity: rolling sender activity, isolation forest and spike rule."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.functions.scalars import account_column, amount_of, clip01, event_micros, ratio, text_or, words
from riskweave.operators.alerts import build_alerts, empty_alerts, has_columns
from riskweave.operators.rolling import activity_windows, fill_missing_time
from riskweave.settings import alert_threshold, resolve

AGENT = "velocity"
SAMPLE_ROWS = 256


def feature_names(hours) -> list[str]:
    return [
        "amount_npr",
        *[f"sender_count_{h}h" for h in hours],
        *[f"sender_sum_{h}h" for h in hours],
        "seconds_since_sender_txn",
        "amount_zscore",
    ]


def features(tx: DataFrame, settings: Mapping | None = None) -> DataFrame:
    """transaction_id and the eleven activity features.

    The z-score uses the sender's whole history; it is 0 where mean or
    deviation are 0 or undefined.
    """
    cfg = resolve(settings)
    hours = cfg["velocity_windows_hours"]
    base = tx.select(
        F.col("transaction_id").cast("string").alias("transaction_id"),
        text_or(tx, account_column(tx, "sender"), "__missing__").alias("sender"),
        event_micros(tx).alias("ts"),
        amount_of(tx).alias("amount"),
    )
    timed = fill_missing_time(base, "ts", "transaction_id")
    rolled = activity_windows(
        timed, "sender", "ts", "transaction_id", "amount", hours, int(cfg["dense_key_rows"]), int(cfg["hot_key_rows"])
    )
    return rolled.select("transaction_id", *feature_expressions(hours))


def feature_expressions(hours) -> list[Column]:
    """The eleven features from the columns of the activity windows."""
    z = (F.col("amount") - F.nullif(F.col("key_mean"), F.lit(0.0))) / F.nullif(F.col("key_std"), F.lit(0.0))
    return [
        F.col("amount").alias("amount_npr"),
        *[F.col(f"count_{h}h").alias(f"sender_count_{h}h") for h in hours],
        *[F.col(f"sum_{h}h").alias(f"sender_sum_{h}h") for h in hours],
        F.coalesce((F.col("ts") - F.col("previous_ts")) / 1e6, F.lit(86400.0)).alias("seconds_since_sender_txn"),
        F.abs(F.coalesce(z, F.lit(0.0))).alias("amount_zscore"),
    ]


@dataclass
class IsolationForest:
    """Fitted trees as one bounded node table, and the score range of the fit."""

    columns: list[str]
    nodes: pd.DataFrame  # tree, node, feature, threshold, left, right, depth_value
    sample: int
    low: float
    high: float

    def save(self, spark: SparkSession, path: str) -> None:
        meta = [(self.columns, self.sample, self.low, self.high)]
        spark.createDataFrame(meta, "columns array<string>, sample int, low double, high double").write.parquet(
            f"{path}/meta"
        )
        spark.createDataFrame(self.nodes, _NODE_SCHEMA).coalesce(1).write.parquet(f"{path}/nodes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IsolationForest:
        m = spark.read.parquet(f"{path}/meta").first()
        nodes = spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").toPandas()
        return cls(list(m["columns"]), nodes, m["sample"], m["low"], m["high"])


_NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, depth_value double"


def _mean_depth(n: int) -> float:
    """Expected depth of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _tree_builder(columns: list[str], seed: int):
    """Grow one isolation tree from the sampled rows of one tree number."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values("transaction_id")[columns].to_numpy(float)
        rng = np.random.default_rng([seed, tree])
        limit = int(np.ceil(np.log2(max(len(x), 2))))
        rows: list[tuple] = []
        todo = [(np.arange(len(x)), 0)]
        slots = [None]  # parent row and side of each pending node
        while todo:
            idx, depth = todo.pop()
            slot = slots.pop()
            me = len(rows)
            if slot is not None:
                rows[slot[0]][slot[1]] = me
            part = x[idx]
            spread = part.max(axis=0) - part.min(axis=0)
            usable = np.flatnonzero(spread > 0)
            if depth >= limit or len(idx) <= 1 or len(usable) == 0:
                rows.append([tree, me, -1, 0.0, -1, -1, depth + _mean_depth(len(idx))])
                continue
            f = int(rng.choice(usable))
            cut_at = float(rng.uniform(part[:, f].min(), part[:, f].max()))
            goes_left = part[:, f] <= cut_at
            if goes_left.all():
                goes_left = part[:, f] < part[:, f].max()
            rows.append([tree, me, f, cut_at, -1, -1, 0.0])
            todo += [(idx[goes_left], depth + 1), (idx[~goes_left], depth + 1)]
            slots += [(me, 4), (me, 5)]
        return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right", "depth_value"])

    return build


def _path_udf(spark: SparkSession, nodes: pd.DataFrame):
    """Arrow UDF: mean path length over all trees."""
    packed = []
    for _, t in nodes.groupby("tree", sort=True):
        t = t.sort_values("node")
        packed.append(tuple(t[c].to_numpy() for c in ("feature", "threshold", "left", "right", "depth_value")))
    forest = spark.sparkContext.broadcast(packed)

    @F.pandas_udf("double")
    def path(x: pd.DataFrame) -> pd.Series:
        m = x.to_numpy(float)
        total = np.zeros(len(m))
        at_row = np.arange(len(m))
        for feature, threshold, left, right, value in forest.value:
            pos = np.zeros(len(m), dtype=np.int64)
            while True:
                f = feature[pos]
                inner = f >= 0
                if not inner.any():
                    break
                go_left = m[at_row, np.where(inner, f, 0)] <= threshold[pos]
                pos = np.where(inner, np.where(go_left, left[pos], right[pos]), pos)
            total += value[pos]
        return pd.Series(total / max(len(forest.value), 1))

    return path


def _raw_score(feats: DataFrame, model_nodes: pd.DataFrame, columns: list[str], sample: int) -> Column:
    path = _path_udf(feats.sparkSession, model_nodes)
    norm = max(_mean_depth(sample), 1e-9)
    return F.pow(F.lit(2.0), -path(F.struct(*columns)) / norm)


def fit(feats: DataFrame, settings: Mapping | None = None) -> IsolationForest | None:
    """Isolation forest over a feature table; None for fewer than two rows.

    A seeded hash picks a pool of trees x 256 rows, and in it the rows of each
    tree, so the sample does not depend on partitioning. Trees are grown in
    parallel, one small group each; the node table is at most trees x 511 rows.
    """
    cfg = resolve(settings)
    trees, seed = int(cfg["velocity_isolation_estimators"]), int(cfg["random_seed"])
    columns = feature_names(cfg["velocity_windows_hours"])
    n = feats.count()
    if n < 2:
        return None
    # A pool of about four times the rows the trees need, then for each tree
    # about twice its rows, then exactly its rows: all by hash thresholds and
    # a small ranking, never by sorting the table.
    pool_rows = min(n, 4 * trees * SAMPLE_ROWS)
    scale = 1_000_000_000
    pool = feats.select("transaction_id", *columns)
    if pool_rows < n:
        chosen = F.pmod(F.xxhash64("transaction_id", F.lit(seed)), F.lit(scale))
        pool = pool.filter(chosen < int(scale * pool_rows / n) + 1)
    near = int(scale * min(1.0, 2.0 * SAMPLE_ROWS / pool_rows)) + 1

    def draw(tree: Column) -> Column:
        return F.xxhash64("transaction_id", tree, F.lit(seed))

    member = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(draw(t), F.lit(scale)) < near
    )
    drawn = pool.select("*", F.explode(member).alias("tree"))
    pick = Window.partitionBy("tree").orderBy(F.pmod(draw(F.col("tree")), F.lit(scale)), "transaction_id")
    sampled = drawn.withColumn("_r", F.row_number().over(pick)).filter(F.col("_r") <= SAMPLE_ROWS).drop("_r")
    nodes = sampled.groupBy("tree").applyInPandas(_tree_builder(columns, seed), _NODE_SCHEMA).toPandas()
    sample = min(n, SAMPLE_ROWS)
    raw = feats.select(_raw_score(feats, nodes, columns, sample).alias("_s"))
    span = raw.agg(F.min("_s").alias("low"), F.max("_s").alias("high")).first()
    return IsolationForest(columns, nodes, sample, float(span["low"]), float(span["high"]))


def model_score(feats: DataFrame, model: IsolationForest | None) -> Column:
    """Isolation score scaled to the range seen in the fit."""
    if model is None:
        return F.lit(0.0)
    raw = _raw_score(feats, model.nodes, model.columns, model.sample)
    return clip01((raw - model.low) / max(model.high - model.low, 1e-9))


def spike_score(settings: Mapping | None = None) -> tuple[Column, Column]:
    """(is a spike, its score) from the one-hour count."""
    least = int(resolve(settings)["velocity_spike_min_transactions"])
    spike = F.col("sender_count_1h") >= least
    return spike, F.when(spike, F.least(F.col("sender_count_1h") / 10.0, F.lit(1.0))).otherwise(0.0)


def score_features(
    feats: DataFrame,
    model: IsolationForest | None,
    settings: Mapping | None = None,
    scored_at: dt.datetime | None = None,
) -> DataFrame:
    """Alert rows from the feature table; the higher of model and spike score."""
    threshold = alert_threshold(AGENT, settings)
    scored = feats.withColumn("_model", model_score(feats, model))
    spike, spiked = spike_score(settings)
    reason = (
        F.when(spike, "VELOCITY_SPIKE")
        .when(F.col("_model") >= threshold, "ISOLATION_ANOMALY")
        .otherwise("NORMAL_VELOCITY")
    )
    text = F.concat(F.lit("Velocity analysis: "), words(F.col("reason_code")), F.lit("."))
    return build_alerts(scored, AGENT, F.greatest(F.col("_model"), spiked), threshold, reason, text, scored_at)


def score(tx: DataFrame, model: IsolationForest | None, settings: Mapping | None = None, scored_at=None) -> DataFrame:
    if not has_columns(tx, ("transaction_id",)):
        return empty_alerts(tx.sparkSession)
    return score_features(features(tx, settings), model, settings, scored_at)
