"""Graph scorer: node risk from the payment graph, mapped to transactions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.scalars import account_column, clip01, words
from riskweave.operators import graph as G
from riskweave.operators.alerts import build_alerts, empty_alerts, has_columns
from riskweave.operators.skew import spread_join
from riskweave.runtime import cut
from riskweave.settings import alert_threshold, resolve

AGENT = "graph"
# Node matrix columns; amounts enter as log1p.
MATRIX = (
    "out_degree", "in_degree", "out_amount_sum_log", "in_amount_sum_log", "out_amount_mean_log",
    "in_amount_mean_log", "fan_out_ratio", "fan_in_ratio", "cross_border_fraction", "fraud_neighbor_fraction",
    "pagerank",
)


def heuristic_scores(feats: DataFrame) -> DataFrame:
    """(node, node_score, out_degree) from fan ratios, cross-border and fraud share."""
    feats = cut(feats)
    top = feats.agg(F.max("fan_out_ratio").alias("out"), F.max("fan_in_ratio").alias("in")).first()
    # Weights of the four parts.
    value = (
        0.3 * clip01(F.col("fan_out_ratio") / ((top["out"] or 0.0) + 1e-9))
        + 0.3 * clip01(F.col("fan_in_ratio") / ((top["in"] or 0.0) + 1e-9))
        + 0.2 * F.col("cross_border_fraction")
        + 0.2 * F.col("fraud_neighbor_fraction")
    )
    return feats.select("node", clip01(value).alias("node_score"), "out_degree")


def node_matrix(e: DataFrame, settings: Mapping | None = None, max_iter: int = 100) -> DataFrame:
    """Node features with PageRank."""
    rows = int(resolve(settings)["hot_key_rows"])
    return G.node_features(e).join(G.pagerank(e, max_iter=max_iter, rows_per_task=rows), "node")


def hop_features(e: DataFrame, matrix: DataFrame, settings: Mapping | None = None, weight: str | None = None):
    """Own features, mean over in-neighbours, and mean of those means.

    Two rounds of neighbour means stand for the two layers of a
    neighbour-aggregating network; ``weight='amount'`` weighs neighbours by
    money, in place of learned attention.
    """
    rows = int(resolve(settings)["hot_key_rows"])
    cols = list(MATRIX)
    pairs = cut(G.pair_weights(e, weight))
    one = cut(G.neighbour_means(pairs, matrix, cols, rows))
    return G.neighbour_means(pairs, one, [f"nbr_{c}" for c in cols], rows)


@dataclass
class NodeModel:
    """Fitted node classifier over own, one-hop and two-hop features."""

    pipeline: PipelineModel
    weight: str | None

    def save(self, spark: SparkSession, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        spark.createDataFrame([(self.weight,)], "weight string").write.parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NodeModel:
        return cls(PipelineModel.load(f"{path}/pipeline"), spark.read.parquet(f"{path}/meta").first()["weight"])


def fit(tx: DataFrame, settings: Mapping | None = None) -> tuple[NodeModel | None, DataFrame]:
    """(model, node scores). Fewer than two fraud nodes: heuristic scores, no model."""
    cfg = resolve(settings)
    e = G.edges(tx)
    matrix = cut(node_matrix(e, settings))
    balance = matrix.agg(F.sum("label").alias("pos"), F.count("*").alias("n")).first()
    pos, n = float(balance["pos"] or 0.0), float(balance["n"])
    if pos < 2:
        return None, heuristic_scores(matrix)
    weight = "amount" if str(cfg["graph_model_type"]).lower() == "gat" else None
    hops = cut(hop_features(e, matrix, settings, weight))
    inputs = [*MATRIX, *[f"nbr_{c}" for c in MATRIX], *[f"nbr_nbr_{c}" for c in MATRIX]]
    pos_weight = min(99.0, max(1.0, (n - pos) / max(pos, 1.0)))
    stages = [
        VectorAssembler(inputCols=inputs, outputCol="node_raw_vector"),
        StandardScaler(inputCol="node_raw_vector", outputCol="node_vector", withMean=True),
        LogisticRegression(
            featuresCol="node_vector", labelCol="label", weightCol="_w", maxIter=100, regParam=0.01,
            probabilityCol="node_prob", rawPredictionCol="node_raw", predictionCol="node_pred",
        ),
    ]
    train = hops.withColumn("label", (F.col("label") > 0).cast("double")).withColumn(
        "_w", F.when(F.col("label") > 0, pos_weight).otherwise(1.0)
    )
    model = NodeModel(Pipeline(stages=stages).fit(train), weight)
    return model, node_scores(hops, model)


def node_scores(hops: DataFrame, model: NodeModel) -> DataFrame:
    return model.pipeline.transform(hops).select("node", vector_to_array("node_prob")[1].alias("node_score"), "out_degree")


def map_to_transactions(tx: DataFrame, scores: DataFrame, settings: Mapping | None = None) -> DataFrame:
    """Sender's node score per transaction; unknown senders get the mean score."""
    rows = int(resolve(settings)["hot_key_rows"])
    sender = account_column(tx, "sender")
    keyed = tx.select(
        F.col("transaction_id").cast("string").alias("transaction_id"),
        (F.col(sender).cast("string") if sender else F.lit(None).cast("string")).alias("node"),
    )
    mean = scores.agg(F.avg("node_score")).first()[0] or 0.0
    joined = spread_join(keyed, scores, ["node"], "out_degree", "transaction_id", rows)
    return joined.select("transaction_id", F.coalesce("node_score", F.lit(mean)).alias("node_score"))


def score(
    tx: DataFrame,
    scores: DataFrame | None = None,
    settings: Mapping | None = None,
    scored_at: dt.datetime | None = None,
) -> DataFrame:
    """Alert rows from node scores; heuristic scores of ``tx`` when none are given."""
    if not has_columns(tx, ("transaction_id",)):
        return empty_alerts(tx.sparkSession)
    threshold = alert_threshold(AGENT, settings)
    sender, receiver = account_column(tx, "sender"), account_column(tx, "receiver")
    if scores is None:
        if sender is None or receiver is None:
            return build_alerts(
                tx, AGENT, F.lit(0.0), threshold, "NO_GRAPH_FEATURES",
                "Graph analysis: no account columns available.", scored_at,
            )
        scores = heuristic_scores(G.node_features(G.edges(tx)))
    mapped = map_to_transactions(tx, scores, settings)
    kind = str(resolve(settings)["graph_model_type"]).upper()
    reason = F.when(F.col("risk_score") >= threshold, "GRAPH_ANOMALY").otherwise("NORMAL_GRAPH")
    text = F.concat(F.lit(f"Graph analysis ({kind}): "), words(F.col("reason_code")), F.lit("."))
    return build_alerts(mapped, AGENT, F.col("node_score"), threshold, reason, text, scored_at)
