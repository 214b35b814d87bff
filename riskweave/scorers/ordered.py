"""Boosted trees on ordered target statistics of the geographic categories."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.scalars import number_or
from riskweave.operators.target_stats import category_totals, ordered_means, with_totals
from riskweave.runtime import cut, materialise
from riskweave.scorers import geo
from riskweave.settings import resolve

CATEGORIES = tuple(f"f_{c}" for c in geo.CATEGORICAL)
INPUTS = [*[f"{c}_mean" for c in CATEGORIES], *[f"f_{c}" for c in geo.NUMERIC]]


@dataclass
class OrderedTrees:
    """Fitted state; the totals stay a stored table, so any number of categories fits."""

    totals: DataFrame
    prior: float
    strength: float
    hot_rows: int
    trees: PipelineModel

    def transform(self, frame: DataFrame) -> DataFrame:
        """Add ``geo_prob`` to rows of ``geo.features``, as ``geo.score`` expects of a model."""
        rows = with_totals(frame, self.totals, CATEGORIES, "transaction_id", self.prior, self.strength, self.hot_rows)
        return self.trees.transform(rows)

    def save(self, spark: SparkSession, path: str) -> None:
        self.totals.write.parquet(f"{path}/totals")
        spark.createDataFrame([(self.prior, self.strength, self.hot_rows)], "prior double, strength double, hot_rows long").write.parquet(f"{path}/meta")
        self.trees.write().save(f"{path}/trees")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> OrderedTrees:
        m = spark.read.parquet(f"{path}/meta").first()
        return cls(spark.read.parquet(f"{path}/totals"), m["prior"], m["strength"], m["hot_rows"], PipelineModel.load(f"{path}/trees"))


def fit(tx: DataFrame, settings: Mapping | None = None, strength: float = 1.0) -> OrderedTrees | None:
    """Fit on labelled rows with a ``transaction_id``; None unless the label has two classes."""
    if "is_fraud" not in tx.columns:
        return None
    cfg = resolve(settings)
    seed = int(cfg["geo_risk_random_seed"])
    rows = geo.features(tx.withColumn("_y", number_or(tx, "is_fraud", 0.0).cast("int")), ("transaction_id", "_y"))
    rows = cut(rows)
    n, positives = rows.agg(F.count("_y"), F.sum("_y")).first()
    if not n or positives in (0, n):
        return None
    prior = positives / n
    totals = materialise(category_totals(rows, CATEGORIES, "_y"), "category-totals")
    train = cut(
        ordered_means(rows, CATEGORIES, "_y", "transaction_id", prior, strength, seed)
        .select(*INPUTS, F.col("_y").cast("double").alias("label"))
    )
    stages = [
        VectorAssembler(inputCols=INPUTS, outputCol="geo_vector"),
        GBTClassifier(
            featuresCol="geo_vector", labelCol="label", maxIter=int(cfg["geo_risk_iterations"]),
            maxDepth=int(cfg["geo_risk_depth"]), stepSize=float(cfg["geo_risk_learning_rate"]), seed=seed, predictionCol="geo_pred",
        ).setProbabilityCol("geo_prob").setRawPredictionCol("geo_raw"),
    ]
    return OrderedTrees(totals, prior, strength, int(cfg["hot_key_rows"]), Pipeline(stages=stages).fit(train))
