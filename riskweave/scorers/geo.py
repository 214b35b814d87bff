"""Geographic risk: corridor, countries, currency and IP signals."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.dims import corridor_score
from riskweave.functions.scalars import first_present, number_or, text_or, words
from riskweave.operators.alerts import build_alerts, empty_alerts, has_columns
from riskweave.runtime import cut
from riskweave.settings import alert_threshold, resolve

AGENT = "geo_risk"
CATEGORICAL = ("sender_country", "receiver_country", "remittance_corridor", "original_currency", "ip_country")
NUMERIC = ("is_cross_border", "ip_is_vpn", "corridor_risk", "ip_country_mismatch")
# Accepted column names per feature, best first.
SOURCES = {
    "sender_country": ("sender_country", "country"),
    "receiver_country": ("receiver_country", "country"),
    "remittance_corridor": ("remittance_corridor",),
    "original_currency": ("original_currency", "currency"),
    "ip_country": ("ip_country", "country"),
}
_SIGNALS = (
    "sender_country", "receiver_country", "country", "remittance_corridor", "original_currency", "currency",
    "ip_country", "ip_is_vpn", "is_cross_border",
)


def features(tx: DataFrame, keep: tuple[str, ...] = ("transaction_id",)) -> DataFrame:
    """Five categories and four numbers per transaction; a plain projection."""
    base = tx.select(
        *[F.col(c) for c in keep if c in tx.columns],
        *[text_or(tx, first_present(tx, names), "unknown").alias(f"f_{n}") for n, names in SOURCES.items()],
        number_or(tx, "is_cross_border", 0.0).alias("f_is_cross_border"),
        number_or(tx, "ip_is_vpn", 0.0).alias("f_ip_is_vpn"),
    )
    mismatch = (F.col("f_ip_country") != F.col("f_sender_country")) & (F.col("f_is_cross_border") == 0)
    return base.select(
        "*",
        corridor_score(F.col("f_remittance_corridor")).alias("f_corridor_risk"),
        mismatch.cast("double").alias("f_ip_country_mismatch"),
    )


def rule_score() -> Column:
    # Weights of the transparent score.
    return (
        0.45 * F.col("f_corridor_risk")
        + 0.25 * F.col("f_ip_is_vpn")
        + 0.20 * F.col("f_is_cross_border")
        + 0.10 * F.col("f_ip_country_mismatch")
    )


def reason() -> Column:
    return (
        F.when(F.col("f_ip_is_vpn") > 0, "VPN_OR_PROXY")
        .when(F.col("f_ip_country_mismatch") > 0, "IP_COUNTRY_MISMATCH")
        .when(F.col("f_corridor_risk") >= 0.85, "HIGH_RISK_CORRIDOR")
        .when(F.col("f_is_cross_border") > 0, "CROSS_BORDER")
        .otherwise("DOMESTIC")
    )


def training_cells(tx: DataFrame) -> DataFrame:
    """Distinct feature combinations with the weight of each label.

    Every feature is a code or a flag, so equal rows collapse: the model sees
    the same weighted loss, and its passes run over combinations, not rows.
    """
    names = [f"f_{n}" for n in (*CATEGORICAL, *NUMERIC)]
    y = number_or(tx, "is_fraud", 0.0).cast("int")
    labelled = features(tx.withColumn("_y", y), ("_y",))
    cells = labelled.groupBy(*names, F.col("_y").cast("double").alias("label")).agg(
        F.count("*").cast("double").alias("rows")
    )
    return cells


def fit(tx: DataFrame, settings: Mapping | None = None, kind: str = "boosted") -> PipelineModel | None:
    """Boosted trees, or balanced logistic regression with ``kind='logistic'``.

    None (transparent score) unless the label has two classes.
    """
    if "is_fraud" not in tx.columns:
        return None
    cells = cut(training_cells(tx))
    totals = {r["label"]: r["n"] for r in cells.groupBy("label").agg(F.sum("rows").alias("n")).collect()}
    if len(totals) < 2:
        return None
    cfg = resolve(settings)
    names = [f"f_{n}" for n in CATEGORICAL]
    numeric = [f"f_{n}" for n in NUMERIC]
    index = StringIndexer(inputCols=names, outputCols=[f"{n}_ix" for n in names], handleInvalid="keep").fit(cells)
    if kind == "boosted":
        widest = max(len(labels) for labels in index.labelsArray) + 1
        stages = [
            index,
            VectorAssembler(inputCols=[*[f"{n}_ix" for n in names], *numeric], outputCol="geo_vector"),
            GBTClassifier(
                featuresCol="geo_vector", labelCol="label", weightCol="weight",
                maxIter=int(cfg["geo_risk_iterations"]), maxDepth=int(cfg["geo_risk_depth"]),
                stepSize=float(cfg["geo_risk_learning_rate"]), seed=int(cfg["geo_risk_random_seed"]),
                maxBins=max(32, widest), predictionCol="geo_pred",
            )
            .setProbabilityCol("geo_prob")
            .setRawPredictionCol("geo_raw"),
        ]
        weight = F.col("rows")
    else:
        n = sum(totals.values())
        balanced = {label: n / (2.0 * rows) for label, rows in totals.items()}
        weight = F.col("rows") * F.when(F.col("label") == 1.0, balanced.get(1.0, 1.0)).otherwise(balanced.get(0.0, 1.0))
        stages = [
            index,
            OneHotEncoder(
                inputCols=[f"{n}_ix" for n in names], outputCols=[f"{n}_oh" for n in names],
                dropLast=False, handleInvalid="keep",
            ),
            VectorAssembler(inputCols=[*[f"{n}_oh" for n in names], *numeric], outputCol="geo_vector"),
            LogisticRegression(
                featuresCol="geo_vector", labelCol="label", weightCol="weight", maxIter=300,
                regParam=1.0 / n, standardization=False, probabilityCol="geo_prob",
                rawPredictionCol="geo_raw", predictionCol="geo_pred",
            ),
        ]
    return Pipeline(stages=stages).fit(cells.withColumn("weight", weight))


def score(
    tx: DataFrame,
    model: PipelineModel | None = None,
    settings: Mapping | None = None,
    scored_at: dt.datetime | None = None,
) -> DataFrame:
    """Alert rows; with no geographic column at all the score is 0."""
    if not has_columns(tx, ("transaction_id",)):
        return empty_alerts(tx.sparkSession)
    frame = features(tx)
    if not any(c in tx.columns for c in _SIGNALS):
        value = F.lit(0.0)
    elif model is None:
        value = rule_score()
    else:
        frame = model.transform(frame)
        value = vector_to_array("geo_prob")[1]
    text = F.concat(F.lit("Geographic analysis: "), words(F.col("reason_code")), F.lit("."))
    return build_alerts(frame, AGENT, value, alert_threshold(AGENT, settings), reason(), text, scored_at)
