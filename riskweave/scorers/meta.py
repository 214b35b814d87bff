"""Stacking: one calibrated score from the scores of all scorers."""

from __future__ import annotations

import datetime as dt
import itertools
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.scalars import clip01, number, words
from riskweave.operators.alerts import build_alerts, empty_alerts, has_columns, pivot_scores
from riskweave.operators.ranking import global_rank
from riskweave.runtime import cut
from riskweave.scorers.attribution import TreeParts, model_nodes, tree_attributions
from riskweave.settings import alert_threshold, resolve

AGENT = "meta_learner"
# Scorer order of the meta features.
AGENTS = ("velocity", "geo_risk", "behaviour", "kyc_aml", "graph")
# Values a feature is trained on (as many as the trees tell apart), rows a cell of them is drawn as, rows of a task.
BINS, BLOCKS, ROWS_PER_TASK = 32, 16, 50_000


def feature_columns(df: DataFrame, extra: Sequence[str] = ()) -> list[str]:
    """Score columns in scorer order, then extra ones given by name."""
    known = [f"{a}_score" for a in AGENTS if f"{a}_score" in df.columns]
    return known + [c for c in extra if c in df.columns and c not in known]


def widen(df: DataFrame) -> DataFrame:
    """Long scores (with or without a label) to one row per transaction; wide input as it is."""
    if has_columns(df, ("agent_name", "risk_score")):
        return pivot_scores(df, AGENTS, "is_fraud" if "is_fraud" in df.columns else None)
    return df


def feature_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """transaction_id and the aligned features; absent or null scores are 0."""
    wide = widen(df)
    cols = [number(c, 0.0).alias(c) if c in wide.columns else F.lit(0.0).alias(c) for c in columns]
    label = [number("is_fraud", 0.0).alias("is_fraud")] if "is_fraud" in wide.columns else []
    return wide.select(F.col("transaction_id").cast("string").alias("transaction_id"), *cols, *label)


def average(columns: Sequence[str]) -> Column:
    return clip01(sum((F.col(c) for c in columns), F.lit(0.0)) / F.lit(float(max(len(columns), 1))))


@dataclass
class MetaModel:
    """Fitted members (classifier, calibrator or None); their mean is the score."""

    kind: str
    columns: list[str]
    members: list[tuple[Any, Any]] = field(default_factory=list)

    def transform(self, df: DataFrame, out: str = "meta_score") -> DataFrame:
        """Add the score column; the average of the features without members."""
        if not self.members:
            return df.withColumn(out, average(self.columns))
        frame = VectorAssembler(inputCols=self.columns, outputCol="_x").transform(df)
        parts = []
        for i, (model, calibrator) in enumerate(self.members):
            frame = _raw(model, frame, f"_raw{i}")
            if calibrator is not None:
                frame = _calibrated(calibrator, frame, f"_raw{i}", f"_p{i}")
                parts.append(f"_p{i}")
            else:
                parts.append(f"_raw{i}")
        mean = sum((F.col(p) for p in parts), F.lit(0.0)) / float(len(parts))
        return frame.select(*df.columns, mean.alias(out))

    def importances(self, spark: SparkSession) -> DataFrame:
        """(feature, importance) of the first member, most important first."""
        rows = []
        if self.members:
            values = self.members[0][0].featureImportances.toArray()
            rows = [(c, float(v)) for c, v in zip(self.columns, values)]
        table = spark.createDataFrame(rows, "feature string, importance double")
        return table.orderBy(F.col("importance").desc(), "feature")

    def save(self, spark: SparkSession, path: str) -> None:
        meta = []
        for i, (model, calibrator) in enumerate(self.members):
            model.write().overwrite().save(f"{path}/member{i}")
            if calibrator is not None:
                calibrator.write().overwrite().save(f"{path}/calibrator{i}")
            meta.append((i, type(model).__name__, type(calibrator).__name__ if calibrator is not None else None))
        spark.createDataFrame([(self.kind, self.columns)], "kind string, columns array<string>").write.parquet(
            f"{path}/meta"
        )
        spark.createDataFrame(meta, "i int, model string, calibrator string").write.parquet(f"{path}/members")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> MetaModel:
        kinds = {
            c.__name__: c
            for c in (
                RandomForestClassificationModel, GBTClassificationModel, IsotonicRegressionModel, LogisticRegressionModel,
            )
        }
        meta = spark.read.parquet(f"{path}/meta").first()
        members = []
        for row in spark.read.parquet(f"{path}/members").orderBy("i").collect():
            calibrator = kinds[row["calibrator"]].load(f"{path}/calibrator{row['i']}") if row["calibrator"] else None
            members.append((kinds[row["model"]].load(f"{path}/member{row['i']}"), calibrator))
        return cls(meta["kind"], list(meta["columns"]), members)


def _raw(model, df: DataFrame, out: str) -> DataFrame:
    named = model.copy().setFeaturesCol("_x").setProbabilityCol("_prob").setRawPredictionCol("_rawp").setPredictionCol("_pred")
    return named.transform(df).withColumn(out, vector_to_array("_prob")[1]).drop("_prob", "_rawp", "_pred")


def _calibrated(calibrator, df: DataFrame, source: str, out: str) -> DataFrame:
    if isinstance(calibrator, IsotonicRegressionModel):
        return calibrator.copy().setFeaturesCol(source).setPredictionCol(out).transform(df)
    one = VectorAssembler(inputCols=[source], outputCol="_c").transform(df)
    named = calibrator.copy().setFeaturesCol("_c").setProbabilityCol("_cp").setRawPredictionCol("_cr").setPredictionCol("_cd")
    return named.transform(one).withColumn(out, vector_to_array("_cp")[1]).drop("_c", "_cp", "_cr", "_cd")


def _marks(df: DataFrame, columns: Sequence[str]) -> dict[str, list[float]]:
    """Values that stand for each feature's: all of them, or BINS quantiles over all rows if there are more."""
    found = {c: [r[0] for r in df.select(c).distinct().limit(BINS + 1).collect()] for c in columns}
    many = [c for c in columns if len(found[c]) > BINS]
    if many:
        shares = [(i + 0.5) / BINS for i in range(BINS)]
        found.update(zip(many, df.approxQuantile(many, shares, 1e-3), strict=True))
    return {c: sorted({v + 0.0 for v in values if math.isfinite(v)}) or [0.0] for c, values in found.items()}


def _nearest(column: str, marks: Sequence[float]) -> Column:
    """The mark next to a value. Trees split halfway between marks, so a row and its marks go the same way."""
    out = None
    for low, high in itertools.pairwise(marks):
        fits = F.col(column) <= F.lit((low + high) / 2.0)
        out = F.when(fits, F.lit(low)) if out is None else out.when(fits, F.lit(low))
    return F.lit(marks[-1]) if out is None else out.otherwise(F.lit(marks[-1]))


def _training_cells(ranked: DataFrame, columns: Sequence[str], part: Column) -> DataFrame:
    """Features, label, part and weight: rows alike in marks, label and part are counted together.

    All rows count. A cell comes as up to BLOCKS rows of equal weight, which the trees draw on their own, so that
    their draws differ within a cell too; one with fewer rows comes as these. The passes over the training
    data then grow with the cells, not with the rows.
    """
    marks = _marks(ranked, columns)
    near = ranked.select("label", part.alias("part"), *[_nearest(c, marks[c]).alias(c) for c in columns])
    cells = cut(near.groupBy("label", "part", *columns).agg(F.count("*").alias("n")))
    blocks = F.least(F.col("n"), F.lit(BLOCKS))
    tasks = max(1, math.ceil((cells.agg(F.sum(blocks)).first()[0] or 0) / ROWS_PER_TASK))
    # In a fixed order: a refit draws the same rows.
    spread = cells.withColumn("n", F.explode(F.array_repeat(F.col("n") / blocks, blocks.cast("int"))))
    dealt = spread.repartition(tasks, *columns).sortWithinPartitions(*columns, "label", "part")
    return VectorAssembler(inputCols=list(columns), outputCol="_x").transform(cut(dealt))


def _score_cells(df: DataFrame) -> DataFrame:
    """Raw scores on a grid of 1e-4 with mean label and weight.

    At most 10,001 points reach the calibrator however many rows were scored.
    """
    return df.groupBy(F.round("_raw", 4).alias("raw")).agg(
        (F.sum(F.col("label") * F.col("n")) / F.sum("n")).alias("label"), F.sum("n").alias("weight")
    )


def _forest(cfg: Mapping, seed: int) -> RandomForestClassifier:
    depth = cfg["meta_learner_max_depth"] or cfg["meta_learner_default_max_depth"]
    return RandomForestClassifier(
        featuresCol="_x", labelCol="label", weightCol="_w", numTrees=int(cfg["meta_learner_n_estimators"]),
        maxDepth=int(depth), maxBins=BINS, seed=seed, featureSubsetStrategy="sqrt", cacheNodeIds=True,
    )


def _balanced(train: DataFrame, counts: Mapping[float, int]) -> DataFrame:
    n = sum(counts.values())
    w = {c: n / (2.0 * k) for c, k in counts.items() if k}
    return train.withColumn("_w", F.col("n") * F.when(F.col("label") == 1.0, w.get(1.0, 1.0)).otherwise(w.get(0.0, 1.0)))


def _class_counts(df: DataFrame, weight: Column | None = None) -> dict[float, int]:
    n = F.count("*") if weight is None else F.round(F.sum(weight)).cast("bigint")
    return {r["label"]: r["n"] for r in df.groupBy("label").agg(n.alias("n")).collect()}


def fit(df: DataFrame, settings: Mapping | None = None, extra: Sequence[str] = ()) -> MetaModel:
    """Calibrated forest, or boosted trees for ``meta_learner_model_type='xgboost'``.

    Without a two-class label the model is the average of the scores.
    """
    cfg = resolve(settings)
    kind = str(cfg["meta_learner_model_type"]).lower()
    wide = widen(df)
    columns = feature_columns(wide, extra)
    if "is_fraud" not in wide.columns or not columns:
        return MetaModel(kind, columns)
    matrix = feature_matrix(wide, columns).withColumn("label", (F.col("is_fraud") > 0).cast("double"))
    seed = int(cfg["random_seed"])
    # Position within the class, in seeded hash order: the stratified split.
    hashed = F.xxhash64("transaction_id", F.lit(seed))
    ranked = cut(global_rank(matrix, [hashed, F.col("transaction_id")], "_rank", ["label"]))
    counts = _class_counts(ranked)
    if len(counts) < 2:
        return MetaModel(kind, columns)
    if kind == "xgboost":
        data = _training_cells(ranked, columns, F.lit(0))
        return MetaModel(kind, columns, [(_fit_boosted(data, counts, cfg, seed), None)])
    folds = min(int(cfg["meta_learner_calibration_cv"]), *counts.values())
    if folds < 2:
        return MetaModel(kind, columns, [_fit_holdout(ranked, columns, counts, cfg, seed)])
    data = _training_cells(ranked, columns, F.col("_rank") % folds)
    members = []
    for k in range(folds):
        mine = F.col("part") == k
        train = data.filter(~mine)
        forest = _forest(cfg, seed + k).fit(_balanced(train, _class_counts(train, F.col("n"))))
        held = _raw(forest, data.filter(mine), "_raw")
        iso = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight").fit(_score_cells(held))
        members.append((forest, iso))
    return MetaModel(kind, columns, members)


def _fit_holdout(ranked: DataFrame, columns: Sequence[str], counts: Mapping[float, int], cfg: Mapping, seed: int):
    """Too few rows of one class for folds: hold out a share, sigmoid calibration."""
    share = float(cfg["meta_learner_calibration_val_fraction"])
    held = F.when(F.col("label") == 1.0, F.col("_rank") <= math.floor(share * counts.get(1.0, 0))).otherwise(
        F.col("_rank") <= math.floor(share * counts.get(0.0, 0))
    )
    data = _training_cells(ranked, columns, held.cast("int"))
    train, rest = data.filter("part = 0"), data.filter("part = 1")
    forest = _forest(cfg, seed).fit(_balanced(train, _class_counts(train, F.col("n"))))
    if len(_class_counts(rest)) < 2:
        # One class only gives no slope: calibrate on all rows.
        rest = data
    cells = _raw(forest, rest, "_raw").groupBy(F.round("_raw", 4).alias("raw"), "label").agg(F.sum("n").alias("weight"))
    sigmoid = LogisticRegression(featuresCol="_c", labelCol="label", weightCol="weight").fit(
        VectorAssembler(inputCols=["raw"], outputCol="_c").transform(cells)
    )
    return forest, sigmoid


def _fit_boosted(data: DataFrame, counts: Mapping[float, int], cfg: Mapping, seed: int):
    weight = min(99.0, max(1.0, counts.get(0.0, 0) / max(counts.get(1.0, 0), 1)))
    depth = cfg["meta_learner_max_depth"] or cfg["meta_learner_xgb_default_max_depth"]
    train = data.withColumn("_w", F.col("n") * F.when(F.col("label") == 1.0, weight).otherwise(1.0))
    return GBTClassifier(
        featuresCol="_x", labelCol="label", weightCol="_w", maxIter=int(cfg["meta_learner_n_estimators"]),
        maxDepth=int(depth), maxBins=BINS, stepSize=float(cfg["meta_learner_xgb_learning_rate"]),
        subsamplingRate=float(cfg["meta_learner_xgb_subsample"]),
        featureSubsetStrategy=str(cfg["meta_learner_xgb_colsample_bytree"]), seed=seed,
    ).fit(train)


def score(
    df: DataFrame,
    model: MetaModel,
    settings: Mapping | None = None,
    scored_at: dt.datetime | None = None,
) -> DataFrame:
    """Alert rows: one per input row, also for long input (joined by id)."""
    if not has_columns(df, ("transaction_id",)):
        return empty_alerts(df.sparkSession)
    threshold = alert_threshold(AGENT, settings)
    scored = model.transform(feature_matrix(df, model.columns)).select("transaction_id", "meta_score")
    if has_columns(df, ("agent_name", "risk_score")):
        scored = df.select(F.col("transaction_id").cast("string").alias("transaction_id")).join(
            scored, "transaction_id", "left"
        )
    reason = F.when(F.col("risk_score") >= threshold, "META_ALERT").otherwise("META_NORMAL")
    label = model.kind.replace("_", " ")
    text = F.concat(F.lit(f"Meta-learner ({label}): "), words(F.col("reason_code")), F.lit("."))
    value = F.coalesce(F.col("meta_score"), F.lit(0.0))
    return build_alerts(scored, AGENT, value, threshold, reason, text, scored_at)


def attributions(
    rows: DataFrame,
    columns: Sequence[str],
    predict: Callable[[DataFrame], DataFrame],
    baseline: Mapping[str, float],
) -> DataFrame:
    """Exact Shapley values per row: transaction_id and ``phi_<column>``.

    ``predict`` adds ``meta_score``. Each row is scored once per subset of
    features, with the other features at their baseline; the copies of a row
    are summed before the shuffle, so one row per transaction crosses it.
    """
    columns = list(columns)
    size = len(columns)
    subsets = []
    for mask in itertools.product((0, 1), repeat=size):
        k = sum(mask)
        inside = math.factorial(k - 1) * math.factorial(size - k) / math.factorial(size) if k else 0.0
        outside = math.factorial(k) * math.factorial(size - k - 1) / math.factorial(size) if k < size else 0.0
        subsets.append(
            F.struct(
                F.array(*[F.lit(bool(m)) for m in mask]).alias("on"),
                F.array(*[F.lit(inside if m else -outside) for m in mask]).alias("coef"),
            )
        )
    copies = rows.select("transaction_id", *columns, F.explode(F.array(*subsets)).alias("_s"))
    mixed = copies.select(
        "transaction_id",
        F.col("_s.coef").alias("_coef"),
        *[F.when(F.col("_s.on")[i], F.col(c)).otherwise(F.lit(float(baseline[c]))).alias(c) for i, c in enumerate(columns)],
    )
    return (
        predict(mixed)
        .groupBy("transaction_id")
        .agg(*[F.sum(F.col("meta_score") * F.col("_coef")[i]).alias(f"phi_{c}") for i, c in enumerate(columns)])
    )


def member_attributions(df: DataFrame, model: MetaModel) -> DataFrame:
    """Parts of the first member's score before calibration: transaction_id, ``phi_<column>`` and baseline.

    Without members, the parts of the average against the feature means.
    """
    rows = feature_matrix(df, model.columns)
    if not model.members:
        means = feature_means(rows, model.columns)
        base = sum(means.values()) / max(len(means), 1)
        return attributions(rows, model.columns, model.transform, means).withColumn("baseline", F.lit(float(base)))
    parts = TreeParts.of(model_nodes(df.sparkSession, model.members[0][0]), len(model.columns))
    return tree_attributions(rows, model.columns, parts)


def member_value(df: DataFrame, model: MetaModel, out: str = "member_value") -> DataFrame:
    """Add what ``member_attributions`` explain: the first member's probability, a boosted member's margin, or the average."""
    if not model.members:
        return df.withColumn(out, average(model.columns))
    member = model.members[0][0]
    frame = _raw(member, VectorAssembler(inputCols=model.columns, outputCol="_x").transform(df), "_p")
    p = F.col("_p")
    # A boosted margin m gives the probability 1 / (1 + exp(-2 m)).
    value = F.log(p / (1 - p)) / 2 if isinstance(member, GBTClassificationModel) else p
    return frame.select(*df.columns, value.alias(out))


def feature_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    return df.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns]).first().asDict()


def top_reasons(phi: DataFrame, columns: Sequence[str], n: int = 3) -> DataFrame:
    """(transaction_id, attribution_reasons): names of the largest positive parts."""
    items = F.array(*[F.struct((-F.col(f"phi_{c}")).alias("neg"), F.lit(c.removesuffix("_score")).alias("name")) for c in columns])
    positive = F.filter(F.array_sort(items), lambda x: x["neg"] < 0)
    return phi.select("transaction_id", F.transform(F.slice(positive, 1, n), lambda x: x["name"]).alias("attribution_reasons"))
