"""Ranking, threshold and calibration metrics, exact and distributed.

All curve metrics come from one table: distinct score per scorer, with the
labels at or above it. Rows are aggregated to distinct scores before anything
is ordered.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.scalars import clip01, number, ratio
from riskweave.operators.ranking import global_rank, running
from riskweave.runtime import cut


def _label(df: DataFrame, label: str) -> Column:
    if label not in df.columns:
        raise ValueError(f"Missing required label column: {label}")
    return number(label, 0.0).cast("int")


def long_scores(df: DataFrame, score_columns: Mapping[str, str], label: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(agent_name, score, y, ...) per row and scorer; absent columns are skipped."""
    present = {n: c for n, c in score_columns.items() if c in df.columns}
    y = _label(df, label)
    if not present:
        return df.select(F.lit("").alias("agent_name"), F.lit(0.0).alias("score"), y.alias("y"), *keep).limit(0)
    pairs = [
        F.struct(F.lit(n).alias("agent_name"), clip01(number(c, 0.0)).alias("score")) for n, c in present.items()
    ]
    return df.select(F.inline(F.array(*pairs)), y.alias("y"), *keep)


def score_cells(df: DataFrame, score_columns: Mapping[str, str], label: str) -> DataFrame:
    """Positives and negatives per scorer and distinct score."""
    return (
        long_scores(df, score_columns, label)
        .groupBy("agent_name", "score")
        .agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    )


def curve(df: DataFrame, score_columns: Mapping[str, str], label: str = "is_fraud") -> DataFrame:
    """Cells with running true and false positives (score at or above) and the
    scorer's totals.
    """
    cells = cut(score_cells(df, score_columns, label))
    run = running(cells, [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")}, group=["agent_name"])
    # One row per scorer.
    totals = cells.groupBy("agent_name").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    return run.join(F.broadcast(totals), "agent_name")


def _auc_roc() -> Column:
    """Rank-sum form: trapezoids over the distinct scores; one class gives 0.5."""
    area = F.sum(F.col("neg") * (F.col("tp") + F.col("tp") - F.col("pos")) / 2.0)
    p, n = F.max("all_pos"), F.max("all_neg")
    return F.when((p == 0) | (n == 0), F.lit(0.5)).otherwise(ratio(area, p.cast("double") * n, 0.5))


def _average_precision() -> Column:
    step = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return ratio(step, F.max("all_pos").cast("double"), 0.0)


def _f1() -> Column:
    return ratio(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("all_pos"))


def _pr_area() -> Column:
    """Trapezoids under the precision-recall curve from (recall 0, precision 1)."""
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    before = F.when(tp0 + fp0 == 0, 1.0).otherwise(ratio(tp0, tp0 + fp0))
    here = F.col("tp") / (F.col("tp") + F.col("fp"))
    return ratio(F.sum(F.col("pos") * (before + here) / 2.0), F.max("all_pos").cast("double"), 0.0)


def precision_at_fraction(
    df: DataFrame, score_columns: Mapping[str, str], fraction: float = 0.01, label: str = "is_fraud",
    id_column: str = "transaction_id", points: DataFrame | None = None,
) -> DataFrame:
    """Precision among the k = max(1, min(n, ceil(n * fraction))) best rows.

    Equal scores are ordered by id. Whole cells are taken from the curve; only
    rows with the score on which the cut falls are ranked.
    """
    if not 0.0 < fraction <= 1.0:
        raise ValueError("fraction must be in (0, 1]")
    points = points if points is not None else curve(df, score_columns, label)
    rows = F.col("all_pos") + F.col("all_neg")
    k = F.greatest(F.lit(1), F.least(rows, F.ceil(rows * F.lit(fraction))))
    seen = F.col("tp") + F.col("fp")
    mine = F.col("pos") + F.col("neg")
    whole = points.groupBy("agent_name").agg(
        F.max(k).alias("k"),
        F.coalesce(F.sum(F.when(seen <= k, F.col("pos"))), F.lit(0)).alias("hits"),
        F.max(F.when((seen > k) & (seen - mine < k), F.col("score"))).alias("edge"),
        F.max(F.when((seen > k) & (seen - mine < k), k - (seen - mine))).alias("still"),
    )
    # One row per scorer.
    edge = whole.filter(F.col("edge").isNotNull()).select("agent_name", F.col("edge").alias("score"), "still")
    tied = long_scores(df, score_columns, label, (id_column,)).join(F.broadcast(edge), ["agent_name", "score"])
    ranked = global_rank(tied, [F.col(id_column)], "_r", ["agent_name"])
    part = ranked.filter(F.col("_r") <= F.col("still")).groupBy("agent_name").agg(F.sum("y").alias("part"))
    return whole.join(F.broadcast(part), "agent_name", "left").select(
        "agent_name", ((F.col("hits") + F.coalesce("part", F.lit(0))) / F.col("k")).alias("precision_at_k")
    )


def evaluate(
    df: DataFrame, score_columns: Mapping[str, str], label: str = "is_fraud", fraction: float = 0.01,
    id_column: str = "transaction_id",
) -> DataFrame:
    """One metric row per scorer: areas, best F1 and its threshold, precision at
    the top fraction, Brier score, confusion counts at that threshold.

    Threshold candidates are 0, the distinct scores and 1; the lowest wins ties.
    """
    points = curve(df, score_columns, label)
    summed = points.groupBy("agent_name").agg(
        _auc_roc().alias("auc_roc"),
        _average_precision().alias("auc_pr"),
        F.max(_f1()).alias("best_f1"),
        F.max_by(F.struct("score", "tp", "fp"), F.struct(_f1(), -F.col("score"))).alias("best"),
        F.min("score").alias("least"),
        F.max("all_pos").alias("p"),
        F.max("all_neg").alias("n"),
        (
            F.sum(F.col("pos") * F.pow(1 - F.col("score"), 2) + F.col("neg") * F.pow("score", 2))
            / F.sum(F.col("pos") + F.col("neg"))
        ).alias("brier_score"),
    )
    # Threshold 0 takes all rows, as the least score does; with no positives
    # every F1 is 0 and the first candidate, 0, is chosen.
    zero = (F.col("best.score") == F.col("least")) | (F.col("best_f1") == 0)
    tp = F.when(zero, F.col("p")).otherwise(F.col("best.tp"))
    fp = F.when(zero, F.col("n")).otherwise(F.col("best.fp"))
    table = summed.select(
        "agent_name", "auc_roc", "auc_pr", F.col("best_f1").alias("f1_at_optimal_threshold"),
        F.when(zero, 0.0).otherwise(F.col("best.score")).alias("optimal_threshold"),
        "brier_score",
        (F.col("n") - fp).alias("tn"), fp.alias("fp"), (F.col("p") - tp).alias("fn"), tp.alias("tp"),
    )
    at_k = precision_at_fraction(df, score_columns, fraction, label, id_column, points)
    return table.join(F.broadcast(at_k), "agent_name")


def compare_system(metrics: DataFrame, meta_name: str = "meta_learner") -> DataFrame:
    """Best single scorer, stacked score, and the gain of the latter."""
    is_meta = F.col("agent_name") == meta_name
    best = F.coalesce(F.max(F.when(~is_meta, F.col("auc_roc"))), F.lit(0.0))
    meta = F.coalesce(F.max(F.when(is_meta, F.col("auc_roc"))), F.lit(0.0))
    return metrics.agg(
        best.alias("best_individual_auc_roc"), meta.alias("meta_auc_roc"), (meta - best).alias("auc_roc_delta")
    )


def auc_drop(metrics: DataFrame, reference_auc: float) -> DataFrame:
    """Each scorer's area against a reference value."""
    return metrics.select("agent_name", (F.lit(reference_auc) - F.col("auc_roc")).alias("auc_roc_delta"))


def detection_rates(
    df: DataFrame, score_columns: Mapping[str, str], pattern: str = "fraud_type", threshold: float = 0.5
) -> DataFrame:
    """Share of rows of each pattern that a scorer alerts on; null patterns drop out."""
    present = {n: c for n, c in score_columns.items() if c in df.columns}
    if pattern not in df.columns or not present:
        return df.sparkSession.createDataFrame([], "agent_name string, pattern string, detection_rate double, count bigint")
    pairs = [
        F.struct(F.lit(n).alias("agent_name"), (number(c, 0.0) >= threshold).cast("int").alias("hit"))
        for n, c in present.items()
    ]
    rows = df.filter(F.col(pattern).isNotNull()).select(
        F.col(pattern).cast("string").alias("pattern"), F.inline(F.array(*pairs))
    )
    return rows.groupBy("agent_name", "pattern").agg(
        F.avg("hit").alias("detection_rate"), F.count("*").alias("count")
    )


def confusion(df: DataFrame, score_columns: Mapping[str, str], threshold: float = 0.5, label: str = "is_fraud") -> DataFrame:
    """tn, fp, fn, tp per scorer at a fixed threshold; one pass."""
    hit = (F.col("score") >= threshold).cast("int")
    y = F.col("y")
    return long_scores(df, score_columns, label).groupBy("agent_name").agg(
        F.sum((1 - hit) * (1 - y)).alias("tn"), F.sum(hit * (1 - y)).alias("fp"),
        F.sum((1 - hit) * y).alias("fn"), F.sum(hit * y).alias("tp"),
    )


def class_report(df: DataFrame, flag: str, label: str = "is_fraud") -> DataFrame:
    """Precision, recall, F1 and support of both classes for a 0/1 flag."""
    y, p = _label(df, label), number(flag, 0.0).cast("int")
    one = df.agg(
        F.sum(p * y).alias("tp"), F.sum(p * (1 - y)).alias("fp"),
        F.sum((1 - p) * y).alias("fn"), F.sum((1 - p) * (1 - y)).alias("tn"),
    )

    def row(name: str, hit: str, wrong: str, missed: str):
        h, w, m = F.col(hit), F.col(wrong), F.col(missed)
        return F.struct(
            F.lit(name).alias("class"),
            ratio(h, h + w).alias("precision"),
            ratio(h, h + m).alias("recall"),
            ratio(2.0 * h, 2.0 * h + w + m).alias("f1"),
            (h + m).alias("support"),
        )

    return one.select(F.inline(F.array(row("legit", "tn", "fn", "fp"), row("suspicious", "tp", "fp", "fn"))))


def pr_curve(df: DataFrame, score_columns: Mapping[str, str], label: str = "is_fraud") -> DataFrame:
    """Precision and recall at every distinct score."""
    return curve(df, score_columns, label).select(
        "agent_name", "score",
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        ratio(F.col("tp"), F.col("all_pos").cast("double")).alias("recall"),
    )


def pr_area(df: DataFrame, score_columns: Mapping[str, str], label: str = "is_fraud") -> DataFrame:
    return curve(df, score_columns, label).groupBy("agent_name").agg(_pr_area().alias("pr_area"))


def comparison(df: DataFrame, score_columns: Mapping[str, str], label: str = "is_fraud", threshold: float = 0.5) -> DataFrame:
    """Areas and F1 at a fixed threshold per scorer, rounded, best area first."""
    hit = F.col("score") >= threshold
    tp, fp = F.sum(F.when(hit, F.col("pos")).otherwise(0)), F.sum(F.when(hit, F.col("neg")).otherwise(0))
    table = curve(df, score_columns, label).groupBy("agent_name").agg(
        F.round(_auc_roc(), 4).alias("auc_roc"),
        F.round(_average_precision(), 4).alias("auc_pr"),
        F.round(ratio(2.0 * tp, tp + fp + F.max("all_pos")), 4).alias("f1"),
    )
    return table.orderBy(F.col("auc_roc").desc(), "agent_name")


def scorer_overview(df: DataFrame, scorers: Mapping[str, float], label: str = "is_fraud") -> DataFrame:
    """Ranking area, precision-recall area and alert rate per scorer.

    ``scorers`` maps the score column prefix to the scorer's alert threshold.
    """
    columns = {n: f"{n}_score" for n in scorers}
    limit = F.create_map(*[F.lit(x) for pair in scorers.items() for x in pair])[F.col("agent_name")]
    alerts = F.sum(F.when(F.col("score") >= limit, F.col("pos") + F.col("neg")).otherwise(0))
    return curve(df, columns, label).groupBy("agent_name").agg(
        _auc_roc().alias("auc_roc"),
        _pr_area().alias("auc_pr"),
        (alerts / F.sum(F.col("pos") + F.col("neg"))).alias("alert_rate"),
    )
