"""Metrics of the scorers."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.evaluation import metrics as M
from riskweave.plans import parts as P
from riskweave.plans import sqltext as S
from riskweave.plans.registry import query

_AUC = "coalesce(sum(neg * (tp + tp - pos) / 2.0::DOUBLE) / nullif(max(p)::DOUBLE * max(n), 0), 0.5)"
_AP = "coalesce(sum(pos * tp::DOUBLE / (tp + fp)) / nullif(max(p), 0), 0)"
_BEST = """f1s AS (SELECT agent_name, 0.0::DOUBLE AS t, max(p) AS tp, max(n) AS fp, max(p) AS p, max(n) AS n FROM cum GROUP BY agent_name
 UNION ALL SELECT agent_name, s, tp, fp, p, n FROM cum),
scored AS (SELECT *, 2.0::DOUBLE * tp / (tp + fp + p) AS f1 FROM f1s),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY agent_name ORDER BY f1 DESC, t) = 1)"""
_PK = """pk AS (SELECT agent_name, avg(y) AS precision_at_k FROM (SELECT *, row_number() OVER (PARTITION BY agent_name ORDER BY s DESC, transaction_id) AS r,
 count(*) OVER (PARTITION BY agent_name) AS cnt FROM el) WHERE r <= greatest(1, least(cnt, ceil(cnt * 0.01))) GROUP BY agent_name)"""


@query("e1_auc_roc", f"SELECT agent_name, round({_AUC}, 6) AS auc_roc FROM cum GROUP BY agent_name", ctes=S.CURVE_ALL)
def e1(spark, d):
    return P.rounded(M.evaluate(P.evaluated(spark, d), P.EVAL_COLUMNS).select("agent_name", "auc_roc"), "auc_roc")


@query("e2_average_precision", f"SELECT agent_name, round({_AP}, 6) AS auc_pr FROM cum GROUP BY agent_name", ctes=S.CURVE_ALL)
def e2(spark, d):
    return P.rounded(M.evaluate(P.evaluated(spark, d), P.EVAL_COLUMNS).select("agent_name", "auc_pr"), "auc_pr")


@query(
    "e3_best_f1_threshold",
    "SELECT agent_name, round(t, 6) AS optimal_threshold, round(f1, 6) AS f1_at_optimal_threshold FROM best",
    ctes=(*S.CURVE_ALL, _BEST),
)
def e3(spark, d):
    cols = ("optimal_threshold", "f1_at_optimal_threshold")
    return P.rounded(M.evaluate(P.evaluated(spark, d), P.EVAL_COLUMNS).select("agent_name", *cols), *cols)


@query("e4_precision_at_fraction", "SELECT agent_name, round(precision_at_k, 6) AS precision_at_k FROM pk", ctes=(*S.EVAL_ALL, _PK))
def e4(spark, d):
    return P.rounded(M.precision_at_fraction(P.evaluated(spark, d), P.EVAL_COLUMNS, 0.01), "precision_at_k")


@query("e5_brier_score", "SELECT agent_name, round(avg(pow(y - s, 2)), 6) AS brier_score FROM el GROUP BY agent_name", ctes=S.EVAL_ALL)
def e5(spark, d):
    return P.rounded(M.evaluate(P.evaluated(spark, d), P.EVAL_COLUMNS).select("agent_name", "brier_score"), "brier_score")


_MATRIX = "CAST(n - fp AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(p - tp AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp"


@query("e6_confusion_matrix", f"SELECT agent_name, {_MATRIX} FROM best", ctes=(*S.CURVE_ALL, _BEST))
def e6(spark, d):
    return M.evaluate(P.evaluated(spark, d), P.EVAL_COLUMNS).select("agent_name", "tn", "fp", "fn", "tp")


_E7 = """m AS (SELECT agent_name, {auc} AS auc_roc, {ap} AS auc_pr FROM cum GROUP BY agent_name),
br AS (SELECT agent_name, avg(pow(y - s, 2)) AS brier_score FROM el GROUP BY agent_name)""".format(auc=_AUC, ap=_AP)


@query(
    "e7_metric_table",
    f"""SELECT agent_name, round(auc_roc, 6) AS auc_roc, round(auc_pr, 6) AS auc_pr, round(f1, 6) AS f1_at_optimal_threshold, round(t, 6) AS optimal_threshold,
 round(brier_score, 6) AS brier_score, {_MATRIX}, round(precision_at_k, 6) AS precision_at_k
 FROM m JOIN br USING (agent_name) JOIN best USING (agent_name) JOIN pk USING (agent_name)""",
    ctes=(*S.CURVE_ALL, _BEST, _PK, _E7),
)
def e7(spark, d):
    columns = {**P.EVAL_COLUMNS, "absent": "absent_score"}
    return P.rounded(
        M.evaluate(P.evaluated(spark, d), columns),
        "auc_roc", "auc_pr", "f1_at_optimal_threshold", "optimal_threshold", "brier_score", "precision_at_k",
    )


@query(
    "e8_system_gain",
    """SELECT round(best, 6) AS best_individual_auc_roc, round(meta, 6) AS meta_auc_roc, round(meta - best, 6) AS auc_roc_delta FROM
 (SELECT max(auc_roc) FILTER (WHERE agent_name <> 'meta_learner') AS best, max(auc_roc) FILTER (WHERE agent_name = 'meta_learner') AS meta FROM m)""",
    ctes=(*S.CURVE_ALL, _E7),
)
def e8(spark, d):
    out = M.compare_system(M.evaluate(P.evaluated(spark, d), P.EVAL_COLUMNS))
    return P.rounded(out, *out.columns)


@query(
    "e9_recall_at_own_threshold",
    """SELECT agent_name, fraud_type AS pattern, round(avg(CASE WHEN s >= 0.6 THEN 1 ELSE 0 END), 6) AS detection_rate, count(*) AS count
 FROM el JOIN ev USING (transaction_id) WHERE fraud_type IS NOT NULL GROUP BY agent_name, fraud_type""",
    ctes=S.EVAL_ALL,
)
def e9(spark, d):
    return P.rounded(M.detection_rates(P.evaluated(spark, d), P.EVAL_COLUMNS, threshold=0.6), "detection_rate")


_REPORT = """c AS (SELECT sum(f * y) AS tp, sum(f * (1 - y)) AS fp, sum((1 - f) * y) AS fn, sum((1 - f) * (1 - y)) AS tn FROM
 (SELECT y, CASE WHEN behaviour_score >= 0.7 THEN 1 ELSE 0 END AS f FROM ev))"""


def _row(name: str, hit: str, wrong: str, missed: str) -> str:
    return (
        f"SELECT '{name}' AS class, round(coalesce({hit}::DOUBLE / nullif({hit} + {wrong}, 0), 0), 6) AS precision, round(coalesce({hit}::DOUBLE / nullif({hit} + {missed}, 0), 0), 6) AS recall, "
        f"round(coalesce(2.0::DOUBLE * {hit} / nullif(2 * {hit} + {wrong} + {missed}, 0), 0), 6) AS f1, CAST({hit} + {missed} AS BIGINT) AS support FROM c"
    )


@query(
    "e10_class_report",
    _row("legit", "tn", "fn", "fp") + " UNION ALL " + _row("suspicious", "tp", "fp", "fn"),
    ctes=(*S.EVAL_ALL, _REPORT),
)
def e10(spark, d):
    flagged = P.evaluated(spark, d).withColumn("flag", (F.col("behaviour_score") >= 0.7).cast("int"))
    return P.rounded(M.class_report(flagged, "flag"), "precision", "recall", "f1")


_PR_AREA = """coalesce(sum(pos * ((CASE WHEN tp - pos + fp - neg = 0 THEN 1.0 ELSE (tp - pos)::DOUBLE / (tp - pos + fp - neg) END) + tp::DOUBLE / (tp + fp)) / 2.0::DOUBLE) / nullif(max(p), 0), 0)"""


@query("e11_pr_area", f"SELECT agent_name, round({_PR_AREA}, 6) AS pr_area FROM cum GROUP BY agent_name", ctes=S.CURVE_ALL)
def e11(spark, d):
    return P.rounded(M.pr_area(P.evaluated(spark, d), P.EVAL_COLUMNS), "pr_area")


@query(
    "e11_pr_curve",
    "SELECT agent_name, round(s, 6) AS score, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / p AS recall FROM cum",
    ctes=S.CURVE_ALL,
)
def e11_curve(spark, d):
    return P.rounded(M.pr_curve(P.evaluated(spark, d), P.EVAL_COLUMNS), "score")


_COMPARE = f"""SELECT agent_name, round({_AUC}, 4) AS auc_roc, round({_AP}, 4) AS auc_pr,
 round(coalesce(2.0::DOUBLE * sum(CASE WHEN s >= 0.5 THEN pos ELSE 0 END) / nullif(sum(CASE WHEN s >= 0.5 THEN pos + neg ELSE 0 END) + max(p), 0), 0), 4) AS f1 FROM cum GROUP BY agent_name"""


@query("e12_f1_at_half", _COMPARE, ctes=S.CURVE_ALL)
def e12(spark, d):
    return M.comparison(P.evaluated(spark, d), P.EVAL_COLUMNS)


@query("t4_comparison_table", _COMPARE + " ORDER BY auc_roc DESC, agent_name", ctes=S.CURVE_ALL)
def t4(spark, d):
    return M.comparison(P.evaluated(spark, d), P.EVAL_COLUMNS)


@query(
    "e13_scorer_overview",
    f"""SELECT agent_name, round({_AUC}, 6) AS auc_roc, round({_PR_AREA}, 6) AS auc_pr,
 round(sum(CASE WHEN s >= CASE agent_name WHEN 'geo_risk' THEN 0.65 WHEN 'behaviour' THEN 0.7 ELSE 0.5 END THEN pos + neg ELSE 0 END)::DOUBLE / sum(pos + neg), 6) AS alert_rate
 FROM cum GROUP BY agent_name""",
    ctes=S.CURVE_ALL,
)
def e13(spark, d):
    limits = {"geo_risk": 0.65, "behaviour": 0.7, "meta_learner": 0.5}
    return P.rounded(M.scorer_overview(P.evaluated(spark, d), limits), "auc_roc", "auc_pr", "alert_rate")


@query(
    "e6_confusion_at_half",
    """SELECT agent_name, CAST(sum((1 - h) * (1 - y)) AS BIGINT) AS tn, CAST(sum(h * (1 - y)) AS BIGINT) AS fp, CAST(sum((1 - h) * y) AS BIGINT) AS fn,
 CAST(sum(h * y) AS BIGINT) AS tp FROM (SELECT *, CASE WHEN s >= 0.5 THEN 1 ELSE 0 END AS h FROM el) GROUP BY agent_name""",
    ctes=S.EVAL_ALL,
)
def e6_half(spark, d):
    return M.confusion(P.evaluated(spark, d), P.EVAL_COLUMNS)
