"""Scorers, stacking and explanations."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from riskweave.operators.sequences import behaviour_rows, sequences
from riskweave.operators.target_stats import ordered_means
from riskweave.plans import parts as P
from riskweave.plans import sqltext as S
from riskweave.plans.registry import query
from riskweave.plans.views import tx
from riskweave.runtime import cut
from riskweave.scorers import behaviour, compliance, explanation, geo, meta, network, ordered, velocity
from riskweave.scorers.attribution import TreeParts, tree_attributions
from riskweave.settings import DEFAULTS

# ---------------------------------------------------------------- velocity

_VF = """vf AS (SELECT transaction_id, a AS amount_npr, c1::DOUBLE AS sender_count_1h, c6::DOUBLE AS sender_count_6h, c24::DOUBLE AS sender_count_24h,
 c168::DOUBLE AS sender_count_168h, s1 AS sender_sum_1h, s6 AS sender_sum_6h, s24 AS sender_sum_24h, s168 AS sender_sum_168h,
 since AS seconds_since_sender_txn, z AS amount_zscore FROM vw JOIN vl USING (transaction_id))"""
_VCOLS = velocity.feature_names(DEFAULTS["velocity_windows_hours"])


@query(
    "ve1_velocity_features",
    "SELECT transaction_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _VCOLS) + " FROM vf",
    ctes=(S.VT, S.VW, S.VL, _VF),
)
def ve1(spark, d):
    return P.rounded(velocity.features(tx(spark, d)), *_VCOLS)


@query("ve2_isolation_forest")
def ve2(spark, d):
    feats = cut(velocity.features(tx(spark, d)))
    model = velocity.fit(feats)
    return feats.select("transaction_id", F.round(velocity.model_score(feats, model), 6).alias("model_score"))


@query(
    "ve3_spike_rule",
    "SELECT transaction_id, CASE WHEN c1 >= 3 THEN 1 ELSE 0 END AS spike, round(CASE WHEN c1 >= 3 THEN least(c1 / 10.0, 1.0) ELSE 0 END::DOUBLE, 6) AS spike_score FROM vw",
    ctes=(S.VT, S.VW),
)
def ve3(spark, d):
    spike, value = velocity.spike_score()
    return velocity.features(tx(spark, d)).select(
        "transaction_id", spike.cast("int").alias("spike"), F.round(value, 6).alias("spike_score")
    )


@query(
    "ve4_velocity_rules_only",
    """SELECT transaction_id, 'velocity' AS agent_name, round(risk_score, 6) AS risk_score, CASE WHEN risk_score >= 0.7 THEN 1 ELSE 0 END AS alert_flag, reason_code,
 'Velocity analysis: ' || lower(replace(reason_code, '_', ' ')) || '.' AS explanation FROM vel""",
    ctes=S.VEL_ALL,
)
def ve4(spark, d):
    return P.rounded(velocity.score(tx(spark, d), None).drop("timestamp"), "risk_score")


@query("ve4_velocity_with_model")
def ve4_model(spark, d):
    feats = cut(velocity.features(tx(spark, d)))
    return P.rounded(velocity.score_features(feats, velocity.fit(feats)).drop("timestamp"), "risk_score")


# --------------------------------------------------------------------- geo

_GCOLS = [f"f_{c}" for c in (*geo.CATEGORICAL, *geo.NUMERIC)]


@query("ge1_geo_features", f"SELECT transaction_id, {', '.join(_GCOLS)} FROM geo_f", ctes=(S.GEO_F,))
def ge1(spark, d):
    return geo.features(tx(spark, d))


@query("ge2_geo_score", "SELECT transaction_id, round(risk_score, 6) AS risk_score FROM geo", ctes=(S.GEO_F, S.GEO))
def ge2(spark, d):
    return geo.features(tx(spark, d)).select("transaction_id", F.round(geo.rule_score(), 6).alias("risk_score"))


@query("ge3_geo_boosted_trees")
def ge3(spark, d):
    t = tx(spark, d)
    return P.rounded(geo.score(t, geo.fit(t)).drop("timestamp"), "risk_score")


@query("ge4_geo_logistic")
def ge4(spark, d):
    t = tx(spark, d)
    return P.rounded(geo.score(t, geo.fit(t, kind="logistic")).drop("timestamp"), "risk_score")


@query(
    "ge5_geo_alerts",
    """SELECT transaction_id, 'geo_risk' AS agent_name, round(risk_score, 6) AS risk_score, CASE WHEN risk_score >= 0.65 THEN 1 ELSE 0 END AS alert_flag, reason_code,
 'Geographic analysis: ' || lower(replace(reason_code, '_', ' ')) || '.' AS explanation FROM geo""",
    ctes=(S.GEO_F, S.GEO),
)
def ge5(spark, d):
    return P.rounded(geo.score(tx(spark, d)).drop("timestamp"), "risk_score")


@query(
    "ge3_training_cells",
    f"SELECT {', '.join(_GCOLS)}, is_fraud::DOUBLE AS label, count(*)::DOUBLE AS rows FROM geo_f JOIN tx USING (transaction_id) GROUP BY ALL",
    ctes=(S.GEO_F,),
)
def ge3_cells(spark, d):
    return geo.training_cells(tx(spark, d))


_MEANS = ",\n ".join(
    f"(coalesce(sum(y) OVER {c}, 0)::DOUBLE + prior) / (count(y) OVER {c} + 1)::DOUBLE AS f_{c}_mean" for c in geo.CATEGORICAL
)
_ORDERS = ", ".join(
    f"{c} AS (PARTITION BY f_{c} ORDER BY place, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    for c in geo.CATEGORICAL
)


@query(
    "ge3_ordered_target_means",
    f"SELECT transaction_id, {_MEANS} FROM r WINDOW {_ORDERS}",
    ctes=(
        S.GEO_F,
        "r AS (SELECT geo_f.*, is_fraud AS y, md5('42:' || transaction_id) AS place, (SELECT avg(is_fraud) FROM tx) AS prior FROM geo_f JOIN tx USING (transaction_id))",
    ),
)
def ge3_means(spark, d):
    t = tx(spark, d)
    prior = t.agg(F.avg("is_fraud")).first()[0]
    rows = geo.features(t, ("transaction_id", "is_fraud"))
    out = ordered_means(rows, ordered.CATEGORIES, "is_fraud", "transaction_id", prior)
    # One division of equal whole numbers: the same double in both engines, so nothing is rounded.
    return out.select("transaction_id", *[f"{c}_mean" for c in ordered.CATEGORIES])


# -------------------------------------------------------------- compliance

_KY_VIEWS = ("tx", "ac")


@query(
    "ky1_rule_flags",
    'SELECT transaction_id, r_pep AS "r_PEP", r_sanctions AS "r_SANCTIONS", r_kyc AS "r_KYC_UNVERIFIED", r_new AS "r_NEW_ACCOUNT", r_high AS "r_HIGH_RISK_GRADE", r_struct AS "r_STRUCTURING", r_layer AS "r_LAYERING" FROM kyc_r',
    views=_KY_VIEWS,
    ctes=S.KYC_ALL[:2],
)
def ky1(spark, d):
    return compliance.rule_flags(P.joined(spark, d)).select("transaction_id", *[f"r_{r}" for r in compliance.RULES])


@query(
    "ky2_structuring_band",
    "SELECT transaction_id, round(amount_npr, 2) AS amount_npr FROM tx WHERE amount_npr BETWEEN 900000 AND 999000",
)
def ky2(spark, d):
    hits = compliance.rule_flags(tx(spark, d)).filter("r_STRUCTURING = 1")
    return P.rounded(hits.select("transaction_id", "amount_npr"), "amount_npr", digits=2)


@query(
    "ky3_layering",
    "SELECT sender_account_id, remittance_corridor, count(*) AS n FROM tx WHERE is_cross_border = 1 GROUP BY 1, 2 HAVING count(*) >= 2",
)
def ky3(spark, d):
    hits = compliance.rule_flags(tx(spark, d)).filter("r_LAYERING = 1")
    return hits.groupBy("sender_account_id", "remittance_corridor").agg(F.count("*").alias("n"))


@query(
    "ky4_compliance_score",
    "SELECT transaction_id, round(risk_score, 6) AS risk_score, CASE WHEN risk_score >= 0.6 THEN 1 ELSE 0 END AS alert_flag FROM kyc",
    views=_KY_VIEWS,
    ctes=S.KYC_ALL,
)
def ky4(spark, d):
    out = compliance.score(P.joined(spark, d)).select("transaction_id", "risk_score", "alert_flag")
    return P.rounded(out, "risk_score")


@query(
    "ky5_compliance_reasons",
    """SELECT transaction_id, reason_code, CASE WHEN reason_code = 'NO_VIOLATIONS' THEN 'No KYC/AML violations detected.'
 ELSE 'KYC/AML violations: ' || lower(replace(replace(reason_code, '|', ', '), '_', ' ')) || '.' END AS explanation FROM kyc""",
    views=_KY_VIEWS,
    ctes=S.KYC_ALL,
)
def ky5(spark, d):
    return compliance.score(P.joined(spark, d)).select("transaction_id", "reason_code", "explanation")


# --------------------------------------------------------------- behaviour

_IDS = """CASE transaction_type WHEN 'transfer' THEN 1 WHEN 'payment' THEN 2 WHEN 'withdrawal' THEN 3 WHEN 'deposit' THEN 4 WHEN 'cash_out' THEN 5 ELSE 0 END AS ty,
 CASE channel WHEN 'mobile_banking' THEN 1 WHEN 'atm' THEN 2 WHEN 'branch' THEN 3 WHEN 'online_banking' THEN 4 WHEN 'pos' THEN 5 ELSE 0 END AS ch"""
_NORM = """norm AS (SELECT avg(a) AS am, stddev_samp(a) AS asd, avg(dt) AS tm, stddev_samp(dt) AS tsd FROM
 (SELECT amount_npr AS a, (epoch_us(txn_ts) - lag(epoch_us(txn_ts)) OVER (PARTITION BY sender_account_id ORDER BY txn_ts, transaction_id)) / 1e6 AS dt FROM tx)),
steps AS (SELECT sender_account_id AS account, 17 - r AS slot, ty, ch, (amount_npr - am) / asd AS an, (coalesce(dt, 0) - tm) / tsd AS tn, is_fraud FROM
 (SELECT *, {ids}, row_number() OVER (PARTITION BY sender_account_id ORDER BY txn_ts DESC, transaction_id DESC) AS r,
 (epoch_us(txn_ts) - lag(epoch_us(txn_ts)) OVER (PARTITION BY sender_account_id ORDER BY txn_ts, transaction_id)) / 1e6 AS dt FROM tx), norm WHERE r <= 16)""".replace("{ids}", _IDS)


@query(
    "be1_sequences",
    """SELECT s.account, p.slot, coalesce(x.ty, 0) AS type_id, coalesce(x.ch, 0) AS channel_id, round(coalesce(x.an, 0), 6) AS amount_norm,
 round(coalesce(x.tn, 0), 6) AS time_norm, s.label::DOUBLE AS label FROM (SELECT account, max(is_fraud) AS label FROM steps GROUP BY account) s
 CROSS JOIN (SELECT unnest(range(1, 17)) AS slot) p LEFT JOIN steps x ON x.account = s.account AND x.slot = p.slot""",
    ctes=(_NORM,),
)
def be1(spark, d):
    t = tx(spark, d)
    seq = sequences(behaviour_rows(t), behaviour.fit_stats(t))
    out = seq.select("account", "label", F.posexplode("steps").alias("p", "s")).select(
        "account", (F.col("p") + 1).cast("bigint").alias("slot"), "s.*", "label"
    )
    return P.rounded(out, "amount_norm", "time_norm")


@query(
    "be2_normalisation_state",
    "SELECT round(am, 4) AS amount_mean, round(asd, 4) AS amount_std, round(tm, 4) AS time_mean, round(tsd, 4) AS time_std FROM norm",
    ctes=(_NORM,),
)
def be2(spark, d):
    from riskweave.operators.sequences import normalisation

    out = normalisation(behaviour_rows(tx(spark, d)), DEFAULTS["hot_key_rows"])
    return P.rounded(out, *out.columns, digits=4)


@query(
    "be3_behaviour_heuristic",
    """SELECT transaction_id, 'behaviour' AS agent_name, round(risk_score, 6) AS risk_score, CASE WHEN risk_score >= 0.7 THEN 1 ELSE 0 END AS alert_flag,
 CASE WHEN risk_score >= 0.7 THEN 'HEURISTIC_ANOMALY' ELSE 'NORMAL_BEHAVIOUR' END AS reason_code,
 'Behaviour analysis (heuristic): ' || CASE WHEN risk_score >= 0.7 THEN 'heuristic anomaly' ELSE 'normal behaviour' END || '.' AS explanation FROM beh""",
    ctes=S.BEH_ALL,
)
def be3(spark, d):
    t = tx(spark, d)
    return P.rounded(behaviour.score(t, None).drop("timestamp"), "risk_score")


@query("be4_sequence_classifier")
def be4(spark, d):
    t = tx(spark, d)
    return P.rounded(behaviour.score(t, behaviour.fit(t)).drop("timestamp"), "risk_score")


@query(
    "be4_sequence_windows",
    """SELECT transaction_id, row_number() OVER (PARTITION BY sender_account_id ORDER BY txn_ts DESC, transaction_id DESC) <= 16 AS in_window, true AS same_again FROM tx""",
)
def be4_windows(spark, d):
    """Which rows the fitted unit scores, and whether a refit gives every row the same score."""
    t = tx(spark, d)
    one, other = (behaviour.score(t, behaviour.fit(t)).select("transaction_id", F.col("risk_score").alias(c)) for c in ("a", "b"))
    both = one.join(other, "transaction_id")
    return both.select("transaction_id", (F.col("a") > 0).alias("in_window"), (F.col("a") == F.col("b")).alias("same_again"))


@query(
    "be5_without_account_column",
    "SELECT transaction_id, round(risk_score, 6) AS risk_score, 'BEHAVIOUR_HEURISTIC' AS reason_code FROM beh",
    ctes=S.BEH_ALL,
)
def be5(spark, d):
    t = tx(spark, d).drop("sender_account_id")
    return P.rounded(behaviour.score(t, None).select("transaction_id", "risk_score", "reason_code"), "risk_score")


# ---------------------------------------------------------------- stacking

_FIVE = [f"{a}_score" for a in meta.AGENTS]
_MEAN = "(velocity_score + geo_risk_score + behaviour_score + kyc_aml_score + graph_score) / 5.0::DOUBLE"


def _average_model() -> meta.MetaModel:
    return meta.MetaModel("random_forest", list(_FIVE))


@query(
    "me1_meta_features",
    "SELECT transaction_id, is_fraud::DOUBLE AS is_fraud, " + ", ".join(f"round({c}, 6) AS {c}" for c in _FIVE) + ", 0.0::DOUBLE AS extra_score FROM wide",
    views=("tx", "ac"),
    ctes=S.WIDE_ALL,
)
def me1(spark, d):
    return P.rounded(meta.feature_matrix(P.wide(spark, d), [*_FIVE, "extra_score"]), *_FIVE)


def _fitted(spark, d, settings=None):
    table = cut(P.wide(spark, d))
    return table, meta.fit(table, settings)


@query("me2_calibrated_forest")
def me2(spark, d):
    table, model = _fitted(spark, d)
    return P.rounded(meta.score(table, model).drop("timestamp"), "risk_score")


@query("me3_holdout_calibration")
def me3(spark, d):
    """One fold asked for: hold-out with sigmoid calibration."""
    table, model = _fitted(spark, d, {"meta_learner_calibration_cv": 1})
    return P.rounded(meta.score(table, model).drop("timestamp"), "risk_score")


@query("me4_boosted_challenger")
def me4(spark, d):
    table, model = _fitted(spark, d, {"meta_learner_model_type": "xgboost"})
    return P.rounded(meta.score(table, model).drop("timestamp"), "risk_score")


@query(
    "me5_average_fallback",
    f"SELECT transaction_id, round({_MEAN}, 6) AS meta_score FROM wide",
    views=("tx", "ac"),
    ctes=S.WIDE_ALL,
)
def me5(spark, d):
    table = P.wide(spark, d).drop("is_fraud")
    model = meta.fit(table)
    return model.transform(table).select("transaction_id", F.round("meta_score", 6).alias("meta_score"))


@query(
    "me6_meta_alerts_long_input",
    f"""SELECT transaction_id, round({_MEAN}, 6) AS risk_score, CASE WHEN {_MEAN} >= 0.3 THEN 1 ELSE 0 END AS alert_flag,
 CASE WHEN {_MEAN} >= 0.3 THEN 'META_ALERT' ELSE 'META_NORMAL' END AS reason_code,
 'Meta-learner (random forest): ' || CASE WHEN {_MEAN} >= 0.3 THEN 'meta alert' ELSE 'meta normal' END || '.' AS explanation FROM wide, range(5)""",
    views=("tx", "ac"),
    ctes=S.WIDE_ALL,
)
def me6(spark, d):
    long = None
    for part in P.rule_alerts(spark, d).values():
        long = part if long is None else long.unionByName(part)
    out = meta.score(cut(long), _average_model(), {"meta_learner_alert_threshold": 0.3})
    return P.rounded(out.select("transaction_id", "risk_score", "alert_flag", "reason_code", "explanation"), "risk_score")


@query("me7_feature_importances")
def me7(spark, d):
    _, model = _fitted(spark, d)
    return model.importances(spark)


@query(
    "me8_attributions_average",
    "SELECT transaction_id, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / 5.0::DOUBLE, 6) AS phi_{c}" for c in _FIVE) + " FROM wide",
    views=("tx", "ac"),
    ctes=S.WIDE_ALL,
)
def me8(spark, d):
    table = cut(P.wide(spark, d).select("transaction_id", *_FIVE))
    out = meta.attributions(table, _FIVE, _average_model().transform, meta.feature_means(table, _FIVE))
    # + 0.0 turns a rounded negative zero into zero.
    return out.select("transaction_id", *[(F.round(f"phi_{c}", 6) + 0.0).alias(f"phi_{c}") for c in _FIVE])


def _forest_attributions(spark, d):
    """Of every row, by the default model."""
    table, model = _fitted(spark, d)
    return table, model, meta.member_attributions(table, model)


@query("me8_attributions_forest")
def me8_forest(spark, d):
    return _forest_attributions(spark, d)[2]


@query("me8_attributions_add_up", "SELECT transaction_id, true AS adds_up FROM tx")
def me8_add_up(spark, d):
    """Parts of every row against the fitted forest's own score, less the baseline."""
    table, model, phi = _forest_attributions(spark, d)
    total = sum((F.col(f"phi_{c}") for c in _FIVE), F.col("baseline"))
    value = meta.member_value(table, model).select("transaction_id", "member_value")
    return phi.join(value, "transaction_id").select("transaction_id", (F.abs(total - F.col("member_value")) < 1e-9).alias("adds_up"))


# A small forest (feature, threshold, training rows left and right of it, left and right branch) that SQL can follow.
_TREES = (
    ("geo_risk_score", 0.3137, 70, ("kyc_aml_score", 0.1231, 40, 0.02, ("behaviour_score", 0.6203, 20, 0.21, 0.47, 10), 30),
     ("velocity_score", 0.2513, 20, 0.55, ("kyc_aml_score", 0.3391, 4, 0.71, 0.97, 6), 10), 30),
    ("behaviour_score", 0.5517, 55, ("graph_score", 0.2711, 33, 0.05, 0.33, 22), ("behaviour_score", 0.8019, 30, ("geo_risk_score", 0.1013, 12, 0.4, 0.62, 18), 0.9, 15), 45),
    ("kyc_aml_score", 0.2117, 80, ("graph_score", 0.3019, 50, ("geo_risk_score", 0.5011, 35, 0.1, 0.2, 15), 0.3, 30), 0.8, 20),
)


def _tree_nodes() -> list[dict]:
    out = []

    def add(tree: int, node, cover: float) -> int:
        row = {"tree": tree, "id": len(out), "left": -1, "right": -1, "feature": -1, "threshold": None, "cover": float(cover), "value": 0.0}
        out.append(row)
        if isinstance(node, tuple):
            name, at, n_left, left, right, n_right = node
            row.update(feature=_FIVE.index(name), threshold=at, left=add(tree, left, n_left), right=add(tree, right, n_right))
        else:
            row["value"] = node / len(_TREES)
        return row["id"]

    for k, tree in enumerate(_TREES):
        add(k, tree, tree[2] + tree[5])
    return out


def _known_value(node, known: frozenset[str]) -> str:
    """SQL for the mean leaf value when only the features in ``known`` are."""
    if not isinstance(node, tuple):
        return f"{node!r}::DOUBLE"
    name, at, n_left, left, right, n_right = node
    one, other = _known_value(left, known), _known_value(right, known)
    if name in known:
        return f"(CASE WHEN {name} <= {at!r}::DOUBLE THEN {one} ELSE {other} END)"
    return f"(({n_left} * {one} + {n_right} * {other}) / {n_left + n_right})"


def _subset_sql() -> str:
    """Shapley values by all subsets of the five features."""
    size = len(_FIVE)
    sets = [frozenset(c for i, c in enumerate(_FIVE) if m >> i & 1) for m in range(1 << size)]
    value = ", ".join(f"({' + '.join(_known_value(t, s) for t in _TREES)}) / {len(_TREES)} AS v{m}" for m, s in enumerate(sets))
    parts = []
    for i, c in enumerate(_FIVE):
        terms = [
            f"{math.factorial(len(s)) * math.factorial(size - len(s) - 1) / math.factorial(size)!r}::DOUBLE * (v{m | 1 << i} - v{m})"
            for m, s in enumerate(sets)
            if not m >> i & 1
        ]
        parts.append(f"round({' + '.join(terms)}, 9) + 0.0 AS phi_{c}")
    return (
        f"vs AS (SELECT transaction_id, {value} FROM wide),\n"
        f"phis AS (SELECT transaction_id, {', '.join(parts)}, round(v0, 9) AS baseline FROM vs)"
    )


def _tree_phi(spark, d):
    parts = TreeParts.of(_tree_nodes(), len(_FIVE))
    phi = tree_attributions(P.wide(spark, d), _FIVE, parts)
    return phi.select("transaction_id", *[(F.round(c, 9) + 0.0).alias(c) for c in phi.columns[1:]])


@query(
    "me8_attributions_trees",
    "SELECT transaction_id, " + ", ".join(f"round(phi_{c}, 8) + 0.0 AS phi_{c}" for c in _FIVE) + ", round(baseline, 8) AS baseline FROM phis",
    views=("tx", "ac"),
    ctes=(*S.WIDE_ALL, _subset_sql()),
)
def me8_trees(spark, d):
    """Path attributions of a fixed forest; the SQL goes through all subsets."""
    phi = _tree_phi(spark, d)
    return phi.select("transaction_id", *[(F.round(c, 8) + 0.0).alias(c) for c in phi.columns[1:]])


_REASON_SQL = "list_transform(list_sort(list_filter([" + ", ".join(
    f"{{'neg': -phi_{c}, 'name': '{c.removesuffix('_score')}'}}" for c in _FIVE
) + "], lambda x: x.neg < 0))[1:3], lambda x: x.name)"


@query(
    "ex3_tree_reasons",
    f"SELECT transaction_id, array_to_string({_REASON_SQL}, ',') AS reasons FROM phis",
    views=("tx", "ac"),
    ctes=(*S.WIDE_ALL, _subset_sql()),
)
def ex3_trees(spark, d):
    """Names of the largest positive parts of every row."""
    top = meta.top_reasons(_tree_phi(spark, d), _FIVE)
    return top.select("transaction_id", F.array_join("attribution_reasons", ",").alias("reasons"))


@query(
    "me9_feature_matrix",
    "SELECT transaction_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _FIVE) + " FROM wide",
    views=("tx", "ac"),
    ctes=S.WIDE_ALL,
)
def me9(spark, d):
    long = None
    for part in P.rule_alerts(spark, d).values():
        long = part if long is None else long.unionByName(part)
    return P.rounded(meta.feature_matrix(long, _FIVE), *_FIVE)


# ------------------------------------------------------------ explanations

_EX_CTES = (S.GEO_F, S.GEO, *S.KYC_ALL, *S.BEH_ALL)
_EX = """ex AS (SELECT t.*, g.risk_score / 2.0::DOUBLE + k.risk_score / 2.0::DOUBLE AS meta_risk_score,
 CASE WHEN g.risk_score / 2.0::DOUBLE + k.risk_score / 2.0::DOUBLE >= 0.25 THEN 'META_ALERT' ELSE 'META_NORMAL' END AS meta_reason_code,
 g.reason_code AS geo_reason_code, k.reason_code AS kyc_reason_code,
 CASE WHEN b.risk_score >= 0.7 THEN 'HEURISTIC_ANOMALY' ELSE 'NORMAL_BEHAVIOUR' END AS behaviour_reason_code
 FROM tx t JOIN geo g USING (transaction_id) JOIN kyc k USING (transaction_id) JOIN beh b USING (transaction_id)),
sig AS (SELECT *, concat_ws(', ', CASE WHEN meta_reason_code <> 'META_NORMAL' THEN lower(replace(meta_reason_code, '_', ' ')) END,
 lower(replace(geo_reason_code, '_', ' ')), CASE WHEN kyc_reason_code <> 'NO_VIOLATIONS' THEN lower(replace(kyc_reason_code, '_', ' ')) END,
 lower(replace(behaviour_reason_code, '_', ' '))) AS signals FROM ex),
says AS (SELECT transaction_id, meta_risk_score, signals, 'Transaction ' || transaction_id || ' (' || transaction_type || ', NPR ' || format('{:,.2f}', amount_npr) || ', via ' || channel || ', ' ||
 coalesce(remittance_corridor, 'domestic corridor') || ') is ' || CASE WHEN meta_risk_score >= 0.5 THEN 'flagged for review' ELSE 'not flagged' END ||
 ' with combined risk score ' || format('{:.3f}', meta_risk_score) || '. Contributing signals: ' || signals ||
 '. This is a suspicious-activity triage explanation, not a finding of criminal conduct.' AS explanation FROM sig)"""


def _context(spark, d):
    """Transactions with the stacked score and the reasons of three scorers."""
    t = tx(spark, d)
    g = geo.score(t).select("transaction_id", F.col("risk_score").alias("g"), F.col("reason_code").alias("geo_reason_code"))
    k = compliance.score(P.joined(spark, d)).select(
        "transaction_id", F.col("risk_score").alias("k"), F.col("reason_code").alias("kyc_reason_code")
    )
    b = behaviour.score(t, None).select("transaction_id", F.col("reason_code").alias("behaviour_reason_code"))
    score = F.col("g") / 2.0 + F.col("k") / 2.0
    return (
        t.join(g, "transaction_id").join(k, "transaction_id").join(b, "transaction_id")
        .withColumn("meta_risk_score", score)
        .withColumn("meta_reason_code", F.when(score >= 0.25, "META_ALERT").otherwise("META_NORMAL"))
        .drop("g", "k")
    )


@query("ex1_explanation_text", "SELECT transaction_id, explanation FROM says", views=("tx", "ac"), ctes=(*_EX_CTES, _EX))
def ex1(spark, d):
    return explanation.score(_context(spark, d)).select("transaction_id", "explanation")


@query("ex2_signals", "SELECT transaction_id, signals FROM says", views=("tx", "ac"), ctes=(*_EX_CTES, _EX))
def ex2(spark, d):
    ctx = _context(spark, d)
    return ctx.select("transaction_id", F.array_join(explanation.signals(ctx), ", ").alias("signals"))


@query("ex3_attribution_reasons")
def ex3(spark, d):
    table, model, phi = _forest_attributions(spark, d)
    reasons = meta.top_reasons(phi, _FIVE)
    scored = explanation.add_meta(tx(spark, d), meta.score(table, model)).join(reasons, "transaction_id", "left")
    return explanation.score(scored).select("transaction_id", "reason_code", "explanation")


@query(
    "ex4_explanation_alerts",
    """SELECT transaction_id, 'explanation' AS agent_name, round(meta_risk_score, 6) AS risk_score, CASE WHEN meta_risk_score >= 0.5 THEN 1 ELSE 0 END AS alert_flag,
 CASE WHEN meta_risk_score >= 0.5 THEN 'EXPLANATION_ALERT' ELSE 'EXPLANATION_NORMAL' END AS reason_code, explanation FROM says""",
    views=("tx", "ac"),
    ctes=(*_EX_CTES, _EX),
)
def ex4(spark, d):
    return P.rounded(explanation.score(_context(spark, d)).drop("timestamp"), "risk_score")
