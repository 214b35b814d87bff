"""Path attributions against all subsets of the features."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.scorers import meta
from riskweave.scorers.attribution import TreeParts, model_nodes, tree_attributions

SMALL = {"meta_learner_n_estimators": 6, "meta_learner_max_depth": 5, "meta_learner_calibration_cv": 2}


def table(spark, width, rows=260, seed=3):
    rnd = random.Random(seed)
    cols = [f"s{j}_score" for j in range(width)]
    data = []
    for i in range(rows):
        x = [round(rnd.random(), 3) for _ in cols]
        data.append((f"T{i:03d}", *x, int(x[0] * x[1] + 0.3 * x[-1] + rnd.gauss(0, 0.1) > 0.45)))
    return spark.createDataFrame(data, f"transaction_id string, {', '.join(f'{c} double' for c in cols)}, is_fraud int"), cols


def known_value(nodes, i, x, known):
    node = nodes[i]
    if node["left"] < 0:
        return node["value"]
    if node["feature"] in known:
        return known_value(nodes, node["left"] if x[node["feature"]] <= node["threshold"] else node["right"], x, known)
    return sum(nodes[c]["cover"] * known_value(nodes, c, x, known) for c in (node["left"], node["right"])) / node["cover"]


def plain_parts(all_nodes, x, width):
    out = np.zeros(width)
    trees = {}
    for n in all_nodes:
        trees.setdefault(n["tree"], {})[n["id"]] = n
    for nodes in trees.values():
        root = min(nodes)
        value = {s: known_value(nodes, root, x, s) for k in range(width + 1) for s in map(frozenset, itertools.combinations(range(width), k))}
        for f in range(width):
            for s in value:
                if f not in s:
                    weight = math.factorial(len(s)) * math.factorial(width - len(s) - 1) / math.factorial(width)
                    out[f] += weight * (value[s | {f}] - value[s])
    return out


@pytest.mark.parametrize("kind", ["random_forest", "xgboost"])
def test_equals_all_subsets(spark, kind):
    df, cols = table(spark, 5)
    model = meta.fit(df, {**SMALL, "meta_learner_model_type": kind}, extra=cols)
    nodes = model_nodes(spark, model.members[0][0])
    got = {r.transaction_id: r for r in meta.member_attributions(df, model).collect()}
    assert len(got) == 260
    for row in df.limit(25).collect():
        want = plain_parts(nodes, [row[c] for c in cols], 5)
        assert np.abs(want - [got[row.transaction_id][f"phi_{c}"] for c in cols]).max() < 1e-9


@pytest.mark.parametrize("kind", ["random_forest", "xgboost"])
def test_twelve_features_add_up(spark, kind):
    df, cols = table(spark, 12, rows=400)
    model = meta.fit(df, {**SMALL, "meta_learner_max_depth": 9, "meta_learner_model_type": kind}, extra=cols)
    phi = meta.member_attributions(df, model).join(meta.member_value(df, model), "transaction_id")
    gap = sum((F.col(f"phi_{c}") for c in cols), F.col("baseline")) - F.col("member_value")
    count, worst = phi.agg(F.count("*"), F.max(F.abs(gap))).first()
    assert count == 400 and worst < 1e-9


def leaf(i, value, cover, tree=0):
    return {"tree": tree, "id": i, "feature": -1, "threshold": None, "left": -1, "right": -1, "cover": cover, "value": value}


def split(i, feature, threshold, left, right, cover, tree=0):
    return {**leaf(i, 0.0, cover, tree), "feature": feature, "threshold": threshold, "left": left, "right": right}


def test_one_leaf_repeated_features_ties_and_odd_values(spark):
    nodes = [leaf(0, 0.25, 9.0, tree=7)]
    nodes += [split(0, 0, 0.5, 1, 2, 10.0), split(1, 0, 0.2, 3, 4, 6.0), leaf(2, 1.0, 4.0), leaf(3, 0.0, 5.0), split(4, 1, 0.0, 5, 6, 1.0), leaf(5, 0.3, 0.25), leaf(6, 0.6, 0.75)]
    parts = TreeParts.of(nodes, 3)
    x = np.array([[0.5, 0.0, 1.0], [0.2, 5.0, 0.0], [0.2000001, -1.0, 0.0], [float("nan"), float("inf"), 0.0], [0.5, 0.0, 1.0]])
    got = parts.values(x)
    assert np.abs(got - [plain_parts(nodes, r, 3) for r in x]).max() < 1e-12
    assert (got[:, 2] == 0).all() and (got[0] == got[4]).all()
    df = spark.createDataFrame([("a", 0.5, None, 1.0, "z"), ("a", 0.5, 0.0, 1.0, "z"), (None, 0.1, 0.1, 0.1, "z")], "transaction_id string, a double, b double, c double, baseline string")
    rows = tree_attributions(df, ["a", "b", "c"], parts).collect()
    assert [r.transaction_id for r in rows] == ["a", "a", None] and rows[0] == rows[1]
    assert rows[0].baseline == pytest.approx(parts.expected)
    assert tree_attributions(df.limit(0), ["a", "b", "c"], parts).count() == 0


def test_without_members_the_average_is_explained(spark):
    df, cols = table(spark, 5, rows=30)
    model = meta.fit(df.drop("is_fraud"), extra=cols)
    phi = meta.member_attributions(df, model).join(meta.member_value(df, model), "transaction_id")
    gap = sum((F.col(f"phi_{c}") for c in cols), F.col("baseline")) - F.col("member_value")
    assert phi.agg(F.max(F.abs(gap))).first()[0] < 1e-12
