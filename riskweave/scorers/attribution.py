"""Attributions of tree models: exact Shapley values from the paths to the leaves.

The value of a set of features is the mean leaf value when a split on another feature
sends a row both ways, weighed by the training rows that went each way. A leaf whose path
splits on the features D then adds value * prod(one, zero): for a feature of the set 1 if the row
lies in the leaf's interval and else 0, for another feature the share of training rows
that stayed on the path at its splits. Shapley weights are Beta integrals, so the part of
feature f is

    value * (one_f - zero_f) * integral over t in [0, 1] of prod over g in D less f of (one_g * t + zero_g * (1 - t))

a polynomial of degree |D| - 1, which ceil(|D| / 2) Gauss-Legendre points integrate exactly: no
subsets, no copies of a row. Rows between the same thresholds have the same parts, so these are
worked out once for each such cell of the whole table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.runtime import materialise, partitions, scratch_path

#: Numbers of (row, leaf, feature) that a task holds at once.
_PIECE = 1 << 21


def model_nodes(spark: SparkSession, model: Any) -> list[Mapping]:
    """Nodes of a fitted forest or boosted model: tree, id, feature (-1 in a leaf), threshold, left, right, cover, value.

    Read from the stored model; as many as the model has. A forest's value is the mean of its
    leaf shares of the second class, a boosted model's the weighted sum of its leaf values (its margin).
    """
    path = scratch_path(spark, "trees")
    model.write().save(path)
    n, stats = F.col("nodeData"), F.col("nodeData.impurityStats")
    if isinstance(model, GBTClassificationModel):
        cover, value = stats[0], n["prediction"]
        weights = list(model.treeWeights)
    else:
        cover = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
        value, weights = stats[1] / cover, [1.0 / model.getNumTrees] * model.getNumTrees
    rows = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("id"), n["split"]["featureIndex"].alias("feature"),
        F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"), n["split"]["numCategories"].alias("categories"),
        n["leftChild"].alias("left"), n["rightChild"].alias("right"), cover.alias("cover"), value.alias("value"),
    )
    out = []
    for r in rows.collect():
        if r["left"] >= 0 and r["categories"] >= 0:
            raise ValueError("splits by category have no threshold")
        out.append({**r.asDict(), "value": r["value"] * weights[r["tree"]]})
    return out


@dataclass
class Leaves:
    """Leaves with equally many features on their paths; arrays (leaf, feature), intervals as threshold numbers (low, high]."""

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    zero: np.ndarray
    value: np.ndarray


@dataclass
class TreeParts:
    """Path tables of a model over ``width`` features, and its expected value."""

    width: int
    thresholds: list[np.ndarray]
    groups: list[Leaves]
    expected: float

    @classmethod
    def of(cls, nodes: Iterable[Mapping], width: int) -> TreeParts:
        trees: dict[int, dict[int, Mapping]] = {}
        for node in nodes:
            trees.setdefault(node["tree"], {})[node["id"]] = node
        found: list[set] = [set() for _ in range(width)]
        for tree in trees.values():
            for node in tree.values():
                if node["left"] >= 0:
                    found[node["feature"]].add(node["threshold"])
        thresholds = [np.array(sorted(f)) for f in found]
        number = [{t: i for i, t in enumerate(f)} for f in thresholds]
        by_size: dict[int, list] = {}
        expected = 0.0
        for tree in trees.values():
            children = {c for n in tree.values() if n["left"] >= 0 for c in (n["left"], n["right"])}
            todo = [(i, 1.0, {}) for i in tree if i not in children]
            while todo:
                i, reach, path = todo.pop()
                node = tree[i]
                if node["left"] < 0:
                    expected += reach * node["value"]
                    by_size.setdefault(len(path), []).append((path, node["value"]))
                    continue
                f = node["feature"]
                at = number[f][node["threshold"]]
                low, high, zero = path.get(f, (-1, len(thresholds[f]), 1.0))
                for child, bounds in ((node["left"], (low, min(high, at))), (node["right"], (max(low, at), high))):
                    share = tree[child]["cover"] / node["cover"]
                    todo.append((child, reach * share, {**path, f: (*bounds, zero * share)}))
        groups = []
        for size, leaves in sorted(by_size.items()):
            if size:
                table = [[(f, *path[f]) for f in sorted(path)] for path, _ in leaves]
                part = lambda k: np.array([[x[k] for x in row] for row in table])  # noqa: B023, E731
                groups.append(Leaves(part(0), part(1), part(2), part(3), np.array([v for _, v in leaves])))
        return cls(width, thresholds, groups, expected)

    def values(self, x: np.ndarray) -> np.ndarray:
        """Parts of every row, (row, feature). Rows in one cell of the model's thresholds share theirs."""
        if not len(x):
            return np.zeros((0, self.width))
        cells, back = np.unique(self.cells(x), axis=0, return_inverse=True)
        return self.cell_values(cells)[back.reshape(-1)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """How many thresholds of each feature lie below a row's value, (row, feature)."""
        return np.stack([np.searchsorted(t, x[:, f], side="left") for f, t in enumerate(self.thresholds)], 1)

    def cell_values(self, cells: np.ndarray) -> np.ndarray:
        """Parts of every cell, (cell, feature)."""
        out = np.zeros((len(cells), self.width))
        for leaves in self.groups:
            size = leaves.feature.shape[1]
            points, weights = np.polynomial.legendre.leggauss(-(-size // 2))
            points, weights = (points + 1) / 2, weights / 2
            to_feature = np.zeros((leaves.feature.size, self.width))
            to_feature[np.arange(leaves.feature.size), leaves.feature.reshape(-1)] = 1.0
            rows = max(1, _PIECE // leaves.feature.size)
            for start in range(0, len(cells), rows):
                at = cells[start : start + rows][:, leaves.feature]
                one = ((at > leaves.low) & (at <= leaves.high)).astype(np.float64)
                weighed = np.zeros_like(one)
                for t, w in zip(points, weights, strict=True):
                    factor = one * t + leaves.zero * (1 - t)
                    weighed += (w * factor.prod(2))[:, :, None] / factor
                parts = weighed * (one - leaves.zero) * leaves.value[:, None]
                out[start : start + rows] += parts.reshape(len(at), -1) @ to_feature
        return out


def tree_attributions(rows: DataFrame, columns: Sequence[str], parts: TreeParts) -> DataFrame:
    """(transaction_id, ``phi_<column>`` each, baseline): a row's parts add up to the model's value less the baseline."""
    columns = list(columns)
    kind = rows.schema["transaction_id"].dataType.simpleString()
    # As large as the model, whatever the rows.
    shared = rows.sparkSession.sparkContext.broadcast(parts)
    names, keys = [f"phi_{c}" for c in columns], [f"_cell_{i}" for i in range(len(columns))]
    stacked = lambda batch, cols: np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cols], 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = shared.value.cells(stacked(batch, columns)).astype(np.int32)
            at = [pa.array(cells[:, j]) for j in range(len(columns))]
            yield pa.RecordBatch.from_arrays([batch.column("transaction_id"), *at], names=["transaction_id", *keys])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phi = shared.value.cell_values(stacked(batch, keys))
            at = [pa.array(phi[:, j]) for j in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *at], names=[*keys, *names])

    ints, doubles = ", ".join(f"{k} int" for k in keys), ", ".join(f"{n} double" for n in names)
    inputs = rows.select("transaction_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    placed = inputs.mapInArrow(place, f"transaction_id {kind}, {ints}")
    cells = placed.select(*keys).distinct().repartition(4 * partitions(rows.sparkSession), *keys)
    # Stored: the join then knows how few there are, and leaves the rows where they are.
    told = materialise(cells.mapInArrow(run, f"{ints}, {doubles}"), "cell-parts")
    return placed.join(told, keys).select("transaction_id", *names, F.lit(parts.expected).alias("baseline"))
