"""Two trained layers over the payment graph: own state and mean of the paying accounts' states.

Layer one takes an account's features and the weighted mean of those of its
payers, layer two the same of layer one's states, then one output. The parameters
are the only thing on the driver. A round passes states forward along the pairs and slopes
backward: pairs are stored once by (payer, part) and once by (payee, part), a hub's pairs in
several parts, and are not shuffled again; only states and partly summed messages are.
Gradients are summed in the tasks, then by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators import graph as G
from riskweave.operators.skew import spread_join
from riskweave.runtime import cut, partitions
from riskweave.scorers.network import MATRIX, node_matrix
from riskweave.settings import resolve


@dataclass
class TwoLayers:
    """Weights in one flat array: of the own state, of the mean, and offsets, for both layers; then the output."""

    inputs: int
    hidden: int
    flat: np.ndarray

    @classmethod
    def fresh(cls, inputs: int, hidden: int, seed: int) -> TwoLayers:
        one = cls(inputs, hidden, np.zeros(2 * inputs * hidden + hidden + 2 * hidden * hidden + hidden + hidden + 1))
        rng = np.random.default_rng(seed)
        for part in one.parts():
            if part.ndim == 2:
                part += rng.normal(size=part.shape) / len(part) ** 0.5
        one.parts()[6][:] = rng.normal(size=hidden) / hidden**0.5
        return one

    def parts(self, flat: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        flat, f, h = self.flat if flat is None else flat, self.inputs, self.hidden
        shapes = [(f, h), (f, h), (h,), (h, h), (h, h), (h,), (h,), (1,)]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        return tuple(p.reshape(s) for p, s in zip(np.split(flat, ends[:-1]), shapes, strict=True))

    def states(self, x: np.ndarray, m1: np.ndarray) -> np.ndarray:
        """States after layer one."""
        w, v, b, *_ = self.parts()
        return np.maximum(x @ w + m1 @ v + b, 0.0)

    def logits(self, x: np.ndarray, m1: np.ndarray, m2: np.ndarray) -> np.ndarray:
        _, _, _, w, v, b, o, c = self.parts()
        return np.maximum(self.states(x, m1) @ w + m2 @ v + b, 0.0) @ o + c

    def _top(self, x, m1, m2, y, weight):
        _, _, _, w, v, b, o, c = self.parts()
        h1 = self.states(x, m1)
        h2 = np.maximum(h1 @ w + m2 @ v + b, 0.0)
        logit = h2 @ o + c
        times = np.where(y > 0, weight, 1.0)
        slope = times * (0.5 * (1 + np.tanh(0.5 * logit)) - y)
        loss = float((times * (np.logaddexp(0, logit) - y * logit)).sum())
        return loss, h1, h2, slope, slope[:, None] * o * (h2 > 0)

    def slopes(self, x, m1, m2, y, weight) -> np.ndarray:
        """Slope of the loss by the mean that layer two saw, to be sent back to the payers."""
        return self._top(x, m1, m2, y, weight)[4] @ self.parts()[4].T

    def gradient(self, x, m1, m2, back, y, weight) -> tuple[float, np.ndarray]:
        """(loss, gradient) summed over accounts; ``back`` are the weighted sums of the slopes of their payees."""
        loss, h1, h2, slope, d2 = self._top(x, m1, m2, y, weight)
        out = np.zeros_like(self.flat)
        gw1, gv1, gb1, gw2, gv2, gb2, go, gc = self.parts(out)
        go += slope @ h2
        gc += slope.sum()
        gw2 += h1.T @ d2
        gv2 += m2.T @ d2
        gb2 += d2.sum(0)
        d1 = (d2 @ self.parts()[3].T + back) * (h1 > 0)
        gw1 += x.T @ d1
        gv1 += m1.T @ d1
        gb1 += d1.sum(0)
        return loss, out


@dataclass
class LayerModel:
    """Fitted layers with the mean and deviation of their inputs, and the mean loss before each round."""

    net: TwoLayers
    mean: np.ndarray
    spread: np.ndarray
    losses: list[float]

    def save(self, spark: SparkSession, path: str) -> None:
        row = (self.net.inputs, self.net.hidden, self.net.flat.tolist(), self.mean.tolist(), self.spread.tolist(), self.losses)
        schema = "inputs int, hidden int, flat array<double>, mean array<double>, spread array<double>, losses array<double>"
        spark.createDataFrame([row], schema).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LayerModel:
        r = spark.read.parquet(path).first()
        return cls(TwoLayers(r["inputs"], r["hidden"], np.array(r["flat"])), np.array(r["mean"]), np.array(r["spread"]), list(r["losses"]))


@dataclass
class _Graph:
    """Accounts (node, x, m1, y, n_out, n_in) stored by node, and their pairs stored by either end."""

    accounts: DataFrame
    forward: DataFrame
    backward: DataFrame
    rows_per_task: int

    def sent(self, states: DataFrame, count: str, names: list[str], pairs: DataFrame) -> DataFrame:
        """Sum of the states of an account's neighbours along ``pairs``, each times the pair's share."""
        parts = F.greatest(F.lit(1), F.ceil(F.col(count) / F.lit(self.rows_per_task))).cast("int")
        out = states.filter(F.col(count) > 0).select(
            F.col("node").alias("src"), *names, F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part")
        )
        joined = pairs.join(out, ["src", "_part"])
        return joined.groupBy(F.col("dst").alias("node")).agg(*[F.sum(F.col(c) * F.col("share")).alias(c) for c in names])


def _laid_out(e: DataFrame, settings: Mapping | None, stats: tuple[np.ndarray, np.ndarray] | None):
    """(graph, (mean, deviation) of the inputs)."""
    spark, rows = e.sparkSession, int(resolve(settings)["hot_key_rows"])
    pairs = cut(G.pair_weights(e))
    matrix = cut(node_matrix(e, settings))
    cols = [*MATRIX, *[f"nbr_{c}" for c in MATRIX]]
    hops = cut(G.neighbour_means(pairs, matrix, list(MATRIX), rows))
    if stats is None:
        found = hops.agg(*[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols]).first()
        stats = np.array([v or 0.0 for v in found[: len(cols)]]), np.array([v or 1.0 for v in found[len(cols) :]])
    unit = [((F.col(c) - float(m)) / float(s)) for c, m, s in zip(cols, *stats, strict=True)]
    outs = pairs.groupBy("src").agg(F.count("*").alias("deg"))
    ins = pairs.groupBy("dst").agg(F.sum("weight").alias("_total"), F.count("*").alias("deg"))
    size = len(MATRIX)
    known = hops.select(
        "node", F.array(*unit[:size]).alias("x"), F.array(*unit[size:]).alias("m1"), (F.col("label") > 0).cast("double").alias("y")
    )
    count = lambda d, end, name: d.select(F.col(end).alias("node"), F.col("deg").alias(name))
    accounts = known.join(count(outs, "src", "n_out"), "node", "left").join(count(ins, "dst", "n_in"), "node", "left").fillna(0, ["n_out", "n_in"])
    accounts = cut(accounts.repartition(partitions(spark), "node"), keep_layout=True)
    shared = spread_join(pairs, ins, ["dst"], "deg", "src", rows, "inner").select("src", "dst", (F.col("weight") / F.col("_total")).alias("share"))
    shared = cut(shared)
    turned = shared.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "share")
    forward = G.laid_out_edges(shared, outs, rows, ["share"])
    backward = G.laid_out_edges(turned, ins.select(F.col("dst").alias("src"), "deg"), rows, ["share"])
    return _Graph(accounts, forward, backward, rows), stats


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy().reshape(batch.num_rows, width)


def _columns(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).fill_null(0.0).to_numpy() for c in names], 1)


def _per_account(df: DataFrame, count: str, names: list[str], work: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """(node, count, one column for each name) from a matrix that ``work`` makes of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = work(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column(count), *[pa.array(out[:, j]) for j in range(len(names))]], names=["node", count, *names]
            )

    kind = df.schema["node"].dataType.simpleString()
    return df.mapInArrow(run, f"node {kind}, {count} bigint, " + ", ".join(f"{c} double" for c in names))


def _means(graph: _Graph, net: TwoLayers) -> DataFrame:
    """Weighted mean of the payers' states after layer one, for accounts with payers."""
    names = [f"a{j}" for j in range(net.hidden)]
    states = _per_account(
        graph.accounts.select("node", "n_out", "x", "m1"), "n_out", names,
        lambda b: net.states(_matrix(b, "x", net.inputs), _matrix(b, "m1", net.inputs)),
    )
    return graph.sent(states, "n_out", names, graph.forward)


def loss_and_gradient(graph: _Graph, net: TwoLayers, weight: float) -> tuple[float, np.ndarray]:
    """Sums over all accounts; one pass forward along the pairs, one backward."""
    size, hidden = len(net.flat), net.hidden
    a, r = [f"a{j}" for j in range(hidden)], [f"r{j}" for j in range(hidden)]
    seen = cut(graph.accounts.join(_means(graph, net).hint("shuffle_merge"), "node", "left"), keep_layout=True)
    known = lambda b: (_matrix(b, "x", net.inputs), _matrix(b, "m1", net.inputs), _columns(b, a))
    slopes = _per_account(seen, "n_in", r, lambda b: net.slopes(*known(b), b.column("y").to_numpy(), weight))
    both = seen.join(graph.sent(slopes, "n_in", r, graph.backward).hint("shuffle_merge"), "node", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1)
        for batch in batches:
            loss, g = net.gradient(*known(batch), _columns(batch, r), batch.column("y").to_numpy(), weight)
            total[:size] += g
            total[size] += loss
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1, dtype=np.int32)), pa.array(total)], names=["i", "g"])

    found = both.mapInArrow(run, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).toArrow()
    out = np.zeros(size + 1)
    out[found["i"].to_numpy()] = found["g"].to_numpy()
    return out[size], out[:size]


def fit_layers(tx: DataFrame, settings: Mapping | None = None) -> LayerModel | None:
    """Train on the accounts of ``tx``; None with fewer than two fraud accounts, or with no others."""
    cfg = resolve(settings)
    graph, stats = _laid_out(G.edges(tx), settings, None)
    n, positive = graph.accounts.agg(F.count("*"), F.sum("y")).first()
    if not n or not 2 <= positive < n:
        return None
    weight = min(99.0, max(1.0, (n - positive) / positive))
    net, losses = TwoLayers.fresh(len(MATRIX), int(cfg["graph_hidden_dim"]), int(cfg["random_seed"])), []
    mean, square = np.zeros_like(net.flat), np.zeros_like(net.flat)
    for k in range(1, int(cfg["graph_max_iter"]) + 1):
        loss, g = loss_and_gradient(graph, net, weight)
        losses.append(float(loss) / n)
        g = g / n
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g**2
        step = float(cfg["graph_learning_rate"]) * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.999**k)) + 1e-8)
        net = TwoLayers(net.inputs, net.hidden, net.flat - step)
    return LayerModel(net, *stats, losses)


def layer_scores(tx: DataFrame, model: LayerModel, settings: Mapping | None = None) -> DataFrame:
    """(node, node_score, out_degree) of the accounts of ``tx``, which need not be those of the fit."""
    net = model.net
    graph, _ = _laid_out(G.edges(tx), settings, (model.mean, model.spread))
    a = [f"a{j}" for j in range(net.hidden)]
    seen = graph.accounts.join(_means(graph, net).hint("shuffle_merge"), "node", "left")

    def probability(b: pa.RecordBatch) -> np.ndarray:
        logit = net.logits(_matrix(b, "x", net.inputs), _matrix(b, "m1", net.inputs), _columns(b, a))
        return 0.5 * (1 + np.tanh(0.5 * logit))[:, None]

    scored = _per_account(seen, "n_out", ["node_score"], probability)
    return scored.select("node", "node_score", F.col("n_out").cast("double").alias("out_degree"))
