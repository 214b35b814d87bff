"""One trained layer with attention heads over the payment graph.

An account's state is its own features through one matrix, plus, for every head, a mean of its
payers' features weighted by a softmax over the payers. A head's weight for a payer depends on
both ends and on the money paid: before training it is proportional to money, so the layer
starts as the money-weighted mean and learns from there.

Every pair of accounts is stored once, by (payee, part), with the features of both ends beside
it. Features do not change between rounds, so a round moves no pair: tasks make partial
(maximum, sum, weighted sum) triples, which merge to the softmax of a payee however many parts
its pairs have, and the slopes of the payees' states go back to the parts. The gradient of the
matrices is a plain sum over pairs. The parameters are the only thing on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.operators import graph as G
from riskweave.operators.skew import spread_join
from riskweave.runtime import cut, partitions
from riskweave.scorers.network import MATRIX, node_matrix
from riskweave.settings import resolve

_LEAK = 0.2


@dataclass
class HeadLayer:
    """Weights in one flat array; ``heads`` heads of ``width`` numbers each."""

    inputs: int
    heads: int
    width: int
    flat: np.ndarray

    @classmethod
    def fresh(cls, inputs: int, heads: int, width: int, seed: int) -> HeadLayer:
        k, h = heads * width, heads
        one = cls(inputs, heads, width, np.zeros(2 * inputs * k + 2 * k + h + 2 * k + 1))
        rng = np.random.default_rng(seed)
        own, per_head, _, _, money, _, out, _ = one.parts()
        own += rng.normal(size=own.shape) / inputs**0.5
        per_head += rng.normal(size=per_head.shape) / inputs**0.5
        money += 1.0
        out += rng.normal(size=out.shape) / k**0.5
        return one

    def parts(self, flat: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """own, per head, score of the payer, score of the payee, score of the money; offset, output, its offset."""
        flat, f, k, d = self.flat if flat is None else flat, self.inputs, self.heads, self.width
        shapes = [(f, k * d), (k, f, d), (k, d), (k, d), (k,), (k * d,), (k * d,), (1,)]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        return tuple(p.reshape(s) for p, s in zip(np.split(flat, ends[:-1]), shapes, strict=True))

    def _side_by_side(self) -> np.ndarray:
        """The heads' matrices as one, (input, head * width)."""
        return self.parts()[1].transpose(1, 0, 2).reshape(self.inputs, -1)

    def _scores(self, payer: np.ndarray, payee: np.ndarray, money: np.ndarray):
        """(transformed payer, raw score, score) of pairs; of the payee only its part of the score is needed."""
        _, w, a, b, c, *_ = self.parts()
        zu = (payer @ self._side_by_side()).reshape(-1, self.heads, self.width)
        of = lambda side: np.einsum("kfd,kd->fk", w, side)
        raw = payer @ of(a) + payee @ of(b) + money[:, None] * c
        return zu, raw, np.where(raw > 0, raw, _LEAK * raw)

    def partial(self, payer, payee, money, starts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(maximum, sum, weighted sum) for each run of pairs of one payee; ``starts`` are the runs' first rows."""
        zu, _, e = self._scores(payer, payee, money)
        top = np.maximum.reduceat(e, starts)
        part = np.exp(e - np.repeat(top, np.diff(np.append(starts, len(e))), 0))
        weighted = np.add.reduceat(part[:, :, None] * zu, starts)
        return top, np.add.reduceat(part, starts), weighted.reshape(len(starts), -1)

    def weights(self, payer, payee, money, top, total) -> np.ndarray:
        return np.exp(self._scores(payer, payee, money)[2] - top) / total

    def logits(self, x: np.ndarray, mean: np.ndarray) -> np.ndarray:
        own, *_, offset, out, last = self.parts()
        return np.maximum(x @ own + mean + offset, 0.0) @ out + last

    def account_part(self, x, mean, y, weight) -> tuple[float, np.ndarray, np.ndarray]:
        """(loss, gradient of the weights on accounts, slope by ``mean`` of each account)."""
        own, *_, offset, out, last = self.parts()
        state = np.maximum(x @ own + mean + offset, 0.0)
        logit = state @ out + last
        times = np.where(y > 0, weight, 1.0)
        slope = times * (0.5 * (1 + np.tanh(0.5 * logit)) - y)
        back = slope[:, None] * out * (state > 0)
        g = np.zeros_like(self.flat)
        g_own, *_, g_offset, g_out, g_last = self.parts(g)
        g_own += x.T @ back
        g_offset += back.sum(0)
        g_out += slope @ state
        g_last += slope.sum()
        return float((times * (np.logaddexp(0, logit) - y * logit)).sum()), g, back

    def pair_part(self, payer, payee, money, top, total, mean, back) -> np.ndarray:
        """Gradient of the heads' weights over pairs; the last four belong to the payee of each pair."""
        met = (back * mean).reshape(len(back), self.heads, self.width).sum(2)
        return self.pair_sums(payer, payee, money, top + np.log(total), met, back)

    def pair_sums(self, payer, payee, money, level, met, back) -> np.ndarray:
        """The same from what belongs to a payee in fewer numbers: a head's log of the sum of exponentials, and slope times mean."""
        _, w, a, b, _, *_ = self.parts()
        zu, raw, e = self._scores(payer, payee, money)
        share = np.exp(e - level)
        back = back.reshape(zu.shape)
        d_raw = share * ((back * zu).sum(2) - met) * np.where(raw > 0, 1.0, _LEAK)
        g = np.zeros_like(self.flat)
        _, g_w, g_a, g_b, g_c, *_ = self.parts(g)
        through = (share[:, :, None] * back).reshape(len(back), -1)
        of_payer, of_payee = d_raw.T @ payer, d_raw.T @ payee
        g_w += (payer.T @ through).reshape(-1, self.heads, self.width).transpose(1, 0, 2)
        g_w += of_payer[:, :, None] * a[:, None, :] + of_payee[:, :, None] * b[:, None, :]
        g_a += np.einsum("kf,kfd->kd", of_payer, w)
        g_b += np.einsum("kf,kfd->kd", of_payee, w)
        g_c += money @ d_raw
        return g


@dataclass
class AttentionModel:
    """A fitted layer, its input columns with mean and deviation, and the mean loss before each round."""

    net: HeadLayer
    columns: list[str]
    mean: np.ndarray
    spread: np.ndarray
    losses: list[float]

    def save(self, spark: SparkSession, path: str) -> None:
        n = self.net
        row = (n.inputs, n.heads, n.width, n.flat.tolist(), self.columns, self.mean.tolist(), self.spread.tolist(), self.losses)
        schema = (
            "inputs int, heads int, width int, flat array<double>, columns array<string>, "
            "mean array<double>, spread array<double>, losses array<double>"
        )
        spark.createDataFrame([row], schema).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> AttentionModel:
        r = spark.read.parquet(path).first()
        net = HeadLayer(r["inputs"], r["heads"], r["width"], np.array(r["flat"]))
        return cls(net, list(r["columns"]), np.array(r["mean"]), np.array(r["spread"]), list(r["losses"]))


@dataclass
class _Graph:
    """Accounts (node, x, y, n_in, n_out) by node; pairs (src = payee, dst = payer, xu, xv, money) by payee and part."""

    accounts: DataFrame
    pairs: DataFrame
    rows_per_task: int

    def to_parts(self, states: DataFrame, names: list[str]) -> DataFrame:
        """Pairs with ``names`` of their payee."""
        parts = F.greatest(F.lit(1), F.ceil(F.col("n_in") / F.lit(self.rows_per_task))).cast("int")
        out = states.filter("n_in > 0").select(F.col("node").alias("src"), *names, F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
        return self.pairs.join(out.hint("shuffle_merge"), ["src", "_part"])


def _laid_out(e: DataFrame, columns: Sequence[str], settings: Mapping | None, stats):
    spark, rows = e.sparkSession, int(resolve(settings)["hot_key_rows"])
    paid = cut(G.pair_weights(e, F.greatest(F.coalesce(F.nanvl("amount", F.lit(0.0)), F.lit(0.0)), F.lit(0.0))))
    matrix = cut(node_matrix(e, settings) if "pagerank" in columns else G.node_features(e))
    if stats is None:
        found = matrix.agg(*[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
        stats = tuple(np.array([v or d for v in part]) for d, part in ((0.0, found[: len(columns)]), (1.0, found[len(columns) :])))
    unit = [(F.col(c) - float(m)) / float(s) for c, m, s in zip(columns, *stats, strict=True)]
    known = matrix.select("node", F.array(*unit).alias("x"), (F.col("label") > 0).cast("double").alias("y"))
    ins, outs = (paid.groupBy(F.col(end).alias("node")).agg(F.count("*").alias(name)) for end, name in (("dst", "n_in"), ("src", "n_out")))
    accounts = known.join(ins, "node", "left").join(outs, "node", "left").fillna(0, ["n_in", "n_out"])
    accounts = cut(accounts.repartition(partitions(spark), "node"), keep_layout=True)
    payers = accounts.filter("n_out > 0").select(F.col("node").alias("src"), F.col("x").alias("xu"), F.col("n_out").alias("_rows"))
    payees = accounts.filter("n_in > 0").select(F.col("node").alias("dst"), F.col("x").alias("xv"), F.col("n_in").alias("_rows"))
    both = spread_join(paid, payers, ["src"], "_rows", "dst", rows, "inner").drop("_rows")
    both = spread_join(both, payees, ["dst"], "_rows", "src", rows, "inner").drop("_rows")
    turned = both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "xu", "xv", F.log1p("weight").alias("money"))
    degree = accounts.filter("n_in > 0").select(F.col("node").alias("src"), F.col("n_in").alias("deg"))
    return _Graph(accounts, G.laid_out_edges(turned, degree, rows, ["xu", "xv", "money"]), rows), stats


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy().reshape(batch.num_rows, width)


def _numbers(batch: pa.RecordBatch, names: list[str], missing: float = 0.0) -> np.ndarray:
    return np.stack([batch.column(c).fill_null(missing).to_numpy() for c in names], 1)


def _pair_inputs(batch: pa.RecordBatch, net: HeadLayer):
    return _matrix(batch, "xu", net.inputs), _matrix(batch, "xv", net.inputs), batch.column("money").to_numpy()


def _names(net: HeadLayer) -> tuple[list[str], list[str], list[str], list[str]]:
    heads, all_ = range(net.heads), range(net.heads * net.width)
    return [f"t{k}" for k in heads], [f"d{k}" for k in heads], [f"h{j}" for j in all_], [f"g{j}" for j in all_]


def _seen(graph: _Graph, net: HeadLayer) -> DataFrame:
    """Accounts with maximum, sum and weighted mean of each head over their payers; null without payers.

    Two mergeable steps: maxima of the parts first, then sums taken at the common maximum.
    """
    top, total, mean, _ = _names(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                node = batch.column("src")
                ids = node.to_numpy(zero_copy_only=False)
                starts = np.append(0, np.flatnonzero(ids[1:] != ids[:-1]) + 1)
                table = np.concatenate(net.partial(*_pair_inputs(batch, net), starts), 1)
                yield pa.RecordBatch.from_arrays([node.take(pa.array(starts)), *[pa.array(c) for c in table.T]], names=["node", *top, *total, *mean])

    numbers = ", ".join(f"{c} double" for c in [*top, *total, *mean])
    partial = graph.pairs.select("src", "xu", "xv", "money").mapInArrow(run, f"node string, {numbers}")
    same = Window.partitionBy("node")
    raised = partial.select("node", *total, *mean, *top, *[F.max(c).over(same).alias(f"m_{c}") for c in top])
    factor = [F.exp(F.col(c) - F.col(f"m_{c}")) for c in top]
    sums = raised.groupBy("node").agg(
        *[F.max(f"m_{c}").alias(c) for c in top],
        *[F.sum(F.col(c) * factor[k]).alias(c) for k, c in enumerate(total)],
        *[F.sum(F.col(c) * factor[j // net.width]).alias(c) for j, c in enumerate(mean)],
    )
    means = sums.select("node", *top, *total, *[(F.col(c) / F.col(total[j // net.width])).alias(c) for j, c in enumerate(mean)])
    return graph.accounts.join(means.hint("shuffle_merge"), "node", "left")


def _summed(df: DataFrame, size: int, work) -> np.ndarray:
    """Sum over all batches of the ``size`` numbers that ``work`` makes of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += work(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["i", "g"])

    found = df.mapInArrow(run, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).toArrow()
    out = np.zeros(size)
    out[found["i"].to_numpy()] = found["g"].to_numpy()
    return out


def loss_and_gradient(graph: _Graph, net: HeadLayer, weight: float) -> tuple[float, np.ndarray]:
    """Sums over all accounts and pairs."""
    size = len(net.flat)
    top, total, mean, slope = _names(net)
    seen = cut(_seen(graph, net), keep_layout=True)

    def of_accounts(batch: pa.RecordBatch):
        return net.account_part(_matrix(batch, "x", net.inputs), _numbers(batch, mean), batch.column("y").to_numpy(), weight)

    levels, met = [f"l{k}" for k in range(net.heads)], [f"m{k}" for k in range(net.heads)]

    def slopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            back = of_accounts(batch)[2]
            level = _numbers(batch, top) + np.log(_numbers(batch, total, 1.0))
            by_head = (back * _numbers(batch, mean)).reshape(batch.num_rows, net.heads, net.width).sum(2)
            numbers = [pa.array(np.ascontiguousarray(c)) for c in np.concatenate([level, by_head, back], 1).T]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n_in"), *numbers], names=["node", "n_in", *levels, *met, *slope])

    def accounts(batch: pa.RecordBatch) -> np.ndarray:
        loss, g, _ = of_accounts(batch)
        return np.append(g, loss)

    def pairs(batch: pa.RecordBatch) -> np.ndarray:
        return net.pair_sums(*_pair_inputs(batch, net), *[_numbers(batch, c) for c in (levels, met, slope)])

    numbers = ", ".join(f"{c} double" for c in [*levels, *met, *slope])
    # Only accounts that are paid have slopes for their pairs.
    backs = seen.filter("n_in > 0").mapInArrow(slopes, f"node string, n_in bigint, {numbers}")
    first = _summed(seen, size + 1, accounts)
    return float(first[size]), first[:size] + _summed(graph.to_parts(backs, [*levels, *met, *slope]), size, pairs)


def fit_attention(
    tx: DataFrame, settings: Mapping | None = None, columns: Sequence[str] = MATRIX, learn_weights: bool = True
) -> AttentionModel | None:
    """Train on the accounts of ``tx``; None with fewer than two fraud accounts, or with no others.

    Without ``learn_weights`` the heads stay at their start, weights proportional to money paid
    (plus one), and only the matrices are trained.
    """
    cfg = resolve(settings)
    graph, stats = _laid_out(G.edges(tx), list(columns), settings, None)
    n, positive = graph.accounts.agg(F.count("*"), F.sum("y")).first()
    if not n or not 2 <= positive < n:
        return None
    weight = min(99.0, max(1.0, (n - positive) / positive))
    heads = int(cfg["graph_heads"])
    net = HeadLayer.fresh(len(columns), heads, max(1, int(cfg["graph_hidden_dim"]) // heads), int(cfg["random_seed"]))
    losses, mean, square = [], np.zeros_like(net.flat), np.zeros_like(net.flat)
    for k in range(1, int(cfg["graph_max_iter"]) + 1):
        loss, g = loss_and_gradient(graph, net, weight)
        losses.append(loss / n)
        g = g / n
        if not learn_weights:
            for fixed in net.parts(g)[2:5]:
                fixed[:] = 0.0
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g**2
        step = float(cfg["graph_learning_rate"]) * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.999**k)) + 1e-8)
        net = HeadLayer(net.inputs, net.heads, net.width, net.flat - step)
    return AttentionModel(net, list(columns), *stats, losses)


def attention_scores(tx: DataFrame, model: AttentionModel, settings: Mapping | None = None) -> DataFrame:
    """(node, node_score, out_degree) of the accounts of ``tx``, which need not be those of the fit."""
    net = model.net
    graph, _ = _laid_out(G.edges(tx), model.columns, settings, (model.mean, model.spread))
    mean = _names(net)[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = 0.5 * (1 + np.tanh(0.5 * net.logits(_matrix(batch, "x", net.inputs), _numbers(batch, mean))))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(p), batch.column("n_out")], names=["node", "node_score", "n_out"])

    scored = _seen(graph, net).mapInArrow(run, "node string, node_score double, n_out bigint")
    return scored.select("node", "node_score", F.col("n_out").cast("double").alias("out_degree"))


def attention_weights(tx: DataFrame, model: AttentionModel, settings: Mapping | None = None) -> DataFrame:
    """(payer, payee, head_0, head_1, ...): the weight of each payer in each head of its payee."""
    net = model.net
    graph, _ = _laid_out(G.edges(tx), model.columns, settings, (model.mean, model.spread))
    top, total, _, _ = _names(net)
    out = [f"head_{k}" for k in range(net.heads)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = net.weights(*_pair_inputs(batch, net), _numbers(batch, top), _numbers(batch, total, 1.0))
            yield pa.RecordBatch.from_arrays([batch.column("dst"), batch.column("src"), *[pa.array(c) for c in share.T]], names=["payer", "payee", *out])

    joined = graph.to_parts(_seen(graph, net), [*top, *total])
    return joined.mapInArrow(run, "payer string, payee string, " + ", ".join(f"{c} double" for c in out))
