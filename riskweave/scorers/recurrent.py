"""A gated recurrent unit over account windows, trained by gradients summed across tasks.

The parameters are the only thing on the driver. In a round every task runs its windows
forward and backward in Arrow batches and adds up their gradients; Spark adds the tasks'
sums, and the driver takes one Adam step. Sums are whole numbers of 2**-GRID, so
their order does not matter and a refit on the same windows gives the same model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Windows that a task holds at once, and the grid of the summed gradients.
_PIECE, GRID = 512, 36
#: Numbers of a gradient that tasks send side by side.
_BLOCK = 4096


def _into_sigmoid(z: np.ndarray) -> None:
    """In place, by exp, which takes a third of the time of tanh; far below zero exp overflows to the right 0."""
    np.negative(z, out=z)
    with np.errstate(over="ignore"):
        np.exp(z, out=z)
    z += 1.0
    np.reciprocal(z, out=z)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Above 0 down to -709; by tanh it would be 0 from -38 on."""
    out = np.array(x, dtype=float)
    _into_sigmoid(out)
    return out


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` with a product of its own for each row: in a product of many rows, the last digits of one depend on its place among them."""
    return (a[..., None, :] @ b)[..., 0, :]


@dataclass
class GatedUnit:
    """``inputs`` numbers a step, ``hidden`` states; weights in one flat array (reset, update and new state side by side)."""

    inputs: int
    hidden: int
    flat: np.ndarray

    @classmethod
    def fresh(cls, inputs: int, hidden: int, seed: int) -> GatedUnit:
        size = cls.size(inputs, hidden)
        return cls(inputs, hidden, np.random.default_rng(seed).uniform(-1, 1, size) / hidden**0.5)

    @staticmethod
    def size(inputs: int, hidden: int) -> int:
        return (inputs + hidden + 1) * 3 * hidden + hidden + 1

    def parts(self, flat: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Views of input weights, state weights, offsets, output weights, output offset."""
        flat, h = self.flat if flat is None else flat, self.hidden
        ends = np.cumsum([self.inputs * 3 * h, h * 3 * h, 3 * h, h, 1])
        w, u, b, v, c = np.split(flat, ends[:-1])
        return w.reshape(self.inputs, 3 * h), u.reshape(h, 3 * h), b, v, c

    def _forward(self, x: np.ndarray, product=np.matmul) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """Logits of windows (window, step, input), and what the way back needs, all by step first:
        inputs, gates (reset, update and new state side by side), offers to the new state, states."""
        w, u, b, v, c = self.parts()
        h, (n, steps, _) = self.hidden, x.shape
        x = np.ascontiguousarray(x.transpose(1, 0, 2))
        gates = (product(x.reshape(steps * n, -1), w) + b).reshape(steps, n, 3 * h)
        states, offers = np.zeros((steps + 1, n, h)), np.empty((steps, n, h))
        for t in range(steps):
            both, new, kept = gates[t][:, : 2 * h], gates[t][:, 2 * h :], product(states[t], u)
            both += kept[:, : 2 * h]
            _into_sigmoid(both)
            offers[t] = kept[:, 2 * h :]
            new += both[:, :h] * offers[t]
            new *= 2.0  # tanh(z) is 2 * sigmoid(2 * z) - 1
            _into_sigmoid(new)
            new *= 2.0
            new -= 1.0
            states[t + 1] = (states[t] - new) * both[:, h:] + new
        return product(states[-1], v[:, None])[:, 0] + c, (x, gates, offers, states)

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Scores of windows; a window has the same one whichever windows are scored with it."""
        return _sigmoid(self._forward(x, _apart)[0])

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: float) -> tuple[float, np.ndarray]:
        """Sum over windows of the loss, positives counted ``weight`` times, and its gradient."""
        logit, (x, gates, offers, states) = self._forward(x)
        _, u, _, v, _ = self.parts()
        h = self.hidden
        times = np.where(y > 0, weight, 1.0)
        loss = float((times * (np.logaddexp(0, logit) - y * logit)).sum())
        out = np.zeros_like(self.flat)
        gw, gu, gb, gv, gc = self.parts(out)
        slope = times * (_sigmoid(logit) - y)
        gv += slope @ states[-1]
        gc += slope.sum()
        back = slope[:, None] * v
        of_state = np.empty(gates.shape[1:])
        for t in range(len(gates) - 1, -1, -1):
            reset, update, new = gates[t][:, :h], gates[t][:, h : 2 * h], gates[t][:, 2 * h :]
            passed = back * (1 - update)
            d_new = passed * (1 - new * new)
            d_update = (states[t] - new) * update * passed
            d_reset = d_new * offers[t] * reset * (1 - reset)
            back *= update
            of_state[:, :h], of_state[:, h : 2 * h], of_state[:, 2 * h :] = d_reset, d_update, d_new * reset
            # The slopes by the inputs take the place of the gates, which no earlier step needs.
            reset[:], update[:], new[:] = d_reset, d_update, d_new
            if t:  # The first state is zero and has no part before it.
                gu += states[t].T @ of_state
                back += of_state @ u.T
        slopes = gates.reshape(-1, 3 * h)
        gw += x.reshape(len(slopes), -1).T @ slopes
        gb += slopes.sum(0)
        return loss, out

    def save(self, spark: SparkSession, path: str) -> None:
        row = (self.inputs, self.hidden, self.flat.tolist())
        spark.createDataFrame([row], "inputs int, hidden int, flat array<double>").write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GatedUnit:
        row = spark.read.parquet(path).first()
        return cls(row["inputs"], row["hidden"], np.array(row["flat"]))


def _windows(batch: pa.RecordBatch, steps: int, start: int) -> np.ndarray:
    part = batch.column("features").slice(start, _PIECE)
    return part.flatten().to_numpy().reshape(len(part), steps, -1)


def summed_gradient(windows: DataFrame, unit: GatedUnit, steps: int, weight: float) -> tuple[float, np.ndarray]:
    """(loss, gradient) summed over all rows (features: one flat array, label)."""
    size, scale = len(unit.flat), float(1 << GRID)
    blocks = -(-(size + 1) // _BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(blocks * _BLOCK)
        for batch in batches:
            y = batch.column("label").to_numpy()
            for start in range(0, batch.num_rows, _PIECE):
                loss, g = unit.gradient(_windows(batch, steps, start), y[start : start + _PIECE], weight)
                total[:size] += g
                total[size] += loss
        whole = np.rint(total * scale).astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(blocks + 1, dtype=np.int32) * _BLOCK), pa.array(whole))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(blocks, dtype=np.int32)), lists], names=["block", "g"])

    def add(part: pa.Table) -> pa.Table:
        sums = sum(c.flatten().to_numpy().reshape(-1, _BLOCK).sum(0) for c in part.column("g").chunks)
        return pa.table({"block": part.column("block").slice(0, 1), "g": pa.array([sums])})

    # A task sends its sums as a few arrays, not number by number.
    kind = "block int, g array<bigint>"
    found = windows.select("features", "label").mapInArrow(run, kind).groupBy("block").applyInArrow(add, kind).toArrow()
    out = np.zeros((blocks, _BLOCK))
    if found.num_rows:
        out[found["block"].to_numpy()] = np.array(found["g"].to_pylist()) / scale
    out = out.ravel()
    return float(out[size]), out[:size]


def train(
    windows: DataFrame, inputs: int, steps: int, hidden: int, rounds: int, rate: float, seed: int, weight: float, n: int
) -> tuple[GatedUnit, list[float]]:
    """(unit, mean loss before each round) after ``rounds`` Adam steps over all windows."""
    unit, losses = GatedUnit.fresh(inputs, hidden, seed), []
    mean, square = np.zeros_like(unit.flat), np.zeros_like(unit.flat)
    for k in range(1, rounds + 1):
        loss, g = summed_gradient(windows, unit, steps, weight)
        losses.append(loss / n)
        g = g / n
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g**2
        step = rate * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.999**k)) + 1e-8)
        unit = GatedUnit(inputs, hidden, unit.flat - step)
    return unit, losses


def scored(windows: DataFrame, unit: GatedUnit, steps: int) -> DataFrame:
    """(account, ids, seq_score) of rows (account, ids, features)."""
    kind = windows.schema["account"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [unit.probability(_windows(batch, steps, s)) for s in range(0, batch.num_rows, _PIECE)]
            p = pa.array(np.concatenate(pieces) if pieces else np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column("account"), batch.column("ids"), p], names=["account", "ids", "seq_score"])

    return windows.select("account", "ids", "features").mapInArrow(run, f"account {kind}, ids array<string>, seq_score double")
