"""Dense and convolutional forecasts, trained on all rows in parallel.

Samples have an input array x (steps by channels, row by row) and an output array y. In every step the tasks
add up the gradients of the rows they hold, one aggregate adds these up, and the weights, whose number is fixed by
the model, go back with the next step. Steps take one slice of the rows each, and a slice is a folder of its own, so a
step reads its rows alone. After each epoch the whole state is written to the folder given, from which a later fit goes on.

Defined results: rows whose x or y is null, of another length, or holds a null or non-finite number don't count
and get a null forecast (for y: only in training). Without rows the weights stay as they were drawn. Repeated rows count
as often as they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sums import matrix, summed, whole
from tidemark.plans.lineage import dropped, shared_path

#: Rows whose activations a task holds at a time.
ROWS = 1024

ACTIVATIONS = {
    "relu": (lambda z: np.maximum(z, 0), lambda z: (z > 0).astype(float)),
    "tanh": (np.tanh, lambda z: 1 - np.tanh(z) ** 2),
    "sigmoid": (lambda z: 0.5 * (1 + np.tanh(z / 2)), lambda z: 0.25 * (1 - np.tanh(z / 2) ** 2)),
    "linear": (lambda z: z, np.ones_like),
}


@dataclass
class Dense:
    """Hidden layers of `units` each over the flat input, then all outputs by one linear layer that starts at zero."""

    inputs: int
    outputs: int
    units: int = 32
    layers: int = 1
    activation: str = "relu"

    def shapes(self) -> list[tuple[int, int]]:
        width = [self.inputs, *[self.units] * self.layers, self.outputs]
        return list(zip(width[:-1], width[1:], strict=True))

    def patches(self, h: np.ndarray, layer: int) -> np.ndarray:
        return h

    def spread(self, d: np.ndarray, layer: int) -> np.ndarray:
        return d

    def enter(self, x: np.ndarray) -> np.ndarray:
        return x

    def leave(self, h: np.ndarray) -> np.ndarray:
        return h.reshape(len(h), -1)

    def arrive(self, d: np.ndarray) -> np.ndarray:
        return d


@dataclass
class Convolution(Dense):
    """Layers of `units` filters of kernel x kernel over the image of steps and channels, padded to keep its size, then
    one linear filter of 1 x 1: an output for each place of the image. inputs = outputs = steps * channels."""

    channels: int = 1
    kernel: int = 3

    def __post_init__(self):
        if self.inputs != self.outputs or self.inputs % self.channels or self.kernel % 2 == 0:
            raise ValueError("a convolution has an output for each input, and an odd kernel")

    def shapes(self) -> list[tuple[int, int]]:
        k = self.kernel**2
        return [*[((1 if i == 0 else self.units) * k, self.units) for i in range(self.layers)], (self.units if self.layers else 1, 1)]

    def patches(self, h: np.ndarray, layer: int) -> np.ndarray:
        """(rows, steps, channels, depth) to (rows, steps, channels, kernel * kernel * depth)."""
        if layer == self.layers:
            return h
        p, k = self.kernel // 2, self.kernel
        wide = np.pad(h, ((0, 0), (p, p), (p, p), (0, 0)))
        return np.concatenate([wide[:, a : a + h.shape[1], b : b + h.shape[2]] for a in range(k) for b in range(k)], axis=3)

    def spread(self, d: np.ndarray, layer: int) -> np.ndarray:
        """The gradient of patches, added up where patches overlap."""
        if layer == self.layers:
            return d
        p, k = self.kernel // 2, self.kernel
        n, s, c, depth = *d.shape[:3], d.shape[3] // k**2
        wide = np.zeros((n, s + 2 * p, c + 2 * p, depth))
        for j in range(k * k):
            wide[:, j // k : j // k + s, j % k : j % k + c] += d[..., j * depth : (j + 1) * depth]
        return wide[:, p : p + s, p : p + c]

    def enter(self, x: np.ndarray) -> np.ndarray:
        return x.reshape(len(x), -1, self.channels, 1)

    def arrive(self, d: np.ndarray) -> np.ndarray:
        return d.reshape(len(d), -1, self.channels, 1)


def drawn(net: Dense, seed: int) -> np.ndarray:
    """All weights as one vector: uniform by the sizes of a layer's two sides, the last layer and all biases zero."""
    rng, parts = np.random.default_rng(seed), []
    shapes = net.shapes()
    for k, (a, b) in enumerate(shapes):
        bound = np.sqrt(6 / (a + b)) if k < len(shapes) - 1 else 0.0
        parts += [rng.uniform(-bound, bound, a * b), np.zeros(b)]
    return np.concatenate(parts)


def _layers(net: Dense, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in net.shapes():
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def forecast(net: Dense, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
    act, h = ACTIVATIONS[net.activation][0], net.enter(x)
    layers = _layers(net, flat)
    for k, (w, b) in enumerate(layers):
        h = net.patches(h, k) @ w + b
        h = act(h) if k < len(layers) - 1 else h
    return net.leave(h)


def gradient(net: Dense, flat: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The sum of squared errors over rows and outputs, and its gradient by all weights, as one vector."""
    act, slope = ACTIVATIONS[net.activation]
    layers, h, seen = _layers(net, flat), net.enter(x), []
    for k, (w, b) in enumerate(layers):
        inside = net.patches(h, k)
        z = inside @ w + b
        seen.append((inside, z))
        h = act(z) if k < len(layers) - 1 else z
    error = net.leave(h) - y
    d, parts = net.arrive(2 * error), []
    for k in reversed(range(len(layers))):
        inside, z = seen[k]
        if k < len(layers) - 1:
            d = d * slope(z)
        flat_d = d.reshape(-1, d.shape[-1])
        parts.append(np.concatenate([(inside.reshape(-1, inside.shape[-1]).T @ flat_d).ravel(), flat_d.sum(0)]))
        if k:
            d = net.spread(d @ layers[k][0].T, k)
    return np.concatenate([[(error**2).sum()], *reversed(parts)])


@dataclass
class State:
    """What training goes on from: Adam's moments, and the best weights on the validation rows so far."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    best: np.ndarray
    epoch: int = 0
    steps: int = 0
    loss: float = float("inf")
    since: int = 0


_STATE = "epoch int, steps long, loss double, since int, weights array<double>, first array<double>, second array<double>, best array<double>"


def _save(spark, folder: str, s: State) -> None:
    row = (s.epoch, s.steps, s.loss, s.since, *[v.tolist() for v in (s.weights, s.first, s.second, s.best)])
    spark.createDataFrame([row], _STATE).coalesce(1).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/state-{s.epoch:06d}")


def _load(spark, folder: str) -> State | None:
    try:
        row = spark.read.schema(_STATE).parquet(f"{folder.rstrip('/')}/state-*").orderBy(F.col("epoch").desc()).first()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return row and State(*[np.array(row[c]) for c in ("weights", "first", "second", "best")], row["epoch"], row["steps"], row["loss"], row["since"])


@dataclass
class Network:
    """Trains net by Adam on the mean squared error; ends when the validation rows' error hasn't fallen for `patience` epochs.

    Keeps the weights that were best there. Without validation rows all epochs run and the last weights are kept.
    """

    net: Dense
    epochs: int = 20
    slices: int = 8
    rate: float = 0.001
    patience: int = 2
    seed: int = 42
    history: list[float] = field(default_factory=list)

    def _usable(self, samples: DataFrame) -> DataFrame:
        rows = samples.where(whole("x", self.net.inputs) & whole("y", self.net.outputs))
        return rows.select(F.col("x").cast("array<double>").alias("x"), F.col("y").cast("array<double>").alias("y"))

    def sums(self, rows: DataFrame, flat: np.ndarray, train: bool = True) -> np.ndarray:
        """(rows, squared error, and its gradient where train) over rows (x, y)."""
        net, size = self.net, 2 + (len(flat) if train else 0)

        def of(b: pa.RecordBatch) -> np.ndarray:
            x, y = matrix(b.column(0), net.inputs), matrix(b.column(1), net.outputs)
            total = np.zeros(size)
            for i in range(0, len(x), ROWS):
                u, v = x[i : i + ROWS], y[i : i + ROWS]
                total[0] += len(u)
                total[1:] += gradient(net, flat, u, v) if train else ((forecast(net, flat, u) - v) ** 2).sum()
            return total

        return summed(rows, of, size)

    def fit(self, train: DataFrame, validation: DataFrame | None = None, folder: str | None = None) -> Network:
        """folder: where the state of each epoch is kept; a fit with the same folder goes on after the last one."""
        spark = train.sparkSession
        start = drawn(self.net, self.seed)
        state = (_load(spark, folder) if folder else None) or State(start, np.zeros_like(start), np.zeros_like(start), start)
        path = shared_path(spark, "slices")
        dealt = self._usable(train).withColumn("slice", F.pmod(F.xxhash64("x", "y", F.lit(self.seed)), F.lit(self.slices)))
        dealt.write.partitionBy("slice").parquet(path)
        held = None if validation is None else self._usable(validation)
        if held is not None:
            at = shared_path(spark, "validation")
            held.write.parquet(at)
            held = spark.read.schema(held.schema).parquet(at)
        rows = spark.read.schema("x array<double>, y array<double>, slice long").parquet(path)
        while state.epoch < self.epochs and state.since < self.patience:
            order = np.random.default_rng([self.seed, state.epoch]).permutation(self.slices)
            for k in order.tolist():
                self._step(state, self.sums(rows.where(F.col("slice") == k).select("x", "y"), state.weights))
            state.epoch += 1
            n, loss = self.sums(held, state.weights, False) if held is not None else (0, 0)
            if not n:
                state.best = state.weights
            elif loss / n < state.loss:
                state.loss, state.since, state.best = float(loss / n), 0, state.weights
            else:
                state.since += 1
            self.history.append(float(loss / n) if n else float("nan"))
            if folder:
                _save(spark, folder, state)
        dropped(rows, *([] if held is None else [held]))
        self.weights = state.best
        return self

    def _step(self, s: State, sums: np.ndarray) -> None:
        if not sums[0]:
            return
        g = sums[2:] / (sums[0] * self.net.outputs)
        s.steps += 1
        s.first, s.second = 0.9 * s.first + 0.1 * g, 0.999 * s.second + 0.001 * g * g
        s.weights = s.weights - self.rate * (s.first / (1 - 0.9**s.steps)) / (np.sqrt(s.second / (1 - 0.999**s.steps)) + 1e-7)

    def predict(self, samples: DataFrame) -> DataFrame:
        """Adds y_pred, an array of the outputs."""
        net, flat = self.net, self.weights

        @F.pandas_udf("array<double>")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in parts:
                known = x.notna()
                out = pd.Series([None] * len(x), dtype=object)
                if known.any():
                    made = np.stack(x[known].to_numpy()).astype(float)
                    out[known.to_numpy()] = pd.Series([r for i in range(0, len(made), ROWS) for r in forecast(net, flat, made[i : i + ROWS])], index=out.index[known.to_numpy()])
                yield out

        return samples.withColumn("y_pred", run(F.when(whole("x", net.inputs), F.col("x").cast("array<double>"))))
