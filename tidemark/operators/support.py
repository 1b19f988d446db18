"""Support-vector regression over all rows: linear, polynomial, or radial by random Fourier features.

It minimises 1/2 |w|^2 + C * sum(max(0, |y - w.phi(x) - b| - epsilon)). The loss is replaced by its Moreau envelope, whose
distance from it is at most mu / 2 a row; Newton steps on that need only sums over all rows of a fixed size (one aggregate a
step, one more for the length of the step), and mu falls until the distance is a small share of the objective. `gap` is how far
the objective reached lies above the envelope, whose minimum is never above the true one, plus the decrease that the next Newton
step promises. No row has a state, and a lost executor costs one pass.

Defined results: rows with a null or non-finite input or y don't count, and have a null forecast (y: only in training). A
constant input counts as zero. Without usable rows there is no model and every forecast is null.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations_with_replacement
from math import factorial, prod

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import finite
from tidemark.operators.sums import matrix, summed
from tidemark.plans.lineage import dropped, stored

#: Rows whose features a task holds at a time.
ROWS = 4096
#: Lengths of a step that are tried at once.
LENGTHS = 0.5 ** np.arange(12)


class SupportVector:
    """kernel: "linear", "poly" (gamma x.z)^degree by its own monomials, or "rbf" by `size` random features."""

    def __init__(self, kernel: str = "rbf", c: float = 1.0, epsilon: float = 0.1, size: int = 128, degree: int = 3, share: float = 0.002, most: int = 100, seed: int = 42):
        if kernel not in ("linear", "poly", "rbf"):
            raise ValueError(f"no kernel {kernel}")
        self.kernel, self.c, self.epsilon, self.size, self.degree, self.share, self.most, self.seed = kernel, c, epsilon, size, degree, share, most, seed

    def _map(self, n: int):
        """phi of standardised rows; gamma is 1 / n."""
        if self.kernel == "linear":
            return lambda x: x
        if self.kernel == "poly":
            terms = list(combinations_with_replacement(range(n), self.degree))
            weights = [np.sqrt(factorial(self.degree) / prod(factorial(k) for k in Counter(t).values()) / n**self.degree) for t in terms]
            return lambda x: np.stack([w * x[:, t].prod(1) for t, w in zip(map(list, terms), weights, strict=True)], 1)
        rng = np.random.default_rng(self.seed)
        turn, shift, scale = rng.normal(0, np.sqrt(2 / n), (n, self.size)), rng.uniform(0, 2 * np.pi, self.size), np.sqrt(2 / self.size)
        return lambda x: scale * np.cos(x @ turn + shift)

    def _blocks(self, x: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        for i in range(0, len(x), ROWS):
            at = slice(i, i + ROWS)
            yield at, np.concatenate([self.phi((x[at] - self.mean) / self.std), np.ones((len(x[at]), 1))], 1)

    def _state(self, rows: DataFrame, w: np.ndarray, mu: float) -> tuple[float, float, np.ndarray, np.ndarray]:
        """(envelope, objective, gradient, curvature) at w, the last weight being b."""
        width, c, epsilon, n = len(w), self.c, self.epsilon, len(self.mean)

        def of(b: pa.RecordBatch) -> np.ndarray:
            x, y, total = matrix(b.column(0), n), b.column(1).to_numpy(), np.zeros(2 + width + width * width)
            for at, phi in self._blocks(x):
                r = y[at] - phi @ w
                t = np.abs(r) - epsilon
                bent = (t > 0) & (t < mu)
                total[0] += np.where(bent, t * t / (2 * mu), np.maximum(t - mu / 2, 0)).sum()
                total[1] += np.maximum(t, 0).sum()
                total[2 : 2 + width] -= (np.sign(r) * np.clip(t / mu, 0, 1)) @ phi
                total[2 + width :] += (phi[bent].T @ phi[bent] / mu).ravel()
            return total

        s = c * summed(rows, of, 2 + width + width * width)
        own = np.append(w[:-1], 0.0)
        return s[0] + own @ own / 2, s[1] + own @ own / 2, s[2 : 2 + width] + own, s[2 + width :].reshape(width, width) + np.diag(np.append(np.ones(width - 1), 0.0))

    def _values(self, rows: DataFrame, w: np.ndarray, d: np.ndarray, mu: float) -> np.ndarray:
        """The envelope at w + length * d for each length."""
        c, epsilon, n = self.c, self.epsilon, len(self.mean)

        def of(b: pa.RecordBatch) -> np.ndarray:
            x, y, total = matrix(b.column(0), n), b.column(1).to_numpy(), np.zeros(len(LENGTHS))
            for at, phi in self._blocks(x):
                t = np.abs((y[at] - phi @ w)[:, None] - (phi @ d)[:, None] * LENGTHS) - epsilon
                total += np.where((t > 0) & (t < mu), t * t / (2 * mu), np.maximum(t - mu / 2, 0)).sum(0)
            return total

        tried = w[:-1, None] + d[:-1, None] * LENGTHS
        return c * summed(rows, of, len(LENGTHS)) + (tried * tried).sum(0) / 2

    def fit(self, samples: DataFrame, features: list[str]) -> SupportVector:
        self.features, n = list(features), len(features)
        inputs = [finite(F.col(f).cast("double")) for f in features]
        usable = samples.select(F.array(*inputs).alias("x"), finite(F.col("y").cast("double")).alias("y")).where(F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
        rows = stored(usable, "support")
        told = rows.agg(F.count("*"), F.stddev_pop("y"), F.avg("y"), *[g(F.col("x")[i]) for i in range(n) for g in (F.avg, F.stddev_pop)]).first()
        count = told[0]
        self.weights, self.objective, self.gap, self.steps = None, 0.0, 0.0, 0
        if count:
            self.mean = np.array(told[3::2])
            self.std = np.array([s if s > 0 else 1.0 for s in told[4::2]])
            self.phi = self._map(n)
            w = np.zeros(len(self.phi(np.zeros((1, n)))[0]) + 1)
            w[-1] = told[2]
            self._descend(rows, w, max(told[1], 1e-9), count)
        dropped(rows)
        return self

    def _descend(self, rows: DataFrame, w: np.ndarray, mu: float, count: int) -> None:
        while True:
            envelope, objective, g, h = self._state(rows, w, mu)
            h[-1, -1] += 0.1 * self.c / mu  # a tenth of one row in the bend: b isn't held by |w|, and no row may lie there
            d = -np.linalg.solve(h, g)
            decrease = -g @ d / 2
            self.gap = objective - envelope + max(decrease, 0.0)
            settled = decrease <= 0.1 * self.share * max(objective, 1e-12)
            if settled and self.gap <= self.share * max(objective, 1e-12) or self.steps >= self.most:
                break
            if settled:
                mu /= 4
                continue
            values = self._values(rows, w, d, mu)
            k = int(np.argmin(values))
            self.steps += 1
            if values[k] >= envelope:
                mu /= 4
                continue
            w = w + LENGTHS[k] * d
        self.weights, self.objective = w, objective

    def predict(self, samples: DataFrame) -> DataFrame:
        """Adds y_pred."""
        if self.weights is None:
            return samples.withColumn("y_pred", F.lit(None).cast("double"))
        blocks, w, n = self._blocks, self.weights, len(self.features)

        @F.pandas_udf("double")
        def run(x: pd.Series) -> pd.Series:
            out = np.full(len(x), np.nan)
            known = x.notna().to_numpy()
            if known.any():
                rows = np.stack(x[known].to_numpy()).astype(float).reshape(-1, n)
                out[known] = np.concatenate([phi @ w for _, phi in blocks(rows)])
            return pd.Series(out).astype(object).where(known, None)

        x = F.array(*[finite(F.col(f).cast("double")) for f in self.features])
        return samples.withColumn("y_pred", run(F.when(~F.exists(x, lambda v: v.isNull()), x)))
