"""Seasonal-trend decomposition by LOESS (Cleveland et al. 1990) and an autoregressive residual detector.

A series is cut into chunks of rows, so one with a third of all rows is spread over tasks. A chunk brings so many rows of its
neighbours along that its own rows come out as in the whole series; between the rounds the median of the residuals, from which the
robust weights follow, is found over the whole series. The autoregressive model takes its normal equations from sums over all
windows. A series must have no missing value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.clean import ORDER, fill_gaps
from tidemark.operators.ordered import bucketed, numbered
from tidemark.operators.quantiles import quantiles
from tidemark.operators.sums import matrix
from tidemark.operators.windows import sliding
from tidemark.plans.lineage import dropped, stored

#: Rows of a chunk, at least; of longer periods a chunk has REACH periods.
CHUNK = 100_000
#: Periods on either side of a chunk that its rows can depend on in one round of two passes: 6 of the seasonal smoothing at an
#: end of the series, 2 of the moving averages, 1 of the low-pass and 2 of the trend smoothing, in each pass.
REACH = 24


def valid_period(period: int, n: int) -> bool:
    return isinstance(period, int) and 2 <= period <= n // 2


def loess(y: np.ndarray, width: int, at: np.ndarray, robust: np.ndarray | None = None) -> np.ndarray:
    """Local lines through equidistant values with tricube weights, at places `at` (in steps)."""
    n = len(y)
    q = min(width, n)
    first = np.clip(np.round(at - (q - 1) / 2).astype(int), 0, n - q)
    cols = first[:, None] + np.arange(q)
    d = cols - at[:, None]
    h = np.maximum(np.abs(d).max(1), 1e-9) + (max(width - n, 0) // 2)
    w = np.clip(1 - (np.abs(d) / (h[:, None] * 1.001)) ** 3, 0, None) ** 3
    if robust is not None:
        w = w * (robust[cols] + 1e-9)
    s0, s1, s2 = w.sum(1), (w * d).sum(1), (w * d * d).sum(1)
    v = y[cols]
    t0, t1 = (w * v).sum(1), (w * d * v).sum(1)
    det = s0 * s2 - s1 * s1
    line = np.abs(det) > 1e-12 * np.maximum(s0 * s2, 1e-30)
    return np.where(line, (s2 * t0 - s1 * t1) / np.where(line, det, 1), t0 / s0)


def _moving(y: np.ndarray, n: int) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(y)])
    return (total[n:] - total[:-n]) / n


def _smooth(y: np.ndarray, width: int, at: np.ndarray, robust: np.ndarray | None) -> np.ndarray:
    return np.concatenate([loess(y, width, part, robust) for part in np.array_split(at.astype(float), max(1, len(at) * width // 4_000_000 + 1))])


def seasonal_trend(y: np.ndarray, trend: np.ndarray, robust: np.ndarray | None, period: int, seasonal: int = 7, passes: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(trend, seasonal) after one round of passes, from the trend and the robust weights before."""
    n = len(y)
    odd = lambda x: int(np.ceil(x)) | 1
    trend_width, low_width = odd(1.5 * period / (1 - 1.5 / seasonal)), odd(period)
    for _ in range(passes):
        detrended = y - trend
        cycle = np.empty(n + 2 * period)
        for k in range(period):
            sub = detrended[k::period]
            weights = None if robust is None else robust[k::period]
            cycle[k::period][: len(sub) + 2] = _smooth(sub, seasonal, np.arange(-1, len(sub) + 1), weights)
        low = _moving(_moving(_moving(cycle, period), period), 3)
        season = cycle[period : period + n] - _smooth(low, low_width, np.arange(n), None)
        trend = _smooth(y - season, trend_width, np.arange(n), robust)
    return trend, season


def _round(rows: DataFrame, period: int) -> DataFrame:
    """rows (series_id, i, n, value, trend, weight) with trend, seasonal and resid of one round, by chunks of places i from 0."""
    reach = REACH * period
    size = max(CHUNK, reach)
    at, last = F.floor(F.col("i") / size), F.floor((F.col("n") - 1) / size)
    low, high = F.floor((F.col("i") - reach) / size), F.floor((F.col("i") + reach) / size)
    near = rows.withColumn("_chunk", F.explode(F.sequence(F.greatest(low, F.lit(0).cast("long")), F.least(high, last)))).withColumn("_own", F.col("_chunk") == at)

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("i")
        weight = df["weight"].to_numpy(dtype=float)
        trend, season = seasonal_trend(df["value"].to_numpy(dtype=float), df["trend"].to_numpy(dtype=float), None if np.isnan(weight).all() else weight, period)
        df["trend"], df["seasonal"], df["resid"] = trend, season, df["value"] - season - trend
        return df[df["_own"]].drop(columns=["_chunk", "_own"])

    return near.groupBy("series_id", "_chunk").applyInPandas(run, f"{_plain(rows)}, seasonal double, resid double")


def _plain(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in ("seasonal", "resid"))


def _checked(series: DataFrame) -> DataFrame:
    missing = series.where(F.col("value").isNull() | F.isnan("value")).select("series_id").first()
    if missing:
        raise ValueError(f"series {missing[0]} has missing values")
    return series


def decompose(series: DataFrame, period: int, robust: bool = True) -> DataFrame:
    """Adds trend, seasonal and resid. ValueError for a series with gaps or a period out of bounds; an empty table stays empty.

    Runs jobs: each round's result is written as a table.
    """
    series = stored(series.select("series_id", "ts", "row_pos", "value"), "series")
    counts = _checked(series).groupBy("series_id").agg(F.count("*").alias("n"))
    short = counts.agg(F.min("n")).first()[0]
    if short is not None and not valid_period(period, short):
        raise ValueError(f"period {period} isn't between 2 and half of {short} rows")
    none = F.lit(None).cast("double")
    rows = numbered(bucketed(series), "i", ORDER).drop("_bucket").withColumn("i", F.col("i") - 1)
    rows = rows.join(counts, "series_id").withColumns({"trend": F.lit(0.0), "weight": none})
    rounds = 4 if robust else 1
    for k in range(rounds):
        out = stored(_round(rows, period), "decomposed")
        if k:
            dropped(rows)
        rows = out
        if k < rounds - 1:
            h = quantiles(rows.withColumn("_size", F.abs("resid")), "_size", [0.5], ["series_id"]).select("series_id", (6 * F.col("q")[0]).alias("_h"))
            share = F.col("resid") / F.col("_h")
            weight = F.when(F.col("_h") == 0, F.lit(1.0)).otherwise(F.pow(F.greatest(1 - share * share, F.lit(0.0)), 2))
            weighted = stored(rows.join(h, "series_id").withColumn("weight", weight).drop("_h", "seasonal", "resid"), "weighted")
            dropped(rows)
            rows = weighted
    dropped(series)
    return rows.select("series_id", "ts", "row_pos", "value", "trend", "seasonal", "resid")


def autoregression(windows: DataFrame, lags: int) -> DataFrame:
    """(series_id, weights): least squares of y on the `lags` values x before it and an intercept, the last weight.

    Windows are (series_id, x, y). A batch gives the sums of its own windows for each series in it, and these are added up
    by series and place. Series of no more than lags + 1 windows have no model.
    """
    size = lags + 1
    row, column = np.triu_indices(size + 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).dictionary_encode()
            x = np.concatenate([matrix(b.column(1), lags), np.ones((b.num_rows, 1)), b.column(2).to_numpy()[:, None]], 1)
            codes = ids.indices.to_numpy()
            for k, name in enumerate(ids.dictionary.to_pylist()):
                mine = x[codes == k]
                yield pa.RecordBatch.from_pydict({"series_id": pa.array([name] * len(row), pa.string()), "i": np.arange(len(row), dtype=np.int32), "v": (mine.T @ mine)[row, column]})

    @F.pandas_udf("array<double>")
    def solved(v: pd.Series) -> pd.Series:
        out = []
        for one in v:
            g = np.zeros((size + 1, size + 1))
            g[row, column] = one
            g = np.triu(g) + np.triu(g, 1).T
            out.append(np.linalg.solve(g[:size, :size] + 1e-9 * np.eye(size), g[:size, size]))
        return pd.Series(out)

    added = windows.select("series_id", "x", "y").mapInArrow(sums, "series_id string, i int, v double").groupBy("series_id", "i").agg(F.sum("v").alias("v"))
    whole = added.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("v"))
    # the place of intercept times intercept holds the number of windows
    count = int(np.flatnonzero((row == lags) & (column == lags))[0])
    return whole.where(F.col("v")[count] > size).select("series_id", solved("v").alias("weights"))


def forecast_residuals(series: DataFrame, lags: int) -> DataFrame:
    """Adds forecast and error (absolute) of an autoregressive model of each series; the first `lags` rows have none."""
    series = _checked(stored(series.select("series_id", "ts", "row_pos", "value"), "series"))
    windows = stored(sliding(series, lags), "windows")
    model = stored(autoregression(windows, lags), "autoregression")
    line = F.aggregate(F.zip_with("x", F.slice("weights", 1, lags), lambda a, b: a * b), F.element_at("weights", -1), lambda s, v: s + v)
    made = windows.join(model, "series_id").select("series_id", (F.col("i") + lags).alias("i"), line.alias("forecast"))
    rows = numbered(bucketed(series), "i", ORDER).join(made, ["series_id", "i"], "left")
    return rows.select("series_id", "ts", "row_pos", "value", "forecast", F.abs(F.col("value") - F.col("forecast")).alias("error"))


def drop_above(df: DataFrame, measure: str, threshold: float, max_gap: float | None = None, digits: int | None = None) -> DataFrame:
    """Values whose measure exceeds the threshold in size become missing; gaps are filled as asked."""
    out = df.withColumn("value", F.when(F.coalesce(F.abs(measure) <= threshold, F.lit(True)), F.col("value")))
    return fill_gaps(out.select("series_id", "ts", "value", "row_pos"), max_gap, digits)
