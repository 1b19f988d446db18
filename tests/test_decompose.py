"""Decomposition and autoregression by chunks against plain versions over whole series."""

import datetime as dt

import numpy as np
import pytest

from tidemark.operators import decompose, windows

SCHEMA = "series_id string, ts timestamp, value double, row_pos long"


def frame(spark, series):
    start = dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(hours=i), float(v), i) for k, y in series.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def made(n, period, seed):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    y = 0.02 * t + 3 * np.sin(2 * np.pi * t / period) + rng.normal(0, 0.3, n)
    y[rng.integers(0, n, n // 40)] += 15
    return y


def local(y, width, at, robust):
    """A weighted straight line through the nearest `width` places, one place at a time."""
    n, q = len(y), min(width, len(y))
    out = []
    for p in at:
        first = int(np.clip(np.round(p - (q - 1) / 2), 0, n - q))
        d = np.arange(first, first + q) - p
        h = max(np.abs(d).max(), 1e-9) + max(width - n, 0) // 2
        w = np.clip(1 - (np.abs(d) / (h * 1.001)) ** 3, 0, None) ** 3
        if robust is not None:
            w = w * (robust[first : first + q] + 1e-9)
        mean = (w * d).sum() / w.sum()
        spread = (w * (d - mean) ** 2).sum()
        level = (w * y[first : first + q]).sum() / w.sum()
        slope = (w * (d - mean) * y[first : first + q]).sum() / spread if spread > 1e-12 * w.sum() else 0.0
        out.append(level - slope * mean)
    return np.array(out)


def plain(y, period, rounds):
    n, odd = len(y), lambda x: int(np.ceil(x)) | 1
    trend, robust = np.zeros(n), None
    for k in range(rounds):
        for _ in range(2):
            cycle = np.empty(n + 2 * period)
            for p in range(period):
                sub = (y - trend)[p::period]
                cycle[p + period * np.arange(len(sub) + 2)] = local(sub, 7, range(-1, len(sub) + 1), None if robust is None else robust[p::period])
            low = cycle
            for width in (period, period, 3):
                low = np.convolve(low, np.ones(width) / width, "valid")
            season = cycle[period : period + n] - local(low, odd(period), range(n), None)
            trend = local(y - season, odd(1.5 * period / (1 - 1.5 / 7)), range(n), robust)
        resid = y - season - trend
        if k < rounds - 1:
            robust = np.clip(1 - (resid / (6 * np.median(np.abs(resid)))) ** 2, 0, 1) ** 2
    return trend, season, resid


@pytest.mark.parametrize("robust", [True, False])
def test_decomposition_by_chunks_equals_the_whole_series(spark, monkeypatch, robust):
    monkeypatch.setattr(decompose, "CHUNK", 100)
    series = {"long": made(700, 5, 1), "short": made(11, 5, 2), "other": made(241, 5, 3)}
    out = decompose.decompose(frame(spark, series), 5, robust).orderBy("series_id", "ts").toPandas()
    for k, y in series.items():
        got = out[out["series_id"] == k]
        assert got["value"].to_numpy() == pytest.approx(y)
        for name, v in zip(("trend", "seasonal", "resid"), plain(y, 5, 4 if robust else 1), strict=True):
            assert got[name].to_numpy() == pytest.approx(v, abs=1e-7)


def test_decomposition_refuses(spark):
    df = frame(spark, {"a": made(30, 5, 1), "b": [1.0, float("nan"), *[2.0] * 20]})
    with pytest.raises(ValueError, match="missing"):
        decompose.decompose(df, 5)
    with pytest.raises(ValueError, match="missing"):
        decompose.forecast_residuals(df, 2)
    with pytest.raises(ValueError, match="period"):
        decompose.decompose(df.where("series_id = 'a'"), 16)
    none = df.limit(0)
    assert decompose.decompose(none, 5).collect() == []
    assert decompose.forecast_residuals(none, 3).collect() == []


def test_autoregression_equals_least_squares(spark, monkeypatch):
    monkeypatch.setattr(windows, "STRETCH", 50)
    series = {"long": made(400, 7, 4), "few": made(7, 7, 5), "enough": made(12, 7, 6)}
    out = decompose.forecast_residuals(frame(spark, series), 3).orderBy("series_id", "ts").toPandas()
    for k, y in series.items():
        got = out[out["series_id"] == k]
        forecast = got["forecast"].to_numpy()
        if len(y) <= 7:
            assert np.isnan(forecast).all()
            continue
        x = np.array([[*y[i - 3 : i], 1.0] for i in range(3, len(y))])
        w = np.linalg.lstsq(x, y[3:], rcond=None)[0]
        assert np.isnan(forecast[:3]).all()
        assert forecast[3:] == pytest.approx(x @ w, abs=1e-5)
        assert got["error"].to_numpy()[3:] == pytest.approx(np.abs(y[3:] - x @ w), abs=1e-5)
