"""The whole cleaning chain against a plain version that goes through each series in order."""

import datetime as dt

import numpy as np
import pytest

from tidemark.operators.clean import fill_gaps
from tidemark.operators.sbad import detect
from tidemark.plans.preparation import CleanSpec, cleaned

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SPEC = CleanSpec(constant_min=60, zeros=True, low=-20, high=250, max_change=1.0, max_length=120, short_min=45, max_gap=100)


def filled(t, v):
    known = np.flatnonzero(~np.isnan(v))
    out = v.copy()
    for a, b in zip(known[:-1], known[1:], strict=True):
        if t[b] - t[a] <= SPEC.max_gap:
            for i in range(a + 1, b):
                out[i] = v[a] + (v[b] - v[a]) * (t[i] - t[a]) / (t[b] - t[a])
    return out


def runs(same, n):
    """(first, last) of the runs of rows that same(i - 1, i) holds together."""
    starts = [i for i in range(n) if i == 0 or not same(i - 1, i)]
    return list(zip(starts, [s - 1 for s in starts[1:]] + [n - 1], strict=True)) if n else []


def plain(t, v):
    v = v.copy()
    for a, b in runs(lambda i, j: v[i] == v[j], len(v)):
        if b > a and t[b] - t[a] >= SPEC.constant_min:
            v[a : b + 1] = np.nan
    v = filled(t, v)
    v = filled(t, np.where(v == 0, np.nan, v))
    v = filled(t, np.where((v > SPEC.high) | (v < SPEC.low), np.nan, v))
    v = filled(t, detect(t, v, SPEC.max_change, SPEC.max_length))
    known = ~np.isnan(v)
    for a, b in runs(lambda i, j: known[i] == known[j], len(v)):
        if known[a] and t[b] - t[a] < SPEC.short_min and b < len(v) - 1:
            v[a : b + 1] = np.nan
    return v


def made(n, seed):
    rng = np.random.default_rng(seed)
    t = 30.0 * np.cumsum(rng.choice([1, 1, 1, 2, 6], n))
    v = np.round(100 + rng.normal(0, 4, n).cumsum(), 2)
    for k in rng.integers(0, n, n // 25):
        v[k : k + 4] = v[k]
    v[rng.random(n) < 0.04] = 0
    v[rng.random(n) < 0.04] = 900
    v[rng.random(n) < 0.04] += 140
    v[rng.random(n) < 0.08] = np.nan
    return t, v


def test_cleaning_chain(spark):
    series = {"a": made(600, 1), "b": made(120, 2), "c": made(3, 3), "none": (np.array([0.0, 30.0]), np.array([np.nan, np.nan]))}
    rows = [(k, START + dt.timedelta(minutes=float(m)), None if np.isnan(x) else float(x), i) for k, (t, v) in series.items() for i, (m, x) in enumerate(zip(t, v, strict=True))]
    out = cleaned(spark.createDataFrame(rows, "series_id string, ts timestamp, value double, row_pos long").repartition(4), SPEC)
    got = {(r["series_id"], r["row_pos"]): r["value"] for r in out.collect()}
    assert len(got) == len(rows)
    for k, (t, v) in series.items():
        expected = plain(t, v)
        mine = np.array([np.nan if got[k, i] is None else got[k, i] for i in range(len(v))])
        assert mine == pytest.approx(expected, abs=1e-8, nan_ok=True), k
    assert 0 < sum(x is None for x in got.values()) < len(rows)


def test_missing_between_two_values_at_one_time_stays(spark):
    """There is no line between two values at one time; the others are filled."""
    rows = [("a", START, 1.0, 0), ("a", START, None, 1), ("a", START, 3.0, 2), ("a", START + dt.timedelta(minutes=1), None, 3), ("a", START + dt.timedelta(minutes=2), 5.0, 4)]
    out = fill_gaps(spark.createDataFrame(rows, "series_id string, ts timestamp, value double, row_pos long"), 60)
    assert [r["value"] for r in sorted(out.collect(), key=lambda r: r["row_pos"])] == [1.0, None, 3.0, 4.0, 5.0]
