"""Slope-based detection by windows over buckets against the detection on each whole series in order."""

import datetime as dt

import numpy as np
import pytest

from tidemark.operators import sbad as module
from tidemark.operators.sbad import detect, sbad

SCHEMA = "series_id string, ts timestamp, value double, row_pos long, note int"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def made(n, seed, share):
    """Steps of 30 minutes over weeks, some with longer gaps; calm stretches, single and double jumps, missing values."""
    rng = np.random.default_rng(seed)
    minutes = np.cumsum(30 * rng.choice([0.5, 1, 1, 1, 2, 30], n))
    values = rng.normal(0, 1, n).cumsum() * 0.1
    jumps = rng.random(n) < share
    values[jumps] += rng.choice([-900, 900, 2000], jumps.sum())
    values[rng.random(n) < 0.03] = np.nan
    return minutes, values


def frame(spark, series):
    rows = [(k, START + dt.timedelta(minutes=float(m)), float(v), i, 7) for k, (ms, vs) in series.items() for i, (m, v) in enumerate(zip(ms, vs, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("longest", [45, 600])
def test_equal_to_the_whole_series(spark, longest):
    series = {f"s{k}": made(n, k, share) for k, (n, share) in enumerate([(900, 0.05), (900, 0.4), (700, 0.9), (300, 0.01), (1, 0), (2, 1), (40, 0.5)])}
    series["up and down"] = (30.0 * np.arange(800), np.where(np.arange(800) % 2, 900.0, 0.0))
    series["missing"] = (30.0 * np.arange(5), np.full(5, np.nan))
    series["calm"] = (30.0 * np.arange(50), np.zeros(50))
    out = sbad(frame(spark, series), 1.0, longest)
    assert out.columns == ["series_id", "ts", "value", "row_pos", "note"]
    got = {(r["series_id"], r["row_pos"]): r["value"] for r in out.collect()}
    assert len(got) == sum(len(m) for m, _ in series.values())
    for k, (minutes, values) in series.items():
        expected = detect(minutes - minutes[0], values, 1.0, longest)
        assert [got[k, i] for i in range(len(values))] == [None if np.isnan(v) else v for v in expected], k


@pytest.mark.parametrize("chunk", [1, 12, 60])
def test_stretches_settle_by_chunks_or_by_windows(spark, monkeypatch, chunk):
    """Stretches between missing values, some longer than a chunk, some at a series' end: the rows of whole series."""
    monkeypatch.setattr(module, "CHUNK", chunk)
    series = {f"s{k}": made(n, 20 + k, share) for k, (n, share) in enumerate([(500, 0.1), (500, 0.5), (300, 0.02), (1, 0), (45, 0.4)])}
    series["calm"] = (30.0 * np.arange(150), np.zeros(150))
    got = {(r["series_id"], r["row_pos"]): r["value"] for r in sbad(frame(spark, series), 1.0, 90).collect()}
    assert len(got) == sum(len(m) for m, _ in series.values())
    for k, (minutes, values) in series.items():
        expected = detect(minutes - minutes[0], values, 1.0, 90)
        assert [got[k, i] for i in range(len(values))] == [None if np.isnan(v) else v for v in expected], k


def test_jobs_do_not_grow_with_the_passes(spark):
    """A series that takes many passes is settled in the jobs of one pass where its stretches fit a chunk."""
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    used = []
    for share in (0.0, 0.6):
        before = jobs()
        sbad(frame(spark, {"a": made(900, 2, share)}), 1.0, 45).collect()
        used.append(jobs() - before)
    assert used[1] <= used[0] + 5


def test_empty_and_equal_times(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sbad(empty, 1.0, 30).collect() == []
    minutes, values = np.repeat(30.0 * np.arange(40), 2), np.random.default_rng(9).choice([0.0, 0.0, 50.0], 80)
    got = sorted((r["row_pos"], r["value"]) for r in sbad(frame(spark, {"a": (minutes, values)}), 1.0, 90).collect())
    expected = detect(minutes, values, 1.0, 90)
    assert [v for _, v in got] == [None if np.isnan(v) else v for v in expected]
