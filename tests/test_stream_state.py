"""Stateful streams against the batch operators on the same rows: in shuffled micro-batches, with late rows, and restarted after each batch."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import clean, sbad
from tidemark.operators.ordered import asof
from tidemark.operators.regrid import RegridSpec, regrid
from tidemark.sources.tables import event_series
from tidemark.streaming import state

SCHEMA = "series_id string, ts timestamp, value double, row_pos long"
START = dt.datetime(2024, 1, 1)
END = START + dt.timedelta(days=365)
COLUMNS = ["series_id", "ts", "value", "row_pos"]


def plain(df, columns):
    out = []
    for r in df.select(*columns).collect():
        out.append(tuple(round(v, 9) if isinstance(v, float) and not math.isnan(v) else v for v in r))
    return sorted(out, key=str)


def stream(spark, folder, batches, make, runs):
    """Write one file a batch; run the query to the end of what is there `runs` times, each time from its checkpoint."""
    state.rocksdb(spark)
    source, out = folder / "in", folder / "out"
    share = -(-len(batches) // runs)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        if (i + 1) % share == 0 or i + 1 == len(batches):
            lines = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
            query = make(lines).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(folder / "cp")).option("path", str(out)).trigger(availableNow=True).start()
            query.awaitTermination()
    return spark.read.parquet(str(out))


def dealt(rows, n, seed, jitter=40):
    """Rows in n batches, out of order by up to `jitter` minutes; two rows in the far future of each series end it."""
    rng = random.Random(seed)
    order = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rng.uniform(0, jitter)))
    size = -(-len(order) // n)
    batches = [order[i : i + size] for i in range(0, len(order), size)]
    return [*batches, [("end", END, 1.0, 10**9)], [("end", END + dt.timedelta(days=365), 1.0, 10**9 + 1)]]


def series(n, seed, missing=0.1, repeat=0.6):
    rng = random.Random(seed)
    rows = []
    for s in ("a", "b"):
        value, at = 1.0, START
        for _ in range(n):
            at += dt.timedelta(minutes=rng.choice([1, 5, 10]), seconds=rng.choice([0, 0, 7]))
            value = value if rng.random() < repeat else float(rng.randint(0, 4)) * (10 if rng.random() < 0.2 else 1)
            rows.append((s, at, None if rng.random() < missing else value, len(rows)))
    return rows


@pytest.mark.parametrize("runs", [1, 3])
def test_constant_runs(spark, tmp_path, runs):
    rows = series(90, 1)
    got = stream(spark, tmp_path, dealt(rows, 4, 1), lambda s: state.drop_constant_runs(s, 20, 24 * 60), runs)
    expected = clean.drop_constant_runs(spark.createDataFrame(rows, SCHEMA), 20)
    assert plain(got.where("series_id != 'end'"), COLUMNS) == plain(expected, COLUMNS)
    assert expected.where("value is null").count() > sum(r[2] is None for r in rows)


def test_slope_anomalies(spark, tmp_path):
    rows = [r for i, r in enumerate(series(150, 2, 0.05, 0.3)) if i % 50 > 3]  # gaps that end parts
    rows = [(s, t + dt.timedelta(hours=6 * (i // 50)), v, p) for i, (s, t, v, p) in enumerate(rows)]
    got = stream(spark, tmp_path, dealt(rows, 5, 2), lambda s: state.slope_anomalies(s, 1.0, 30, 120), 2)
    expected = sbad.sbad(spark.createDataFrame(rows, SCHEMA), 1.0, 30, split_gap=120)
    assert plain(got.where("series_id != 'end'"), COLUMNS) == plain(expected, COLUMNS)


def test_interpolation(spark, tmp_path, gap=12):
    rows = series(100, 3, 0.3)
    got = stream(spark, tmp_path, dealt(rows, 5, 3), lambda s: state.interpolated(s, 7, 3, gap, 24 * 60), 2)
    expected = regrid(spark.createDataFrame(rows, SCHEMA), RegridSpec("intrpl", step=7, offset=3, max_gap=gap))
    assert plain(got.where("series_id != 'end'"), COLUMNS[:3]) == plain(expected, COLUMNS[:3])


def test_interpolation_of_events(spark, tmp_path):
    events = event_series(spark, "/root/testdata/sf0.001", 7).select(*COLUMNS)
    rows = [tuple(r) for r in events.collect()]
    got = stream(spark, tmp_path, dealt(rows, 4, 4, 600), lambda s: state.interpolated(s, 60, 10, 120, 60 * 24 * 30, late="12 hours"), 1)
    expected = regrid(events, RegridSpec("intrpl", step=60, offset=10, max_gap=120))
    assert plain(got.where("series_id != 'end'"), COLUMNS[:3]) == plain(expected, COLUMNS[:3])


def test_asof_of_two_streams(spark, tmp_path):
    rows = series(100, 5, 0.2)
    left = [(s, t, v, p) for s, t, v, p in rows if p % 3 == 0]
    right = [(s, t, v, p) for s, t, v, p in rows if p % 3 != 0] + [(s, t, 99.0, 5000 + p) for s, t, v, p in left[::4]]
    got = stream(spark, tmp_path, dealt(left + right, 5, 5), lambda x: state.asof(x.where("row_pos < 5000 and row_pos % 3 = 0 or series_id = 'end'"), x.where("row_pos >= 5000 or row_pos % 3 != 0"), 30), 2)
    sides = [spark.createDataFrame(x, SCHEMA) for x in (left, right)]
    near = asof(sides[0], sides[1].where("value is not null"))
    hit = F.unix_micros("ts") - F.unix_micros("prior.ts") <= 30 * 60_000_000
    expected = near.select("series_id", "ts", "row_pos", "value", F.when(hit, F.col("prior.ts")).alias("found_ts"), F.when(hit, F.col("prior.value")).alias("found"))
    columns = ["series_id", "ts", "row_pos", "value", "found_ts", "found"]
    assert plain(got.where("series_id != 'end'"), columns) == plain(expected, columns)


def test_late_rows_are_dropped_and_quiet_series_end(spark, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    first = [("a", at(0), 5.0, 0), ("a", at(5), 5.0, 1), ("a", at(300), 1.0, 2)]
    late = [("a", at(10), 5.0, 3), ("a", at(310), 2.0, 4)]  # the watermark is at 240 minutes
    again = [("a", at(3000), 2.0, 5), ("a", at(3005), 2.0, 6), ("a", at(3020), 2.0, 7)]  # after a quiet time a new series
    batches = [first, [("b", at(301), 1.0, 9)], late, again, [("b", END, 1.0, 10)], [("b", END + dt.timedelta(days=1), 1.0, 11)]]
    got = stream(spark, tmp_path, batches, lambda s: state.drop_constant_runs(s, 10, 24 * 60), 6)
    assert [(r[3], r[2]) for r in sorted(got.where("series_id = 'a'").collect(), key=lambda r: r[3])] == [(0, 5.0), (1, 5.0), (2, 1.0), (4, 2.0), (5, None), (6, None), (7, None)]
