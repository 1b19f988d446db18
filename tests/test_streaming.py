"""Streams over files: late rows, sessions, and batches that replace themselves."""

import datetime as dt

from tidemark.streaming import events

SCHEMA = "series_id string, ts timestamp, value double"


def at(minute, hour=0):
    return dt.datetime(2024, 1, 1, hour, minute)


def run(spark, tmp_path, batches, make):
    """Each batch is a file of its own, read one after the other."""
    source, out = tmp_path / "in", tmp_path / "out"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        stream = events.read(spark, str(source), SCHEMA, 1)
        query = events.write_batches(make(stream), str(out), str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(str(out))


def test_tumbling_means_leave_late_rows_out(spark, tmp_path):
    batches = [[("a", at(1), 1.0), ("a", at(3), 3.0), ("b", at(2), 5.0)], [("a", at(0, 3), 9.0)], [("a", at(2), 100.0), ("a", at(30, 6), 1.0)], [("a", at(0, 9), 1.0)]]
    out = run(spark, tmp_path, batches, lambda s: events.tumbling_mean(s, "5 minutes", "1 hour"))
    got = {(r["series_id"], r["window"]["start"]): (r["value"], r["n"]) for r in out.collect()}
    assert got["a", at(0)] == (2.0, 2)  # the row of the third batch came after the watermark
    assert got["b", at(0)] == (5.0, 1)
    assert got["a", at(0, 3)] == (9.0, 1)


def test_sessions_and_sliding(spark, tmp_path):
    rows = [("a", at(0), 1.0), ("a", at(20), 2.0), ("a", at(0, 2), 4.0)]
    out = run(spark, tmp_path, [rows, [("a", at(0, 9), 1.0)]], lambda s: events.sessions(s, "30 minutes", "1 hour"))
    assert sorted((r["n"], r["total"]) for r in out.collect()) == [(1, 4.0), (2, 3.0)]
    static = spark.createDataFrame(rows, SCHEMA)
    got = {(r["window"]["start"], r["value"]) for r in events.sliding_mean(static, "1 hour", "30 minutes").collect()}
    assert got == {(at(30) - dt.timedelta(hours=1), 1.5), (at(0), 1.5), (at(30, 1), 4.0), (at(0, 2), 4.0)}
