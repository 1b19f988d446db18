"""Tables changed by key, and JSON lines written by the executors."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import setops
from tidemark.sources import keyed, lines

KEYS = ["user", "kind"]


def add(old, new):
    return setops.upsert_add(old, new, KEYS, "n")


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(path + "/*/*.parquet")}


def test_batches_by_key(spark, tmp_path):
    path, total = str(tmp_path / "usage"), {}
    frame = lambda rows: spark.createDataFrame(rows, "user string, kind string, n long")
    batches = [[(f"u{i}", "a", i) for i in range(40)], [("u1", "a", 5), ("new", None, 1), (None, "b", 2)], [("u1", "a", 1)]]
    for number, rows in enumerate(batches):
        before = files(path)
        assert keyed.apply(path, frame(rows), KEYS, add, number, 8) > 0
        for u, k, n in rows:
            total[u, k] = total.get((u, k), 0) + n
        touched = {r[0] for r in frame(rows).select(keyed.bucket(KEYS, 8)).collect()}
        after = files(path)
        for f, at in before.items():
            assert (after.get(f) == at) == (int(f.split("_bucket=")[1].split("/")[0]) not in touched)
        assert keyed.apply(path, frame(rows), KEYS, add, number, 8) == 0  # again: nothing to do
        assert files(path) == after
        assert {(r["user"], r["kind"]): r["n"] for r in keyed.read(spark, path).collect()} == total
    assert keyed.apply(path, frame([]), KEYS, add, 3, 8) == 0


def test_a_batch_that_failed_midway_goes_on(spark, tmp_path):
    """Buckets that the first attempt had replaced aren't changed again."""
    path = str(tmp_path / "usage")
    rows = spark.createDataFrame([(f"u{i}", "a", 1) for i in range(30)], "user string, kind string, n long")
    keyed.apply(path, rows, KEYS, add, 0, 4)
    done = rows.where(keyed.bucket(KEYS, 4) < 2)
    assert keyed.apply(path, done, KEYS, add, 1, 4) == 2
    assert keyed.apply(path, rows, KEYS, add, 1, 4) == 2
    assert {r["n"] for r in keyed.read(spark, path).collect()} == {2}


def test_stream_of_batches(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(3):
        spark.createDataFrame([("a", "x", i), ("b", "x", 1)], "user string, kind string, n long").write.mode("append").parquet(source)
    for _ in range(2):  # without its checkpoint a stream sends the same batches again
        stream = spark.readStream.schema("user string, kind string, n long").option("maxFilesPerTrigger", 1).parquet(source)
        stream.writeStream.foreachBatch(lambda df, n: keyed.apply(path, df.groupBy(*KEYS).agg(F.sum("n").alias("n")), KEYS, add, n, 4)).trigger(once=True).start().awaitTermination()
    assert {r["user"] for r in keyed.read(spark, path).collect()} == {"a", "b"}


def test_lines_round_trip(spark, tmp_path):
    path = str(tmp_path / "lines")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(4)
    for _ in range(2):  # the second time replaces the first
        lines.write_lines(events, path, chunk=100)
        got = list(lines.read_lines(path))
        assert got[0] == {"type": "meta", "total_rows": 1000} and got[-1] == {"type": "complete", "success": True}
        assert all(g["type"] == "data" and 0 < len(g["data"]) <= 100 for g in got[1:-1])
        rows = sorted((r for g in got[1:-1] for r in g["data"]), key=lambda r: r["event_id"])
        expected = [json.loads(r[0]) for r in events.orderBy("event_id").select(F.to_json(F.struct("*"))).collect()]
        assert rows == expected
    odd = spark.createDataFrame([(1, float("nan"), None), (2, float("inf"), 'a"\n')], "a int, b double, c string").coalesce(1)
    lines.write_lines(odd, path)
    assert list(lines.read_lines(path))[1]["data"] == [{"a": 1, "b": None, "c": None}, {"a": 2, "b": None, "c": 'a"\n'}]
    lines.write_lines(odd.limit(0), path)
    assert [g["type"] for g in lines.read_lines(path)] == ["meta", "complete"]


def test_a_failed_write_leaves_no_line(spark, tmp_path):
    path = str(tmp_path / "lines")
    bad = spark.range(0, 1000, 1, 4).select("id", F.when(F.col("id") == 700, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).cast("string").alias("v"))
    with pytest.raises(Exception, match="broken"):
        lines.write_lines(bad, path)
    assert not glob.glob(path + "/*.ndjson")
