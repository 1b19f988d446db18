"""Exact quantiles against Spark's own percentile, on values of every kind."""

import random

from pyspark.sql import functions as F

from tidemark.operators.quantiles import quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def test_quantiles_are_those_of_percentile(spark):
    rng = random.Random(4)
    rows = [("a", rng.gauss(0, 1)) for _ in range(1001)] + [("b", 1e6 + rng.random()) for _ in range(500)] + [("c", float(rng.randint(-3, 3))) for _ in range(300)]
    rows += [("d", 5.0), ("e", None), (None, 1.0), (None, 4.0), ("f", -1e-300), ("f", 1e300), ("f", 0.0), ("g", None), ("g", 2.0), ("h", float("-inf")), ("h", 1.0), ("h", float("inf"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r["q"] for r in quantiles(df, "v", PROBS, ["g"]).collect()}
    want = {r["g"]: r["q"] for r in df.where("v is not null").groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, PROBS))).alias("q")).collect()}
    assert got.keys() == want.keys()
    assert all(str(got[g]) == str(want[g]) for g in want if g != "h")
    assert [got["h"][i] for i in (0, 3, 6)] == [float("-inf"), 1.0, float("inf")]


def test_quantiles_of_a_whole_table(spark):
    df = spark.range(10).select(F.col("id").alias("q"))
    assert quantiles(df, "q", [0.5, 1]).first()["q"] == [4.5, 9.0]
    assert quantiles(df.limit(0), "q", [0.5]).first()["q"] == [None]
    nan = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,)], "v double")
    assert str(quantiles(nan, "v", [0, 0.5, 1]).first()["q"]) == "[1.0, 2.0, nan]"
