"""Averaging levels against a plain version, and what they shuffle."""

import collections
import random
import re

from pyspark.sql import functions as F

from tidemark.operators import metrics


def test_averaged_levels_shuffle_no_level(spark):
    """Repeated and missing steps, missing values, a sample with many rows; blocks are made after the last shuffle."""
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, 3, 4, 4, 4, 4]), rng.choice("ab"), rng.randint(0, 9), rng.choice([None, 1.5, 2.0, 8.25]), rng.choice([None, 3.0, 0.5])) for _ in range(300)]
    df = spark.createDataFrame(rows, "sample_id long, feature string, step int, y_true double, y_pred double").repartition(3)
    blocks = collections.defaultdict(list)
    for s, f, step, y, p in rows:
        for level in range(1, 13):
            if step // level < 8 // level:
                blocks[s, f, level, step // level].append((y, p))
    mean = lambda values: round(sum(values) / len(values), 9) if (values := [v for v in values if v is not None]) else None
    wanted = {k: (mean([y for y, _ in v]), mean([p for _, p in v])) for k, v in blocks.items()}
    out = metrics.averaged_levels(df, 8)
    early = df.limit(1).select("sample_id", "feature", F.lit(-3).alias("step"), F.lit(7.0).alias("y_true"), F.lit(1.0).alias("y_pred"))
    assert metrics.averaged_levels(df.unionByName(early), 8).where("block < 0").count() == 12
    got = {tuple(r)[:4]: tuple(None if v is None else round(v, 9) for v in tuple(r)[4:]) for r in out.collect()}
    assert got == wanted
    for same in (df, df.withColumn("feature", F.lit("price"))):  # a constant isn't among the keys that Spark groups by
        plan = metrics.averaged_levels(same, 8)._jdf.queryExecution().executedPlan().toString()
        dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
        assert dealt and not any("level" in d for d in dealt)
