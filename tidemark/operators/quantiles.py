"""Exact quantiles of groups of any size.

percentile and median hold every distinct value of a group in one task's map. Here values are counted first;
a place is a narrow range of values, and a summary with one row for each place tells which of them hold the
wanted ranks. Only these few are sorted, by a window that can spill.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Places in each doubling of a value.
STEPS = 64


def quantiles(df: DataFrame, column: str, probs: list[float], by: list[str] = ()) -> DataFrame:
    """(*by, q): an array of the quantiles in the order of probs, linear between two ranks.

    Null values don't count, NaN is the greatest. A group without values gives no row; without groups there is always one.
    """
    by = list(by)
    # 2^-1074 is the smallest number, so that all places of positive numbers are above that of zero
    size = F.coalesce(F.floor((F.log2(F.abs("_v")) + 1100) * STEPS), F.lit(0))
    place = F.when(F.isnan("_v"), F.lit(float("inf"))).otherwise(F.signum("_v") * size)
    values = df.select(*by, F.col(column).cast("double").alias("_v")).where("_v is not null")
    counted = values.groupBy(*by, "_v").agg(F.count("*").alias("_c")).withColumn("_place", place)

    group = Window.partitionBy(*by)
    places = counted.groupBy(*by, "_place").agg(F.sum("_c").alias("_in"))
    places = places.select(*by, "_place", "_in", (F.sum("_in").over(group.orderBy("_place")) - F.col("_in")).alias("_before"), F.sum("_in").over(group).alias("_n"))
    at = [F.lit(p) * (F.col("_n") - 1) for p in probs]
    ranks = [F.struct(F.lit(2 * i + j).alias("i"), rank(x).alias("rank")) for i, x in enumerate(at) for j, rank in enumerate((F.floor, F.ceil))]
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    wanted = places.select(*keys, F.col("_place").alias("_k"), "_in", "_before", "_n", F.explode(F.array(*ranks)).alias("_r")).where("_r.rank >= _before and _r.rank < _before + _in")

    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)], F.col("_place") == F.col("_k"))
    inside = counted.join(wanted, same).select(*by, "_v", "_c", "_before", "_n", F.col("_r.i").alias("_i"), F.col("_r.rank").alias("_rank"))
    through = F.col("_before") + F.sum("_c").over(Window.partitionBy(*by, "_i").orderBy("_v"))
    reached = inside.withColumn("_through", through).where("_through > _rank")
    found = reached.groupBy(*by).agg(F.max("_n").alias("_n"), *[F.min(F.when(F.col("_i") == i, F.col("_v"))).alias(f"_{i}") for i in range(2 * len(probs))])

    def between(i: int):
        low, high, x = F.col(f"_{2 * i}"), F.col(f"_{2 * i + 1}"), at[i]
        return F.when(low == high, low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high)

    return found.select(*by, F.array(*[between(i) for i in range(len(probs))]).alias("q"))
