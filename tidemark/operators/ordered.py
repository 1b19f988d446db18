"""Neighbours in time, for series of any length.

A window over one series puts all its rows into one task. Here a window covers one time bucket of a series;
what crosses the bounds comes from a summary with one row for each bucket, joined on the key by which the
rows are dealt anyway. So a series that holds a third of all rows is still spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds in a bucket.
BUCKET = 7 * 86400
KEY = "_bucket"


def bucketed(df: DataFrame, seconds: int = BUCKET, ts: str = "ts") -> DataFrame:
    return df.withColumn(KEY, F.floor(F.unix_seconds(ts) / seconds))


def carried(df: DataFrame, name: str, what: Column, order: list[str], forward: bool = False, own: bool = True, by: str = "series_id") -> DataFrame:
    """Adds name: the last non-null `what` up to this row of its series (forward: the next from it on).

    df has a bucket; order are columns that put the rows of a series in order. own: the row itself counts.
    """
    keys = [by, KEY]
    direction = [F.col(c).desc() if forward else F.col(c).asc() for c in order]
    df = df.withColumn("_what", what)
    inside = F.last("_what", True).over(Window.partitionBy(*keys).orderBy(*direction).rowsBetween(Window.unboundedPreceding, 0 if own else -1))
    edge = (F.min_by if forward else F.max_by)("_what", F.when(F.col("_what").isNotNull(), F.struct(*order)))
    across = Window.partitionBy(by).orderBy(F.col(KEY).desc() if forward else F.col(KEY).asc()).rowsBetween(Window.unboundedPreceding, -1)
    edges = df.groupBy(*keys).agg(edge.alias("_edge")).select(*keys, F.last("_edge", True).over(across).alias("_edge"))
    return df.withColumn("_inside", inside).join(edges, keys).withColumn(name, F.coalesce("_inside", "_edge")).drop("_what", "_inside", "_edge")


def around(df: DataFrame, what: Column, order: list[str], by: str = "series_id") -> DataFrame:
    """Adds _p and _n: the last non-null `what` up to this row and the next from it on, as carried() both ways with one summary."""
    keys, first = [by, KEY], Window.unboundedPreceding
    df = df.withColumn("_what", what)
    inside = lambda way: F.last("_what", True).over(Window.partitionBy(*keys).orderBy(*[way(c) for c in order]).rowsBetween(first, 0))
    across = lambda name, way: F.last(name, True).over(Window.partitionBy(by).orderBy(way(KEY)).rowsBetween(first, -1)).alias(name)
    at = F.when(F.col("_what").isNotNull(), F.struct(*order))
    edges = df.groupBy(*keys).agg(F.max_by("_what", at).alias("_pe"), F.min_by("_what", at).alias("_ne")).select(*keys, across("_pe", F.asc), across("_ne", F.desc))
    df = df.withColumns({"_pi": inside(F.asc), "_ni": inside(F.desc)}).join(edges, keys)
    return df.withColumns({"_p": F.coalesce("_pi", "_pe"), "_n": F.coalesce("_ni", "_ne")}).drop("_what", "_pi", "_ni", "_pe", "_ne")


def running(df: DataFrame, name: str, what: Column, order: list[str], by: str = "series_id") -> DataFrame:
    """Adds name: the sum of `what` over the rows of its series up to this one."""
    keys = [by, KEY]
    df = df.withColumn("_what", what)
    inside = F.sum("_what").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    across = Window.partitionBy(by).orderBy(KEY).rowsBetween(Window.unboundedPreceding, -1)
    edges = df.groupBy(*keys).agg(F.sum("_what").alias("_edge")).select(*keys, F.coalesce(F.sum("_edge").over(across), F.lit(0)).alias("_edge"))
    return df.withColumn("_inside", inside).join(edges, keys).withColumn(name, F.coalesce("_inside", F.lit(0)) + F.col("_edge")).drop("_what", "_inside", "_edge")


def numbered(df: DataFrame, name: str, order: list[str], by: str = "series_id") -> DataFrame:
    """Adds name: the row's place in its series, from 1."""
    return running(df, name, F.lit(1), order, by)


def asof(left: DataFrame, right: DataFrame, ts: str = "ts", value: str = "value", by: str = "series_id", seconds: int = BUCKET) -> DataFrame:
    """left with prior and next: struct(ts, value) of the right rows nearest before and after, exact hits on both sides.

    Rows of right with a null value count: they are barriers where the caller doesn't filter them. Of rows at
    one time the one with the smallest row_pos counts.
    """
    extra = [c for c in left.columns if c not in (by, ts)]
    first = right.groupBy(by, ts).agg(F.min_by(value, "row_pos").alias(value))
    rows = first.select(by, F.col(ts), F.struct(F.col(ts).alias("ts"), F.col(value).alias("value")).alias("_point"), F.lit(0).alias("_tag"), F.lit(None).cast(left.select(F.struct(by, *extra)).schema[0].dataType).alias("_row"))
    asked = left.select(by, F.col(ts), F.lit(None).cast(rows.schema["_point"].dataType).alias("_point"), F.lit(1).alias("_tag"), F.struct(by, *extra).alias("_row"))
    both = bucketed(rows.unionByName(asked), seconds, ts).withColumn("_back", -F.col("_tag"))
    both = carried(both, "prior", F.col("_point"), [ts, "_tag"], by=by)
    both = carried(both, "next", F.col("_point"), [ts, "_back"], forward=True, by=by)
    return both.where("_tag = 1").select(by, F.col(ts), *[F.col(f"_row.{c}").alias(c) for c in extra], "prior", "next")
