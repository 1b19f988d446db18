"""Regridding: values of an irregular series on an equidistant grid, by six methods.

Window methods don't join on ranges: each point knows by arithmetic the one or two grid points in whose
closed window of half a step it lies, and the rest is an aggregate and an equi-join. Methods that look at
both neighbours use the as-of union. Times are compared in whole seconds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import ceil_div, floor_div, round_even
from tidemark.operators.grid import bounds, checked_step, grid, starts
from tidemark.operators.ordered import asof

METHODS = ("none", "mean", "intrpl", "nearest", "nearest (mean)", "nearest (max. delta)")


@dataclass(frozen=True)
class RegridSpec:
    """step, offset and max_gap in minutes; start and end limit the grid; an anchor replaces the offset.

    exact_hit: "value" takes a value that lies on the grid as it is; "gap" lets the gap before it decide.
    """

    method: str
    step: float
    offset: float = 0
    max_gap: float = 60
    digits: int | None = None
    anchor: str | None = None
    start: str | None = None
    end: str | None = None
    exact_hit: str = "value"


def first_per_time(series: DataFrame) -> DataFrame:
    """One row for each time of a series: the one that comes first in the input."""
    row = F.min_by(F.struct("value", "row_pos"), "row_pos")
    return series.groupBy("series_id", "ts").agg(row.alias("_row")).select("series_id", "ts", "_row.value", "_row.row_pos")


def _limits(series: DataFrame, spec: RegridSpec) -> DataFrame:
    limits = bounds(series)
    if spec.start is not None:
        limits = limits.withColumn("t_min", F.unix_seconds(F.lit(spec.start).cast("timestamp")))
    if spec.end is not None:
        limits = limits.withColumn("t_max", F.unix_seconds(F.lit(spec.end).cast("timestamp")))
    return limits


def time_grid(series: DataFrame, spec: RegridSpec) -> DataFrame:
    return grid(_limits(series, spec), spec.step, spec.offset, spec.anchor)


def _in_windows(series: DataFrame, spec: RegridSpec) -> DataFrame:
    step = checked_step(spec.step)
    half = int(spec.step * 30)
    first = starts(_limits(series, spec), spec.step, spec.offset, spec.anchor).select("series_id", "t0")
    known = first_per_time(series.where("value is not null"))
    return (
        known.join(first, "series_id")
        .withColumn("t", F.unix_seconds("ts"))
        .withColumn("k", F.explode(F.sequence(ceil_div(f"t - t0 - {half}", step), floor_div(f"t - t0 + {half}", step), F.lit(1).cast("long"))))
        .where(F.col("k") * step + F.col("t0") >= F.col("t") - half)
        .withColumn("delta", F.abs(F.col("t") - F.col("t0") - F.col("k") * step))
    )


def _windowed(series: DataFrame, points: DataFrame, spec: RegridSpec) -> DataFrame:
    rows = _in_windows(series, spec)
    if spec.method == "mean":
        best = rows.groupBy("series_id", "k").agg(F.avg("value").alias("value"))
    elif spec.method == "nearest":
        best = rows.groupBy("series_id", "k").agg(F.min_by("value", F.struct("delta", "ts")).alias("value"))
    else:
        means = rows.groupBy("series_id", "k", "delta").agg(F.avg("value").alias("value"))
        best = means.groupBy("series_id", "k").agg(F.min_by("value", "delta").alias("value"))
    return points.join(best, ["series_id", "k"], "left")


def _between(series: DataFrame, points: DataFrame, spec: RegridSpec) -> DataFrame:
    known = first_per_time(series.where("value is not null").withColumn("ts", F.date_trunc("second", "ts")))
    near = asof(points.withColumn("ts", F.timestamp_seconds("g")), known)
    p, n = F.col("prior.value"), F.col("next.value")
    tp, tn, g, most = F.unix_seconds("prior.ts"), F.unix_seconds("next.ts"), F.col("g"), spec.max_gap * 60
    if spec.method == "intrpl":
        value = p + (n - p) / (tn - tp) * (g - tp)
    else:
        value = F.when(g - tp < tn - g, p).otherwise(n)
    inside = F.when(tn - tp <= most, value)
    if spec.exact_hit == "value":
        inside = F.when(tn == tp, p).otherwise(inside)
    return near.withColumn("value", F.when(p.isNotNull() & n.isNotNull(), inside))


def regrid(series: DataFrame, spec: RegridSpec) -> DataFrame:
    """(series_id, ts, value) on the grid of each series; missing where the method finds nothing.

    An unknown method gives the series as it is, one row for each time.
    """
    if spec.method not in METHODS:
        return first_per_time(series).select("series_id", "ts", "value")
    points = time_grid(series, spec)
    if spec.method == "none":
        out = points.withColumn("value", F.lit(None).cast("double"))
    elif spec.method in ("mean", "nearest", "nearest (mean)"):
        out = _windowed(series, points, spec)
    else:
        out = _between(series, points, spec)
    return out.select("series_id", F.timestamp_seconds("g").alias("ts"), round_even(F.col("value"), spec.digits).alias("value"))
