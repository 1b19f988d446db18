"""Equidistant time grids, by closed forms in whole seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import ceil_div, floor_div

# The bounds of a step in minutes, and of a grid in points.
MIN_STEP, MAX_STEP, MAX_POINTS = 1 / 60, 1440, 5_000_000


def checked_step(minutes: float) -> int:
    """The step in whole seconds; ValueError outside one second to one day."""
    if isinstance(minutes, bool) or not isinstance(minutes, int | float) or not MIN_STEP <= minutes <= MAX_STEP:
        raise ValueError(f"a time step lies between {MIN_STEP} and {MAX_STEP} minutes, not {minutes!r}")
    if abs(minutes * 60 - round(minutes * 60)) > 1e-6:
        raise ValueError("a time step is a whole number of seconds")
    return round(minutes * 60)


def hour_start(start: str, step: int, offset: int) -> Column:
    """The first time at or after start among floor-to-hour + offset + n * step; all in seconds."""
    base = f"({start} - pmod({start}, 3600) + {offset})"
    return F.expr(base) + ceil_div(f"greatest({start} - {base}, 0L)", step) * step


def anchor_start(anchor: str, start: str, step: int) -> Column:
    """The grid point nearest to start on a grid through the anchor: at or after it, or, for an anchor
    before the start, at or before it."""
    later = F.expr(anchor) - floor_div(f"({anchor} - {start})", step) * step
    earlier = F.expr(anchor) + floor_div(f"({start} - {anchor})", step) * step
    return F.when(F.expr(f"{anchor} >= {start}"), later).otherwise(earlier)


def bounds(series: DataFrame) -> DataFrame:
    """(series_id, t_min, t_max) in whole seconds; t_max rounded up to hold its fraction."""
    return series.groupBy("series_id").agg(F.unix_seconds(F.min("ts")).alias("t_min"), F.unix_seconds(F.max("ts")).alias("t_max"))


def starts(limits: DataFrame, step_minutes: float, offset_minutes: float = 0, anchor: str | None = None) -> DataFrame:
    """Adds t0 to the limits (series_id, t_min, t_max): the first point of each series' grid.

    offset: minutes after the full hour, taken modulo the step; anchor: a time that lies on the grid instead.
    """
    step = checked_step(step_minutes)
    offset = round(offset_minutes * 60) % step if offset_minutes > 0 else 0
    if anchor is None:
        start = hour_start("t_min", step, offset)
    else:
        at = F.unix_seconds(F.lit(anchor).cast("timestamp"))
        limits = limits.withColumn("_anchor", at)
        start = anchor_start("_anchor", "t_min", step)
    return limits.withColumn("t0", start)


def grid(limits: DataFrame, step_minutes: float, offset_minutes: float = 0, anchor: str | None = None) -> DataFrame:
    """(series_id, k, g, t0): the grid points of each series between its limits (series_id, t_min, t_max), as starts() sets them.

    Points come from ranges of at most MAX_POINTS, which is checked where the plan runs.
    """
    step = checked_step(step_minutes)
    out = starts(limits, step_minutes, offset_minutes, anchor).withColumn("_n", floor_div("t_max - t0", step) + 1)
    out = out.withColumn("_n", F.when(F.col("_n") <= MAX_POINTS, F.col("_n")).otherwise(F.raise_error(F.lit("the time grid is too large"))))
    # chunks of 4096 points first, so that no row holds a whole grid
    chunk = F.explode(F.expr("sequence(0L, (_n - 1) div 4096)"))
    out = out.where("_n > 0").withColumn("_c", chunk)
    k = F.explode(F.expr("sequence(_c * 4096, least(_n - 1, _c * 4096 + 4095))"))
    return out.withColumn("k", k).select("series_id", "k", (F.col("t0") + F.col("k") * step).alias("g"), "t0")
