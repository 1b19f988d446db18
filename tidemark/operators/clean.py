"""Cleaning: ranges, zeros, constant and short runs, slopes, gap filling, outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import round_even
from tidemark.operators.ordered import around, bucketed, carried, numbered, running
from tidemark.operators.quantiles import quantiles

ORDER = ["ts", "row_pos"]


def time_range(series: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Rows between start and end, both included; all rows unless both are given."""
    if start is None or end is None:
        return series
    return series.where(F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def clip_range(series: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Values above high or below low become missing."""
    out = F.lit(False)
    if high is not None:
        out = out | (F.col("value") > high)
    if low is not None:
        out = out | (F.col("value") < low)
    return series.withColumn("value", F.when(~out, F.col("value")))


def drop_zeros(series: DataFrame) -> DataFrame:
    return series.withColumn("value", F.nullif(F.col("value"), F.lit(0.0)))


def slope(series: DataFrame) -> DataFrame:
    """Adds slope: change of the value in a minute since the row before; null if either is missing."""
    rows = carried(bucketed(series), "_p", F.struct("ts", "value"), ORDER, own=False)
    minutes = (F.unix_micros("ts") - F.unix_micros("_p.ts")) / 6e7
    return rows.withColumn("slope", F.when(minutes != 0, (F.col("value") - F.col("_p.value")) / minutes)).drop("_p", "_bucket")


def fill_gaps(series: DataFrame, max_minutes: float | None, digits: int | None = None) -> DataFrame:
    """Missing values between two known ones at most so far apart, on the line between them; the ends stay, and what lies between equal times."""
    if max_minutes is None:
        return series
    known = F.when(F.col("value").isNotNull(), F.struct("ts", "value"))
    rows = around(bucketed(series), known, ORDER)
    t, tp, tn = F.unix_micros("ts"), F.unix_micros("_p.ts"), F.unix_micros("_n.ts")
    gap = tn - tp
    # between two known values at one time there is no line
    line = F.col("_p.value") + (t - tp) / 6e7 * ((F.col("_n.value") - F.col("_p.value")) / F.nullif(gap / 6e7, F.lit(0.0)))
    value = F.when(F.col("value").isNotNull(), F.col("value")).when(gap <= max_minutes * 6e7, round_even(line, digits))
    return rows.withColumn("value", value).drop("_p", "_n", "_bucket")


def _runs(series: DataFrame, breaks) -> DataFrame:
    """Adds _run: numbers runs of rows; a row with a true break starts one."""
    return running(series, "_run", breaks.cast("long"), ORDER)


def drop_constant_runs(series: DataFrame, min_minutes: float | None) -> DataFrame:
    """Runs of one repeated value become missing if they last so long or longer; a missing value ends a run."""
    if min_minutes is None:
        return series
    rows = carried(bucketed(series), "_p", F.struct("value"), ORDER, own=False)
    rows = _runs(rows, ~F.coalesce(F.col("value") == F.col("_p.value"), F.lit(False)))
    long = rows.where("value is not null").groupBy("series_id", "_run").agg(F.count("*").alias("n"), (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("w"))
    long = long.where((F.col("n") >= 2) & (F.col("w") >= min_minutes * 6e7)).select("series_id", "_run", F.lit(True).alias("_long"))
    out = rows.join(long, ["series_id", "_run"], "left")
    return out.withColumn("value", F.when(F.col("_long").isNull(), F.col("value"))).select(series.columns)


def drop_short_runs(series: DataFrame, min_minutes: float | None) -> DataFrame:
    """Runs of known values shorter than that become missing; one that lasts to the series' end stays."""
    if min_minutes is None:
        return series
    rows = carried(bucketed(series), "_p", F.struct("value"), ORDER, own=False)
    known, before = F.col("value").isNotNull(), F.col("_p.value").isNotNull()
    rows = _runs(rows, F.col("_p").isNull() | (known != before))
    last = series.groupBy("series_id").agg(F.max_by(F.col("value").isNotNull(), F.struct(*ORDER)).alias("open"), F.max(F.struct(*ORDER)).alias("end"))
    runs = rows.where("value is not null").groupBy("series_id", "_run").agg((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("w"), F.max(F.struct(*ORDER)).alias("stop"))
    short = runs.join(last, "series_id").where((F.col("w") < min_minutes * 6e7) & (F.col("stop") != F.col("end"))).select("series_id", "_run", F.lit(True).alias("_short"))
    out = rows.join(short, ["series_id", "_run"], "left")
    return out.withColumn("value", F.when(F.col("_short").isNull(), F.col("value"))).select(series.columns)


def fill_linear_rows(series: DataFrame, limit: int | None = None, trailing: bool = True) -> DataFrame:
    """Missing values on the line over row places; after the last known value that value stays (trailing).

    limit: only so many rows at the start of each gap.
    """
    rows = numbered(bucketed(series), "_i", ORDER)
    known = F.when(F.col("value").isNotNull(), F.struct(F.col("_i").alias("i"), F.col("value").alias("v")))
    rows = around(rows, known, ORDER)
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * (F.col("_i") - F.col("_p.i")) / (F.col("_n.i") - F.col("_p.i"))
    value = F.when(F.col("value").isNotNull(), F.col("value")).when(F.col("_n").isNotNull(), line)
    if trailing:
        value = value.otherwise(F.col("_p.v"))
    if limit is not None:
        value = F.when(F.col("_i") - F.col("_p.i") <= limit, value)
    return rows.withColumn("value", value).select(series.columns)


def iqr_bounds(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """One row (low, high) from the exact quartiles."""
    q = quantiles(df, column, [0.25, 0.75])
    return q.select((F.col("q")[0] - factor * (F.col("q")[1] - F.col("q")[0])).alias("low"), (F.col("q")[1] + factor * (F.col("q")[1] - F.col("q")[0])).alias("high"))


def drop_outliers(df: DataFrame, columns: list[str], factor: float = 1.5) -> DataFrame:
    """Rows within the quartile fences of each column, one column after the other; the fences are two numbers."""
    for c in columns:
        low, high = iqr_bounds(df, c, factor).first()
        df = df.where(F.col(c).between(low, high))
    return df


def flag_outliers(df: DataFrame, column: str, how: str = "iqr", limit: float = 1.5) -> DataFrame:
    """Adds outlier: outside the quartile fences, or further than limit standard deviations from the mean."""
    if how == "iqr":
        low, high = iqr_bounds(df, column, limit).first()
        return df.withColumn("outlier", (F.col(column) < low) | (F.col(column) > high))
    mean, std = df.agg(F.avg(column), F.stddev_samp(column)).first()
    return df.withColumn("outlier", F.abs((F.col(column) - mean) / std) > limit)
