"""What a series is like: extent, step, offset, counts; one aggregate for all series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import bucketed, carried
from tidemark.operators.quantiles import quantiles


def series_info(series: DataFrame) -> DataFrame:
    """One row a series: first and last time, rows, values, their share, mean step in minutes, offset, extremes.

    ofst_is_var: the mean step doesn't divide an hour, so there is no offset.
    """
    span = F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))
    out = series.groupBy("series_id").agg(
        F.min("ts").alias("utc_min"),
        F.max("ts").alias("utc_max"),
        F.count("*").alias("n_all"),
        F.count("value").alias("n_num"),
        (F.count("value") / F.count("*") * 100).alias("rate_num"),
        (span / (F.count("*") - 1) / 6e7).alias("delt_min"),
        F.min("value").alias("val_min"),
        F.max("value").alias("val_max"),
    )
    rest = F.pmod(F.lit(60.0), F.col("delt_min"))
    first = F.minute("utc_min") + F.second("utc_min") / 60
    return out.withColumn("ofst_is_var", F.coalesce(rest != 0, F.lit(True))).withColumn("ofst_min", F.when(~F.col("ofst_is_var"), F.pmod(first, F.col("delt_min"))))


def gaps(series: DataFrame) -> DataFrame:
    """The series with gap_s: seconds since the row before, null for the first."""
    rows = carried(bucketed(series), "_before", F.col("ts"), ["ts", "row_pos"], own=False)
    return rows.withColumn("gap_s", (F.unix_micros("ts") - F.unix_micros("_before")) / 1e6).drop("_before", "_bucket")


def timestep(series: DataFrame) -> DataFrame:
    """(series_id, step_min, offset_min): median step in whole minutes, and the first minute modulo it."""
    mid = quantiles(gaps(series), "gap_s", [0.5], ["series_id"]).select("series_id", F.bround(F.col("q")[0] / 60, 0).alias("_step"))
    step = series.groupBy("series_id").agg(F.min("ts").alias("_first")).join(mid, "series_id", "left").withColumn("step_min", F.coalesce("_step", F.lit(0)).cast("int"))
    return step.select("series_id", "step_min", F.when(F.col("step_min") > 0, F.minute("_first") % F.col("step_min")).otherwise(0).alias("offset_min"))


def max_gap(series: DataFrame) -> DataFrame:
    return gaps(series).groupBy("series_id").agg((F.max("gap_s") / 60).alias("max_gap_min"))


def step_deviation(series: DataFrame) -> DataFrame:
    """(series_id, deviation): the largest difference of a step from the mean step, as a share of it."""
    g = gaps(series)
    mean = g.groupBy("series_id").agg(F.avg("gap_s").alias("mean"))
    return g.join(mean, "series_id").groupBy("series_id").agg(F.max(F.abs(F.col("gap_s") - F.col("mean")) / F.col("mean")).alias("deviation"))


def report(series: DataFrame) -> DataFrame:
    """Counts of rows, missing values, repeated times, and steps longer than twice the median."""
    g = gaps(series)
    mid = quantiles(g, "gap_s", [0.5], ["series_id"]).select("series_id", F.col("q")[0].alias("mid"))
    counts = g.join(mid, "series_id", "left").groupBy("series_id").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_missing"), F.count_if(F.col("gap_s") > 2 * F.col("mid")).alias("n_irregular")
    )
    times = series.groupBy("series_id", "ts").count().groupBy("series_id").agg(F.sum(F.col("count") - 1).alias("n_repeated"))
    return counts.join(times, "series_id")


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, standard deviation, extremes and exact quartiles of a column."""
    c = F.col(column)
    plain = df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    q = quantiles(df, column, [0.25, 0.5, 0.75])
    both = plain.crossJoin(q)  # one row each
    return both.select("n", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")


def resample(series: DataFrame, seconds: int, how: str) -> DataFrame:
    """(series_id, ts, value): mean, sum, max or min of each bin from the first to the last; an empty bin's sum is 0."""
    bins = series.withColumn("b", F.expr(f"unix_seconds(ts) - pmod(unix_seconds(ts), {seconds})"))
    value = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}[how]("value")
    got = bins.groupBy("series_id", "b").agg(value.alias("value"))
    every = bins.groupBy("series_id").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).select("series_id", F.explode(F.sequence("lo", "hi", F.lit(seconds).cast("long"))).alias("b"))
    out = every.join(got, ["series_id", "b"], "left")
    filled = F.coalesce("value", F.lit(0.0)) if how == "sum" else F.col("value")
    return out.select("series_id", F.timestamp_seconds("b").alias("ts"), filled.alias("value"))
