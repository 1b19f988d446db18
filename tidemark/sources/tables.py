"""Parquet tables as series, samples and accounts.

A series is long-form: (series_id string, ts timestamp, value double, row_pos long), a missing value being null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_series(df: DataFrame, series_id: str, ts: str, value: str, row_pos: str) -> DataFrame:
    """Rename and cast to the series schema; NaN becomes null, for Spark's aggregates don't skip it."""
    v = F.col(value).cast("double")
    return df.select(F.col(series_id).cast("string").alias("series_id"), F.col(ts).cast("timestamp").alias("ts"), F.when(~F.isnan(v), v).alias("value"), F.col(row_pos).cast("long").alias("row_pos"))


def event_series(spark: SparkSession, sf_dir: str, missing_every: int | None = None) -> DataFrame:
    """The event stream as one series for each event type; every so-manyth value made missing."""
    out = as_series(table(spark, sf_dir, "events"), "event_type", "ts", "value", "event_id")
    return out if missing_every is None else out.withColumn("value", F.when(F.col("row_pos") % missing_every != 0, F.col("value")))


def epoch_us(ts: str | Column) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def epoch_s(ts: str) -> Column:
    """Whole seconds since the epoch; the fraction is cut off."""
    return F.unix_seconds(ts)


def timestamp_of(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)
