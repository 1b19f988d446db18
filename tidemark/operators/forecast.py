"""Assembling the inputs of a forecast and its output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import asof
from tidemark.operators.scale import inverse, transform
from tidemark.operators.windows import Horizon, samples


def reference_time(series: DataFrame, now: Column | None = None) -> DataFrame:
    """(utc_ref): the smallest of the series' last known times, not after now."""
    last = series.where("value is not null").groupBy("series_id").agg(F.max("ts").alias("last")).agg(F.min("last").alias("utc_ref"))
    return last if now is None else last.select(F.least("utc_ref", now).alias("utc_ref"))


def at_times(series: DataFrame, times: DataFrame) -> DataFrame:
    """(series_id, ts, value): time-weighted values at other times; missing outside the known ones."""
    # each time meets the array of all series, one row a series of metadata: no product of two large tables
    ids = series.select("series_id").distinct().agg(F.collect_list("series_id").alias("_ids"))
    near = asof(times.select("ts").join(F.broadcast(ids)).select("ts", F.explode("_ids").alias("series_id")), series.where("value is not null"))
    p, n = F.col("prior.value"), F.col("next.value")
    tp, tn, t = F.unix_micros("prior.ts"), F.unix_micros("next.ts"), F.unix_micros("ts")
    return near.select("series_id", "ts", F.when(tp == tn, p).otherwise(p + (n - p) * ((t - tp) / (tn - tp))).alias("value"))


def inputs(series: DataFrame, horizons: list[Horizon], now: Column | None = None) -> DataFrame:
    """The one sample at the reference time; empty if a value is missing."""
    from tidemark.operators.windows import long_windows

    return samples(long_windows(series, reference_time(series, now), horizons), horizons)


def output(predictions: DataFrame, start_h: float, step_minutes: float) -> DataFrame:
    """(utc, value) of predictions (utc_ref, step, y_pred), to four decimals."""
    at = F.unix_micros("utc_ref") + F.lit(int(start_h * 3.6e9)) + F.col("step") * int(step_minutes * 6e7)
    return predictions.select(F.timestamp_micros(at).alias("utc"), F.bround("y_pred", 4).alias("value"))


def run(inputs: DataFrame, model, features: list[str], scaler: DataFrame, start_h: float, step_minutes: float, feature: str) -> DataFrame:
    """(utc, value): the forecast of one output from scaled samples (utc_ref, step, features...).

    The model's predictions are brought back to the output's own units before they are rounded.
    """
    made = model.predict(inputs).select("utc_ref", "step", F.lit(feature).alias("feature"), "y_pred")
    return output(inverse(made, scaler, value="y_pred"), start_h, step_minutes)


def predicted(samples: DataFrame, model, scaler_in: DataFrame, scaler_out: DataFrame, features: list[str], feature: str) -> DataFrame:
    """(sample_id, step, y_pred): rows of raw features scaled, predicted and scaled back, for a model fitted on scaled ones."""
    for name in features:
        samples = transform(samples.withColumn("_feature", F.lit(name)), scaler_in.withColumnRenamed("feature", "_feature"), "_feature", name).drop("_feature")
    made = model.predict(samples).select("sample_id", "step", F.lit(feature).alias("feature"), "y_pred")
    return inverse(made, scaler_out, value="y_pred").drop("feature")
