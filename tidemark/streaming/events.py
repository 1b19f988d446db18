"""Streaming variants: file streams, tumbling means with late data, sessions, upserts of results.

A stream's windows are half-open, unlike the closed ones of the batch regrid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema, files_per_trigger: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling_mean(series: DataFrame, step: str = "5 minutes", late: str = "1 hour", offset: str = "0 seconds") -> DataFrame:
    return series.withWatermark("ts", late).groupBy("series_id", F.window("ts", step, step, offset)).agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def sliding_mean(series: DataFrame, size: str, slide: str, late: str = "1 hour") -> DataFrame:
    return series.withWatermark("ts", late).groupBy("series_id", F.window("ts", size, slide)).agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def sessions(series: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return series.withWatermark("ts", late).groupBy("series_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Each micro-batch as Parquet in a folder of its own, so a repeated batch replaces itself."""

    def save(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(save)
