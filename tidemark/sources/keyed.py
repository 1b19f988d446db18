"""Stored tables that are changed by key, in batches that can be repeated.

A table is a folder of Parquet files, one part for each bucket of its keys. A batch reads and replaces the buckets of its own keys
alone (dynamic partition overwrite); files of other buckets stay as they are. Every bucket carries the number of the last
batch that changed it, so a batch that is applied again, whole or after a failure midway, changes only buckets that it
hadn't reached. Numbers must grow, as those of a stream's micro-batches do; one writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.lineage import dropped, stored

BUCKET, BATCH = "_bucket", "_batch"


def bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows, without the columns that the table keeps for itself."""
    return spark.read.parquet(path).drop(BUCKET, BATCH)


def apply(path: str, batch: DataFrame, keys: list[str], how: Callable[[DataFrame, DataFrame], DataFrame], number: int, buckets: int = 64) -> int:
    """Change the table at path (made if it isn't there) to how(old rows, batch); the number of buckets that were written.

    how may add or change rows of the batch's keys only, as setops' upserts do. buckets: the same for each batch of a table.
    """
    spark = batch.sparkSession
    new = stored(batch.withColumn(BUCKET, bucket(keys, buckets)), "batch")
    touched = {r[0] for r in new.select(BUCKET).distinct().collect()}  # at most so many as there are buckets
    known = spark.read.schema(new.schema.add(BATCH, "long")).parquet(path) if _exists(spark, path) else spark.createDataFrame([], new.schema.add(BATCH, "long"))
    mine = known.where(F.col(BUCKET).isin(sorted(touched)))  # a filter on partitions: other files aren't read
    done = {r[0] for r in mine.groupBy(BUCKET).agg(F.max(BATCH).alias("n")).where(F.col("n") >= number).collect()}
    todo = sorted(touched - done)
    if todo:
        inside = F.col(BUCKET).isin(todo)
        old = mine.where(inside).select(*batch.columns)
        merged = how(old, new.where(inside).select(*batch.columns)).withColumn(BUCKET, bucket(keys, buckets)).withColumn(BATCH, F.lit(number).cast("long"))
        ready = stored(merged.repartition(BUCKET), "merged")  # what is read is complete before anything is replaced
        ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
        dropped(ready)
    dropped(new)
    return len(todo)
