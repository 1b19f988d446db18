"""Cutting lineage between steps of a long chain."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the folder that spark.checkpoint.dir names; a local master without one gets a temporary one.

    Operators that look at a row's neighbours read their input twice, so a chain of them grows as a power of two
    unless it is cut.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(at or tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint()


def _folder(spark) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/tidemark"


def shared_path(spark, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as a columnar table in the shared folder and read again; dropped() deletes it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by stored() that no later plan reads."""
    for t in tables:
        for d in {f.rpartition("/")[0] for f in t.inputFiles()}:
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(d)
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
