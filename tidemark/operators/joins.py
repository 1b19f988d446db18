"""Joins of series and of metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import KEY, numbered

#: Row positions that one task numbers.
STRETCH = 100_000


def pair_by_time(x: DataFrame, y: DataFrame, by: list[str] = ("ts",)) -> DataFrame:
    """(by, x, y): rows of y with the last x of the same key; rows of y that repeat a key all stay.

    Which side is broadcast, if any, is left to Spark, which knows the sizes.
    """
    last = x.groupBy(*by).agg(F.max_by("value", "row_pos").alias("x"))
    return y.select(*by, F.col("value").alias("y")).join(last, list(by))


def pair_by_row(x: DataFrame, y: DataFrame, by: str) -> DataFrame:
    """Rows paired by their places within a key (parity with files read side by side).

    Places are counted within stretches of STRETCH row positions, so rows of one key aren't one task's.
    """
    placed = lambda df, name: numbered(df.select(by, "row_pos", F.col("value").alias(name), F.floor(F.col("row_pos") / STRETCH).alias(KEY)), "n", ["row_pos"], by).select(by, "n", name)
    return placed(x, "x").join(placed(y, "y"), [by, "n"])


def align(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """All times of both, with the values of each where it has one."""
    return a.select(*by, F.col("value").alias("a")).join(b.select(*by, F.col("value").alias("b")), by, "full")


def without(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    return left.join(right, by, "left_anti")


def having(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    return left.join(right, by, "left_semi")


def flag(left: DataFrame, times: DataFrame, by: list[str], name: str = "flag") -> DataFrame:
    """Adds name: whether the key is among the times."""
    return left.join(times.select(*by).distinct().withColumn(name, F.lit(True)), by, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def file_pairs(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Each input series with each output series: tables of one row a file, so a product is meant."""
    return inputs.select(F.col("series_id").alias("input_id")).join(outputs.select(F.col("series_id").alias("output_id")))


def newest(df: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """The row with the largest order of each key; ties to the larger tie."""
    row = F.max_by(F.struct(*df.columns), F.struct(order, tie))
    return df.groupBy(key).agg(row.alias("_row")).select("_row.*")
