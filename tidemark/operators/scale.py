"""Min-max scaling with parameters as a small table, and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import bucketed, numbered
from tidemark.operators.setops import shuffled


def fit(df: DataFrame, feature: str = "feature", value: str = "value", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(feature, data_min, data_max, out_min, out_max); bounds in the wrong order are swapped, equal ones are 0 and 1."""
    low, high = (0.0, 1.0) if low == high else sorted((low, high))
    return df.groupBy(feature).agg(F.min(value).alias("data_min"), F.max(value).alias("data_max")).withColumns({"out_min": F.lit(low), "out_max": F.lit(high)})


def _width():
    spread = F.col("data_max") - F.col("data_min")
    return F.when(spread == 0, 1.0).otherwise(spread)


def transform(df: DataFrame, scaler: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """value scaled; a constant feature maps to the lower bound. The scaler has a row a feature."""
    scaled = (F.col(value) - F.col("data_min")) / _width() * (F.col("out_max") - F.col("out_min")) + F.col("out_min")
    return df.join(scaler, feature).withColumn(value, scaled).select(df.columns)


def inverse(df: DataFrame, scaler: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    back = (F.col(value) - F.col("out_min")) / (F.col("out_max") - F.col("out_min")) * _width() + F.col("data_min")
    return df.join(scaler, feature).withColumn(value, back).select(df.columns)


def range_report(df: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    return df.groupBy(feature).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))


def split_in_order(series: DataFrame, train: float = 0.7, validate: float = 0.2) -> DataFrame:
    """Adds split by the row's place in its series: bounds are the shares of the rows, rounded half to even."""
    rows = numbered(bucketed(series), "_i", ["ts", "row_pos"])
    sizes = series.groupBy("series_id").agg(F.count("*").alias("_n"))
    a = F.bround(F.col("_n") * F.lit(train), 0)
    b = a + F.bround(F.col("_n") * F.lit(validate), 0)
    split = F.when(F.col("_i") <= a, "train").when(F.col("_i") <= b, "val").otherwise("test")
    return rows.join(sizes, "series_id").withColumn("split", split).select(*series.columns, "split")


def split_by_hash(df: DataFrame, key: str, train: float = 0.7, validate: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds split at random, but the same at every run: by a hash of seed and key."""
    u = F.substring(shuffled(key, seed), 1, 7)
    bound = lambda share: F.lit(f"{round(share * 16**7):07x}" if share < 1 else "g")
    return df.withColumn("split", F.when(u < bound(train), "train").when(u < bound(train + validate), "val").otherwise("test"))


def scale_rows(files: DataFrame, calendar: dict[str, tuple[bool, bool, float, float]]) -> DataFrame:
    """(place, feature, scaled, high, low) of all input columns: the files' own, then those of the calendar.

    files: (place, feature, scaled, high, low); calendar: by component (Y, M, W, D, H) whether it is used and scaled,
    and its bounds; each has two rows.
    """
    spark, n = files.sparkSession, files.agg(F.max("place")).first()[0] or 0
    used = [(f"{k}_{part}", *calendar[k][1:]) for k in ("Y", "M", "W", "D", "H") if calendar.get(k, (False,))[0] for part in ("sin", "cos")]
    rows = [(n + 1 + i, name, scaled, float(high), float(low)) for i, (name, scaled, high, low) in enumerate(used)]
    own = files.select(F.col("place").cast("int"), "feature", "scaled", F.col("high").cast("double"), F.col("low").cast("double"))
    return own.unionAll(spark.createDataFrame(rows, "place int, feature string, scaled boolean, high double, low double"))


def feature_names(files: list[str], calendar: set[str]) -> list[str]:
    """Names of the input columns in order: the files, then sine and cosine of each component used, H alone."""
    return [*files, *(f"{k}_{part}" for k in ("Y", "M", "W", "D") if k in calendar for part in ("sin", "cos")), *(["H"] if "H" in calendar else [])]
