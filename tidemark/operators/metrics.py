"""Error metrics of predictions (sample_id, feature, step, y_true, y_pred), overall, by step and by averaging level."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import finite
from tidemark.operators.ordered import KEY, carried
from tidemark.operators.quantiles import quantiles

LEVELS = 12


def with_naive(df: DataFrame) -> DataFrame:
    """Adds naive: the difference from the value one row before in its feature, in the order of (sample, step, value)."""
    rows = carried(df.withColumn(KEY, F.floor(F.col("sample_id") / 1000)), "_before", F.col("y_true"), ["sample_id", "step", "y_true"], own=False, by="feature")
    return rows.withColumn("naive", F.col("y_true") - F.col("_before")).drop("_before", KEY)


def errors(y: str = "y_true", p: str = "y_pred") -> dict[str, Column]:
    """Aggregates: MAE, MSE, RMSE, MAPE (zeros left out, in percent), NRMSE, WAPE and sMAPE (in percent)."""
    y, p = F.col(y), F.col(p)
    e = y - p
    mse = F.avg(e * e)
    spread = F.max(y) - F.min(y)
    total, pair = F.sum(F.abs(y)), F.abs(y) + F.abs(p)
    return {
        "mae": F.avg(F.abs(e)),
        "mse": mse,
        "rmse": F.sqrt(mse),
        "mape": F.avg(F.when(y != 0, F.abs(e / y))) * 100,
        "nrmse": F.when(spread != 0, F.sqrt(mse) / spread),
        "wape": F.when(total != 0, F.sum(F.abs(e)) / total * 100),
        "smape": F.avg(F.when(pair != 0, 2 * F.abs(e) / pair)) * 100,
    }


def evaluate(df: DataFrame, by: list[str] = ("feature",), with_mase: bool = False) -> DataFrame:
    """One row a group with all metrics; MASE is null for a constant series of actual values."""
    by, named = list(by), errors()
    if with_mase:
        df = with_naive(df)
        scale = F.avg(F.abs("naive"))
        named["mase"] = F.when(scale != 0, F.avg(F.abs(F.col("y_true") - F.col("y_pred"))) / scale)
    return df.groupBy(*by).agg(*[c.alias(k) for k, c in named.items()])


def averaged_levels(df: DataFrame, n_steps: int, levels: int = LEVELS) -> DataFrame:
    """(sample_id, feature, level, block, y_true, y_pred): means of blocks of 1 to 12 steps; incomplete blocks go.

    Rows are dealt by sample before the levels are made, so each is shuffled once whatever the number of levels. A sample's
    rows pass through one task, one after the other; it has a row a step.
    """
    # a step beyond the last is in no complete block
    rows = df.where(F.col("step") < n_steps).select("sample_id", "feature", "step", "y_true", "y_pred").repartition("sample_id")
    out = rows.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels)))).withColumn("block", F.floor(F.col("step") / F.col("level")))
    out = out.where(F.col("block") < F.floor(F.lit(n_steps) / F.col("level")))
    return out.groupBy("sample_id", "feature", "level", "block").agg(F.avg("y_true").alias("y_true"), F.avg("y_pred").alias("y_pred"))


def best(df: DataFrame, by: list[str], metric: str = "metric", value: str = "value", model: str = "model") -> DataFrame:
    """The model with the smallest value of each metric; ties to the smaller name."""
    return df.groupBy(*by, metric).agg(F.min_by(model, F.struct(value, model)).alias("best_model"), F.min(value).alias("best_value"))


def residuals(df: DataFrame) -> DataFrame:
    return df.withColumn("residual", F.col("y_true") - F.col("y_pred"))


def distribution(df: DataFrame, by: str, value: str) -> DataFrame:
    """Exact quartiles and extremes of each group that has values."""
    q = quantiles(df, value, [0, 0.25, 0.5, 0.75, 1], [by])
    return q.select(by, *[F.col("q")[i].alias(name) for i, name in enumerate(["low", "q25", "q50", "q75", "high"])])


# The names of the error columns, by metric.
TABLE_NAMES = {"mae": "MAE", "mape": "MAPE", "mse": "MSE", "rmse": "RMSE", "nrmse": "NRMSE", "wape": "WAPE", "smape": "sMAPE", "mase": "MASE"}


def evaluation_table(levels: DataFrame, step_minutes: float) -> DataFrame:
    """(feature, delta_min, metric, value): one row a metric and averaging level, of evaluate() over averaged_levels()."""
    known = [k for k in TABLE_NAMES if k in levels.columns]
    pair = F.explode(F.array(*[F.struct(F.lit(TABLE_NAMES[k]).alias("metric"), F.col(k).alias("value")) for k in known]))
    return levels.select("feature", (F.col("level") * step_minutes).alias("delta_min"), pair.alias("_p")).select("feature", "delta_min", "_p.metric", "_p.value")


#: Points at which a density is given, cells that values are dealt to, and widths of the kernel beyond the extremes.
POINTS, CELLS, BEYOND = 100, 512, 2


def density(df: DataFrame, by: str, value: str, points: int = POINTS, cells: int = CELLS, beyond: float = BEYOND) -> DataFrame:
    """(by, point, x, density): a Gaussian kernel estimate of each group's values at equally spaced points.

    The width is Scott's: the standard deviation times n to the power of -1/5. Each value is dealt to the two cells of a
    fixed grid around it in one aggregate; the kernel then runs over the cells, so no group's values meet in one task. Null and
    non-finite values don't count; a group with fewer than two distinct values has no density.
    """
    rows = df.select(F.col(by).alias("_by"), finite(F.col(value).cast("double")).alias("_v")).where("_v is not null")
    stats = rows.groupBy("_by").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.stddev_samp("_v").alias("_sd")).where("_hi > _lo")
    stats = stats.withColumn("_w", F.col("_sd") * F.pow(F.col("_n"), F.lit(-0.2)))
    same = F.col("_by").eqNullSafe(F.col("_key"))
    keyed = stats.withColumnRenamed("_by", "_key")
    at = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (cells - 1)
    low = F.least(F.floor(at), F.lit(cells - 2))
    shares = F.array(F.struct(low.alias("cell"), (1 - (at - low)).alias("share")), F.struct((low + 1).alias("cell"), (at - low).alias("share")))
    dealt = rows.join(keyed, same).select("_by", F.explode(shares).alias("s")).groupBy("_by", F.col("s.cell").alias("cell")).agg(F.sum("s.share").alias("share")).where("share > 0")
    grid = keyed.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("_lo") - beyond * F.col("_w") + F.col("point") * (F.col("_hi") - F.col("_lo") + 2 * beyond * F.col("_w")) / (points - 1)
    z = (F.col("x") - F.col("_lo") - F.col("cell") * (F.col("_hi") - F.col("_lo")) / (cells - 1)) / F.col("_w")
    kernel = F.sum(F.col("share") * F.exp(-z * z / 2)) / (F.first("_n") * F.first("_w") * math.sqrt(2 * math.pi))
    return dealt.join(grid.withColumn("x", x), same).groupBy(F.col("_by").alias(by), "point", "x").agg(kernel.alias("density"))
