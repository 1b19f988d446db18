"""Tolerance regression of two series: one aggregate fits, a projection scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import finite

# What divides a given constant tolerance, the share of the range below which it is too small,
# and the share of the range, or of the prediction, that is taken instead.
HALVED, LEAST_SHARE, DEFAULT_SHARE = 2, 0.01, 0.1


def usable(pairs: DataFrame) -> DataFrame:
    """Pairs (x, y) of finite numbers."""
    return pairs.withColumns({"x": finite(F.col("x")), "y": finite(F.col("y"))}).where("x is not null and y is not null")


def extent(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.count("*").alias("n"))


def tolerance(constant: float | None, relative: float | None, spread: float) -> tuple[float, float]:
    """(constant, relative) as they are applied: half of the constant, unless that is too small for the range."""
    half = (constant or 0) / HALVED
    return (half if half > 0 and half >= LEAST_SHARE * spread else DEFAULT_SHARE * spread), (relative if relative and relative > 0 else DEFAULT_SHARE)


def fit_linear(pairs: DataFrame) -> tuple[float, float]:
    """(slope, intercept) by least squares."""
    return tuple(pairs.agg(F.regr_slope("y", "x"), F.regr_intercept("y", "x")).first())


def fit_quadratic(pairs: DataFrame) -> tuple[float | None, float | None, float | None]:
    """(a, b, c) of a*x*x + b*x + c: sums of centred powers in one aggregate, a system of three equations here. All None without pairs."""
    mean, scale = pairs.agg(F.avg("x"), F.max(F.abs("x"))).first()
    if mean is None:
        return None, None, None
    scale = scale or 1.0
    x, y = (F.col("x") - mean) / scale, F.col("y")
    powers = [F.sum(F.pow(x, F.lit(k))) for k in range(5)]
    row = pairs.agg(*powers, F.sum(y), F.sum(x * y), F.sum(x * x * y)).first()
    s, t = row[:5], row[5:]
    c, b, a = np.linalg.lstsq(np.array([[s[i + j] for j in range(3)] for i in range(3)]), np.array(t), rcond=None)[0]
    a, b = a / scale**2, b / scale
    return float(a), float(b - 2 * a * mean), float(c - b * mean + a * mean**2)


def score(pairs: DataFrame, predicted: Column, how: str, constant: float, relative: float = 0.0) -> DataFrame:
    """Adds y_hat, lower, upper and inside. how: "cnt" (a constant band) or "dep" (it widens with the prediction)."""
    width = F.lit(constant) if how == "cnt" else F.abs("y_hat") * relative + constant
    signed = F.lit(constant) if how == "cnt" else F.col("y_hat") * relative + constant
    out = pairs.withColumn("y_hat", predicted)
    return out.withColumns({"lower": F.col("y_hat") - signed, "upper": F.col("y_hat") + signed, "inside": F.abs(F.col("y") - F.col("y_hat")) <= width})


def linear(pairs: DataFrame, how: str, constant: float, relative: float = 0.0) -> DataFrame:
    a, b = fit_linear(pairs)
    return score(pairs, F.lit(a) * F.col("x") + F.lit(b), how, constant, relative)


def quadratic(pairs: DataFrame, how: str, constant: float, relative: float = 0.0) -> DataFrame:
    a, b, c = fit_quadratic(pairs)
    return score(pairs, F.lit(a) * F.col("x") * F.col("x") + F.lit(b) * F.col("x") + F.lit(c), how, constant, relative)
