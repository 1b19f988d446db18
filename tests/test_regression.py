"""Fits of pairs that can't be fitted."""

import pytest

from tidemark.operators import regression


@pytest.mark.parametrize("fit", [regression.linear, regression.quadratic])
def test_without_usable_pairs(spark, fit):
    pairs = regression.usable(spark.createDataFrame([(None, 1.0), (2.0, float("nan"))], "x double, y double"))
    out = fit(pairs, "cnt", 1.0)
    assert out.collect() == [] and {"y_hat", "lower", "upper", "inside"} <= set(out.columns)
