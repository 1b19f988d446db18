"""Forecast models behind one protocol, on long samples (sample_id, step, features..., y)."""

from __future__ import annotations

from typing import Protocol

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.networks import Convolution, Dense
from tidemark.operators.support import SupportVector


class Model(Protocol):
    def fit(self, samples: DataFrame, features: list[str]) -> Model: ...

    def predict(self, samples: DataFrame) -> DataFrame:
        """Adds y_pred."""
        ...


class _Spark:
    """A regressor of Spark ML over all rows of all steps, the step being a feature."""

    def fit(self, samples: DataFrame, features: list[str]) -> Model:
        self.assembler = VectorAssembler(inputCols=[*features, "step"], outputCol="_x", handleInvalid="skip")
        self.model = self.make().fit(self.assembler.transform(samples))
        return self

    def predict(self, samples: DataFrame) -> DataFrame:
        return self.model.transform(self.assembler.transform(samples)).drop("_x")


class Linear(_Spark):
    def make(self):
        return LinearRegression(featuresCol="_x", labelCol="y", predictionCol="y_pred")


class Boosted(_Spark):
    """Gradient-boosted trees, 100 rounds with a step of 0.1."""

    def __init__(self, rounds: int = 100, step: float = 0.1):
        self.rounds, self.step = rounds, step

    def make(self):
        return GBTRegressor(featuresCol="_x", labelCol="y", predictionCol="y_pred", maxIter=self.rounds, stepSize=self.step, seed=42)


#: Both support-vector kinds fit one model for each feature to forecast, over the rows of all steps.
MODELS: dict[str, type] = {"LIN": Linear, "LGBMR": Boosted, "SVR_dir": SupportVector, "SVR_MIMO": SupportVector}
#: Kinds that forecast whole arrays: networks.Network(NETWORKS[kind](...)), on samples (x, y).
NETWORKS: dict[str, type] = {"Dense": Dense, "CNN": Convolution}
#: Recurrent kinds; a Model can be passed in their place.
FOREIGN = ("LSTM", "AR LSTM")


def make(kind: str) -> Model:
    if kind in NETWORKS:
        raise ValueError(f"{kind} forecasts arrays: use networks.Network")
    if kind in FOREIGN:
        raise NotImplementedError(f"{kind}: pass an object with fit and predict")
    return MODELS[kind]()


def equal_steps(horizon_minutes: dict[str, float]) -> None:
    """Row-wise models need one time step for all features."""
    if len(set(horizon_minutes.values())) > 1:
        raise ValueError("row-wise models need the same time step for all features")


def train_and_predict(samples: DataFrame, features: list[str], model: Model) -> DataFrame:
    """Fit on the rows with split "train", predict all others."""
    model.fit(samples.where("split = 'train'"), features)
    return model.predict(samples.where("split != 'train'")).withColumn("residual", F.col("y") - F.col("y_pred"))
