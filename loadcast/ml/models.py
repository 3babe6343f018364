"""Regressors by name, and what a fitted one can do: predict, score, be saved and loaded."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession

from ..operators.evaluate import score
from .forest import DeepForest
from .least import LeastSquares

VECTOR = "_features"

# Display names and default settings per model type.
NAMES = {
    "linear": "Linear Regression",
    "random_forest": "Random Forest",
    "lightgbm": "LightGBM",
    "gradient_boosting": "Gradient Boosting (fallback)",
    "gradient_boosting_quantile": "Gradient Boosting Quantile",
}
FOREST = {"numTrees": 100, "seed": 42, "featureSubsetStrategy": "all", "maxDepth": 12}
BOOSTING = {"maxIter": 100, "stepSize": 0.05, "maxDepth": 5, "featureSubsetStrategy": "0.9",
                  "subsamplingRate": 0.8, "seed": 42}
BOOSTING = {"maxIter": 100, "stepSize": 0.1, "maxDepth": 6, "seed": 42}


@dataclass
class FittedModel:
    """A fitted pipeline with its name and input columns. ``transform`` adds ``yhat``."""

    name: str
    feature_names: list[str]
    pipeline: PipelineModel
    target: str = "y"
    details: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(df).drop(VECTOR)

    def evaluate(self, df: DataFrame, by: list[str] | None = None) -> DataFrame:
        return score(self.transform(df), self.target, "yhat", by)

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        write_details(SparkSession.active(), path, {
            "kind": "pipeline", "name": self.name, "feature_names": self.feature_names,
            "target": self.target, "details": self.details})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FittedModel:
        info = read_details(spark, path)
        return cls(info["name"], info["feature_names"], PipelineModel.load(f"{path}/pipeline"),
                   info["target"], info["details"])


def write_details(spark: SparkSession, path: str, info: dict) -> None:
    row = spark.createDataFrame([(json.dumps(info),)], "details string")
    row.coalesce(1).write.mode("overwrite").text(f"{path}/details")


def read_details(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/details").first()[0])


@dataclass
class Regressor:
    """An unfitted Spark ML regressor with a display name."""

    name: str
    estimator: object

    def fit(self, df: DataFrame, features: list[str], target: str = "y") -> FittedModel:
        return FittedModel(self.name, list(features), fit_pipeline(df, self.estimator, features, target), target)


def fit_pipeline(df: DataFrame, estimator, features: list[str], target: str) -> PipelineModel:
    assembler = VectorAssembler(inputCols=list(features), outputCol=VECTOR)
    configured = estimator.copy({estimator.featuresCol: VECTOR, estimator.labelCol: target,
                                 estimator.predictionCol: "yhat"})
    return Pipeline(stages=[assembler, configured]).fit(df.select(*dict.fromkeys([*features, target])))


def linear() -> LeastSquares:
    """Least squares, exact for dependent features too."""
    return LeastSquares(NAMES["linear"])


def random_forest(n_estimators: int = 100, random_state: int = 42, **params) -> Regressor | DeepForest:
    """100 trees over all features, grown until nothing is left to split.

    With a ``maxDepth`` that is not null it is Spark's forest on binned features, which predicts inside the JVM;
    ``FOREST`` has its settings.
    """
    settings = {"numTrees": n_estimators, "seed": random_state, **params}
    if params.get("maxDepth") is None:
        return DeepForest(NAMES["random_forest"], **settings)
    return Regressor(NAMES["random_forest"], RandomForestRegressor(**{**FOREST, **settings}))


def boosting(**params) -> Regressor:
    return Regressor(NAMES["gradient_boosting"], GBTRegressor(**{**BOOSTING, **params}))

