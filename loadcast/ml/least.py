"""Exact least squares from one matrix of sums, whatever the rank of the features.

The sums of products of the standardised columns come from one distributed aggregate, a matrix as wide as the
features are many; only that comes to the driver. Where features depend on each other, the coefficients with the
smallest norm are chosen among those that fit equally well.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import score
from .moments import Scatter

#: Share of the largest eigenvalue below which a direction counts as empty: sums of doubles know no better.
EMPTY = 1e-11
#: Largest part of the right side that a solution may leave open.
OPEN = 1e-6


@dataclass
class Moments:
    """Sizes, means and deviations of features and target, and products of their standardised values."""

    n: int
    means: np.ndarray
    deviations: np.ndarray
    products: np.ndarray


def moments(df: DataFrame, features: list[str], target: str) -> Moments:
    """Two passes: means and deviations, then products of what is left. Rows without a target do not count;
    a null feature is an error."""
    names = [*features, target]
    rows = df.where(F.col(target).isNotNull()).select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(names)])
    one = rows.agg(F.count("*"), *[f(F.col(c)) for c in rows.columns for f in (F.count, F.avg, F.stddev_pop)]).first()
    n = one[0]
    if not n:
        raise ValueError("no row with a target to fit on")
    missing = [c for i, c in enumerate(names) if one[1 + 3 * i] < n]
    if missing:
        raise ValueError(f"null values in {', '.join(missing)}")
    means = np.array([one[2 + 3 * i] for i in range(len(names))])
    deviations = np.array([one[3 + 3 * i] for i in range(len(names))])
    # a constant column differs from its mean by rounding only
    deviations[deviations <= 1e-12 * np.abs(means)] = 0.0
    if not np.isfinite(means).all() or not np.isfinite(deviations).all():
        raise ValueError("infinite or undefined values in the features or the target")
    scaled = [((F.col(f"_{i}") - float(m)) / float(s) if s else F.lit(0.0)).alias(f"_{i}")
              for i, (m, s) in enumerate(zip(means, deviations, strict=True))]
    vectors = VectorAssembler(inputCols=rows.columns, outputCol="v").transform(rows.select(*scaled)).select("v")
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v"), numCols=len(names))
    return Moments(n, means, deviations, matrix.computeGramianMatrix().toArray())


def standardised(found: Scatter) -> Moments:
    """The same of a scatter matrix whose last column is the target. Values that are not finite are an error."""
    if not np.isfinite(found.scatter).all():
        raise ValueError("null, infinite or undefined values in the features or the target")
    deviations = np.sqrt(np.diag(found.scatter) / found.n)
    deviations[deviations <= 1e-12 * np.abs(found.mean)] = 0.0
    scale = np.where(deviations > 0, deviations, 1.0)
    return Moments(found.n, found.mean, deviations, found.scatter / np.outer(scale, scale))


def solve(m: Moments, alpha: float = 0.0) -> tuple[np.ndarray, float]:
    """Coefficients and intercept that minimise |y - Xw - b|^2 + alpha |w|^2, of least norm among equals."""
    p = len(m.means) - 1
    gram, right = m.products[:p, :p], m.products[:p, p]
    scale, spread = m.deviations[:p], m.deviations[p]
    used = np.flatnonzero(scale)
    weights = np.zeros(p)
    if len(used) and spread:
        gram, right, scale = gram[np.ix_(used, used)], right[used], scale[used]
        if alpha:
            weights[used] = np.linalg.solve(gram + np.diag(alpha / scale**2), right) * spread / scale
        else:
            values, vectors = np.linalg.eigh(gram)
            full = values > EMPTY * values[-1]
            fit = vectors[:, full] @ (vectors[:, full].T @ right / values[full])
            if np.abs(gram @ fit - right).max() > OPEN * max(np.abs(right).max(), m.n * EMPTY):
                raise ArithmeticError("the normal equations have no accurate solution")
            # among all equally good ones the smallest, in the units of the features
            free = vectors[:, ~full]
            if free.shape[1]:
                fit = fit - free @ np.linalg.lstsq(free / scale[:, None], fit / scale, rcond=None)[0]
            weights[used] = fit * spread / scale
    return weights, float(m.means[p] - m.means[:p] @ weights)


@dataclass
class FittedLinear:
    """Coefficients by feature, and an intercept. ``transform`` adds ``yhat``."""

    name: str
    feature_names: list[str]
    coefficients: list[float]
    intercept: float
    target: str = "y"
    details: dict = field(default_factory=dict)

    def _prediction(self) -> Column:
        total = F.lit(self.intercept)
        for c, w in zip(self.feature_names, self.coefficients, strict=True):
            total = total + F.col(c) * F.lit(w)
        return total

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("yhat", self._prediction())

    def evaluate(self, df: DataFrame, by: list[str] | None = None) -> DataFrame:
        return score(self.transform(df), self.target, "yhat", by)

    def save(self, path: str) -> None:
        from .models import write_details

        write_details(SparkSession.active(), path, {
            "kind": "linear", "name": self.name, "feature_names": self.feature_names, "target": self.target,
            "coefficients": self.coefficients, "intercept": self.intercept, "details": self.details})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FittedLinear:
        from .models import read_details

        info = read_details(spark, path)
        return cls(info["name"], info["feature_names"], info["coefficients"], info["intercept"], info["target"],
                   info["details"])


class LeastSquares:
    """Ordinary least squares, or ridge regression with ``alpha`` above 0."""

    def __init__(self, name: str, alpha: float = 0.0):
        self.name, self.alpha = name, alpha

    def fit(self, df: DataFrame, features: list[str], target: str = "y") -> FittedLinear:
        weights, intercept = solve(moments(df, features, target), self.alpha)
        details = {"alpha": self.alpha} if self.alpha else {}
        return FittedLinear(self.name, list(features), weights.tolist(), intercept, target, details)
