"""A linear model for every series in one job: moments per series, solved where they lie.

Series are independent of each other; a series of any length is combined before it is shuffled, and a series whose
fit fails (no usable rows, values that are not finite) leaves the others alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.chunks import attach
from ..operators.evaluate import score
from ..operators.splits import FOLDS
from ..series import SeriesSpec
from ..session import keep_table
from .least import solve, standardised
from .linear import RIDGE_GRID, searched
from .models import read_details, write_details
from .moments import group_moments, scatter_of, sum_of

_BLOCK = "_block"


@dataclass
class FittedPerSeries:
    """A table of one row per series: keys, ``_n``, ``_intercept``, one coefficient per feature (``_w0``, ...),
    ``_alpha`` and ``_problem`` (null if the fit succeeded). ``transform`` adds ``yhat``, null for unknown series."""

    name: str
    feature_names: list[str]
    keys: list[str]
    table: DataFrame
    target: str = "y"
    details: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        weights = [f"_w{i}" for i in range(len(self.feature_names))]
        known = self.table.select(*self.keys, "_intercept", *weights)
        total = F.col("_intercept")
        for c, w in zip(self.feature_names, weights, strict=True):
            total = total + F.col(c) * F.col(w)
        return attach(df, known, self.keys).withColumn("yhat", total).select(*df.columns, "yhat")

    def problems(self) -> DataFrame:
        """The series that have no model, and why."""
        return self.table.where("_problem IS NOT NULL").select(*self.keys, F.col("_problem").alias("problem"))

    def evaluate(self, df: DataFrame, by: list[str] | None = None) -> DataFrame:
        return score(self.transform(df), self.target, "yhat", by)

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(f"{path}/series")
        write_details(SparkSession.active(), path, {
            "kind": "per_series", "name": self.name, "feature_names": self.feature_names, "keys": self.keys,
            "target": self.target, "details": self.details})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FittedPerSeries:
        info = read_details(spark, path)
        return cls(info["name"], info["feature_names"], info["keys"], spark.read.parquet(f"{path}/series"),
                   info["target"], info["details"])


class PerSeries:
    """Least squares per series, ridge with one ``alpha``, or with ``grid`` the best ridge of each series.

    The grid is searched over time folds inside each series, from the moments of its time blocks.
    """

    def __init__(self, spec: SeriesSpec, alpha: float = 0.0, grid: list[dict] | None = None, folds: int = FOLDS):
        if not spec.keys:
            raise ValueError("one model per series needs series keys")
        self.spec, self.alpha, self.grid, self.folds = spec, alpha, grid, folds
        self.name = "Enhanced Ridge per Series" if grid else "Linear Regression per Series"

    def fit(self, df: DataFrame, features: list[str], target: str | None = None) -> FittedPerSeries:
        """Rows without a target do not count."""
        from .search import folded

        target, keys, width = target or self.spec.target, list(self.spec.keys), len(features) + 1
        alpha, grid, folds = self.alpha, self.grid, self.folds
        columns = dict.fromkeys([*keys, *self.spec.order, target, *features])
        rows = df.select(*columns)
        rows = (folded(rows, self.spec, folds) if grid else rows.withColumn(_BLOCK, F.lit(0))).where(F.col(target).isNotNull())
        found = group_moments(rows, [*features, target], [*keys, _BLOCK])
        # a few blocks of each series meet in a row
        per_key = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(_BLOCK, "_n", "_mean", "_scatter"))).alias("_all"))
        numbers = ", ".join(["_n bigint", "_intercept double", "_alpha double", "_problem string",
                             *[f"_w{i} double" for i in range(len(features))]])
        schema = T.StructType([*[df.schema[k] for k in keys], *T.StructType.fromDDL(numbers).fields])

        def one(blocks: dict) -> tuple:
            total = sum_of([blocks[b] for b in sorted(blocks)])
            try:
                for block in blocks.values():
                    standardised(block)
                if grid:
                    _, best, weights, intercept = searched(blocks, grid, folds)
                    return (total.n, intercept, grid[best]["alpha"], None, *weights)
                weights, intercept = solve(standardised(total), alpha)
                return (total.n, intercept, alpha, None, *weights)
            except (ValueError, ArithmeticError, np.linalg.LinAlgError) as e:
                return (total.n, None, None, str(e), *[None] * len(features))

        def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                made = [one({b[_BLOCK]: scatter_of(b, width) for b in blocks}) for blocks in batch["_all"]]
                out = pd.DataFrame(made, columns=schema.names[len(keys) :], dtype=object)
                yield pd.concat([batch[keys].reset_index(drop=True), out], axis=1)

        table = keep_table(per_key.mapInPandas(solved, schema), "per_series")
        return FittedPerSeries(self.name, list(features), keys, table, target,
                               {"alpha": alpha} if not grid else {"grid": grid})


def enhanced_per_series(spec: SeriesSpec, **options) -> PerSeries:
    """The penalty of each series searched over its own time folds."""
    return PerSeries(spec, grid=options.pop("grid", RIDGE_GRID), **options)
