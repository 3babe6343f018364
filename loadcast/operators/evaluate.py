"""Scoring predictions: alignment, metric tables, model comparison, plausibility."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..series import SeriesSpec
from .chunks import beside

# Limits outside which a score deserves a second look.
R2_TOO_GOOD, R2_WEAK = 0.90, 0.50
MAPE_TOO_GOOD, MAPE_WEAK = 3.0, 20.0


def align(truth: DataFrame, predictions: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Truth next to prediction, matched on series and time."""
    return truth.join(predictions, [*spec.keys, spec.ts], "inner")


def score(df: DataFrame, y: str, yhat: str, by: list[str] | None = None) -> DataFrame:
    """MAE, MSE, RMSE, MAPE and R2, with the numbers of scored and skipped rows."""
    return df.groupBy(*(by or [])).agg(
        *[e.alias(n) for n, e in M.point_bundle(y, yhat).items()],
        M.scored(y, yhat).alias("n_scored"), M.skipped(y, yhat).alias("n_skipped"))


def score_quantiles(df: DataFrame, y: str, quantiles: list[str], by: list[str] | None = None,
                    expected: float = M.EXPECTED_COVERAGE) -> DataFrame:
    """Pinball loss per quantile column; interval metrics when q10 and q90 are among them."""
    bundle = M.quantile_bundle(y, quantiles)
    if {"q10", "q90"} <= set(quantiles):
        bundle.update(M.interval_bundle(y, "q10", "q90", expected))
    return df.groupBy(*(by or [])).agg(*[e.alias(n) for n, e in bundle.items()])


def score_interval(df: DataFrame, y: str, lower: str, upper: str, by: list[str] | None = None,
                   expected: float = M.EXPECTED_COVERAGE) -> DataFrame:
    return df.groupBy(*(by or [])).agg(
        *[e.alias(n) for n, e in M.interval_bundle(y, lower, upper, expected).items()])


def to_long(table: DataFrame, by: list[str]) -> DataFrame:
    """A wide metric table as rows (by..., metric, value)."""
    names = [c for c in table.columns if c not in by]
    as_double = table.select(*by, *[F.col(c).cast("double").alias(c) for c in names])
    return as_double.unpivot(by, names, "metric", "value")


def compare(long: DataFrame, metrics: list[str], by: str = "model") -> DataFrame:
    """Models as rows, metrics as columns."""
    return long.groupBy(by).pivot("metric", metrics).agg(F.first("value"))


def best_model(table: DataFrame, metric: str = "rmse", ascending: bool = True,
               by: str = "model") -> DataFrame:
    """Model with the smallest (or largest) value of a metric; ties go to the first name."""
    if metric not in table.columns:
        raise ValueError(f"metric {metric!r} is not in the table")
    value = F.col(metric) if ascending else -F.col(metric)
    known = table.where(F.col(metric).isNotNull())
    return known.agg(
        F.min_by(by, F.struct(value, F.col(by))).alias(by),
        (F.min(metric) if ascending else F.max(metric)).alias(metric))


def metric_by_group(df: DataFrame, y: str, yhat: str, group: str,
                    metric: Callable[[str, str], Column] = M.mae,
                    by: list[str] | None = None) -> DataFrame:
    """Any aggregate metric per group, with the spread across the groups on every row.

    ``metric`` maps the truth and prediction columns to an aggregate column. The spread
    is null when there is only one group.
    """
    by = by or []
    per_group = df.where(F.col(group).isNotNull()).groupBy(*by, group).agg(metric(y, yhat).alias("metric"))
    several = F.count("metric") > 1
    spread = per_group.groupBy(*by).agg(
        F.when(several, F.var_pop("metric")).alias("inter_group_variance"),
        F.when(several, F.max("metric") - F.min("metric")).alias("max_group_difference"))
    return beside(per_group, spread, by)


def plausibility(df: DataFrame, y: str, yhat: str, by: list[str] | None = None) -> DataFrame:
    """Scores with warnings for results too good or too weak to trust."""
    scored = df.groupBy(*(by or [])).agg(
        M.mae(y, yhat).alias("mae"), M.rmse(y, yhat).alias("rmse"), M.r2(y, yhat).alias("r2"),
        M.mape(y, yhat, 0.0).alias("mape"))
    warnings = F.array_compact(F.array(
        F.when(F.col("r2") > R2_TOO_GOOD, "r2 too high, overfitting likely"),
        F.when(F.col("mape") < MAPE_TOO_GOOD, "mape too low, overfitting likely"),
        F.when(F.col("r2") < R2_WEAK, "r2 low, weak model"),
        F.when(F.col("mape") > MAPE_WEAK, "mape high, imprecise model")))
    return scored.withColumn("warnings", warnings).withColumn("is_realistic", F.size("warnings") == 0)
