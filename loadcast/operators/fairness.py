"""Error parity across time groups.

All groupings are audited in one pass: errors are first summed per combination of labels,
at most a few dozen cells per model, and each grouping is then read off those cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import GROUPINGS, group_labels
from ..functions.metrics import covered


def with_groups(df: DataFrame, ts: str, custom: dict[str, Column] | None = None) -> DataFrame:
    """Add the five time-group labels and any label columns of the caller's."""
    return df.withColumns({**group_labels(ts), **(custom or {})})


def _by_label(cells: DataFrame, by: list[str], groupings: list[str], sums: list[str]) -> DataFrame:
    labels = F.array(*[F.struct(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("label"))
                       for g in groupings])
    return (cells.withColumn("_l", F.explode(labels))
            .select(*by, "_l.grouping", "_l.label", *sums)
            .where(F.col("label").isNotNull())
            .groupBy(*by, "grouping", "label").agg(*[F.sum(s).alias(s) for s in sums]))


def group_metrics(df: DataFrame, y: str, yhat: str, by: list[str] | None = None,
                  groupings: list[str] | None = None) -> DataFrame:
    """MAE, RMSE and number of scored rows for every label of every grouping."""
    by, groupings = by or [], groupings or GROUPINGS
    e = F.col(y) - F.col(yhat)
    cells = df.groupBy(*by, *groupings).agg(
        F.count(e).alias("n"), F.sum(F.abs(e)).alias("size"), F.sum(e * e).alias("square"))
    sums = _by_label(cells, by, groupings, ["n", "size", "square"])
    return sums.where(F.col("n") > 0).select(
        *by, "grouping", "label", (F.col("size") / F.col("n")).alias("mae"),
        F.sqrt(F.col("square") / F.col("n")).alias("rmse"), F.col("n").alias("count"))


def group_coverage(df: DataFrame, y: str, lower: str, upper: str, by: list[str] | None = None,
                   groupings: list[str] | None = None) -> DataFrame:
    """Interval coverage for every label of every grouping."""
    by, groupings = by or [], groupings or GROUPINGS
    cells = df.groupBy(*by, *groupings).agg(
        F.count("*").alias("n"), F.sum(covered(y, lower, upper)).alias("hit"))
    sums = _by_label(cells, by, groupings, ["n", "hit"])
    return sums.select(*by, "grouping", "label", (F.col("hit") / F.col("n")).alias("coverage"),
                       F.col("n").alias("count"))


def _spread(column: str, with_cv: bool = True) -> list[Column]:
    """Population variance, range and relative deviation of a metric across labels."""
    several = F.count(column) > 1
    columns = [F.when(several, F.var_pop(column)).alias(f"{column}_variance"),
               F.when(several, F.max(column) - F.min(column)).alias(f"{column}_range")]
    if with_cv:
        relative = F.when(F.avg(column) > 0, F.try_divide(F.stddev_pop(column), F.avg(column))).otherwise(0.0)
        columns.append(F.when(several, relative).alias(f"{column}_cv"))
    return columns


def parity(df: DataFrame, y: str, yhat: str, by: list[str] | None = None,
           groupings: list[str] | None = None) -> DataFrame:
    """Spread of MAE and RMSE across the labels of each grouping; null for a single label."""
    by = by or []
    labels = group_metrics(df, y, yhat, by, groupings)
    return labels.groupBy(*by, "grouping").agg(
        *_spread("mae"), *_spread("rmse"), F.count("*").alias("n_groups"))


def coverage_parity(df: DataFrame, y: str, lower: str, upper: str, by: list[str] | None = None,
                    groupings: list[str] | None = None) -> DataFrame:
    """Spread of interval coverage across the labels of each grouping."""
    by = by or []
    labels = group_coverage(df, y, lower, upper, by, groupings)
    return labels.groupBy(*by, "grouping").agg(
        *_spread("coverage", with_cv=False), F.count("*").alias("n_groups"))


def fairness_summary(df: DataFrame, y: str, yhat: str, by: list[str],
                     lower: str | None = None, upper: str | None = None,
                     groupings: list[str] | None = None) -> DataFrame:
    """One row per model, grouping and metric with variance, range and coefficient_variation.

    For quantile forecasts pass the median as ``yhat`` and the bounds as well.
    """
    def rows(table: DataFrame, metrics: list[str], with_cv: bool) -> DataFrame:
        entries = [F.struct(
            F.lit(m).alias("metric"), F.col(f"{m}_variance").alias("variance"),
            F.col(f"{m}_range").alias("range"),
            (F.col(f"{m}_cv") if with_cv else F.lit(None).cast("double")).alias("coefficient_variation"))
            for m in metrics]
        return table.where(F.col("n_groups") > 1).select(
            *by, "grouping", F.explode(F.array(*entries)).alias("e")).select(*by, "grouping", "e.*")

    summary = rows(parity(df, y, yhat, by, groupings), ["mae", "rmse"], True)
    if lower and upper:
        summary = summary.unionByName(
            rows(coverage_parity(df, y, lower, upper, by, groupings), ["coverage"], False))
    return summary


def compare_fairness(summary: DataFrame, groupings: list[str] | None = None,
                     metrics: tuple[str, ...] = ("mae", "rmse"), by: str = "model") -> DataFrame:
    """Models as rows, ``<grouping>_<metric>_<statistic>`` as columns."""
    statistics = {"variance": "variance", "range": "range", "coefficient_variation": "cv"}
    columns = []
    for g in groupings or GROUPINGS:
        for m in metrics:
            here = (F.col("grouping") == g) & (F.col("metric") == m)
            columns += [F.max(F.when(here, F.col(s))).alias(f"{g}_{m}_{short}")
                        for s, short in statistics.items()]
    return summary.groupBy(by).agg(*columns)


def least_disparity(summary: DataFrame, criterion: str = "variance", by: str = "model") -> DataFrame:
    """Model whose summed variance (or range) over all groupings and metrics is smallest."""
    if criterion not in ("variance", "range"):
        raise ValueError(f"criterion must be variance or range, not {criterion!r}")
    totals = summary.groupBy(by).agg(F.sum(criterion).alias("disparity"))
    return totals.agg(F.min_by(by, F.struct("disparity", by)).alias(by),
                      F.min("disparity").alias("disparity"))
