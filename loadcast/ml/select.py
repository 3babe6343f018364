"""Choosing features by linear association and by importance in a forest."""

from __future__ import annotations

from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import fit_pipeline

# How many features to keep, and when one is useless.
MAX_FEATURES = 50
NULL_SHARE, LEAST_VARIANCE = 0.5, 1e-8
SELECTION_FOREST = {"numTrees": 50, "seed": 42, "featureSubsetStrategy": "all", "maxDepth": 12}


def f_scores(df: DataFrame, features: list[str], target: str = "y") -> DataFrame:
    """F statistic of the one-feature regression of the target, nulls read as 0.

    All features in one aggregate: F = r^2 / (1 - r^2) * (n - 2).
    """
    filled = df.select(target, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    one = filled.agg(F.count(target).alias("_n"),
                     *[F.corr(c, target).alias(f"_r{i}") for i, c in enumerate(features)])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_r{i}").alias("r"))
                     for i, c in enumerate(features)])
    square = F.col("r") * F.col("r")
    return (one.select("_n", F.explode(rows).alias("e")).select("_n", "e.*")
            .select("feature", "r", (F.try_divide(square, 1 - square) * (F.col("_n") - 2)).alias("f_score")))


def usable(df: DataFrame, features: list[str]) -> list[str]:
    """Features that are mostly present and not constant. One aggregate."""
    row = df.agg(F.count("*").alias("_n"), *[
        e for i, c in enumerate(features)
        for e in (F.count_if(F.col(c).isNull()).alias(f"_m{i}"), F.var_samp(c).alias(f"_v{i}"))]).first()
    return [c for i, c in enumerate(features)
            if row[f"_m{i}"] < row["_n"] * NULL_SHARE and (row[f"_v{i}"] or 0.0) > LEAST_VARIANCE]


def importances(df: DataFrame, features: list[str], target: str = "y", **params) -> dict[str, float]:
    filled = df.na.fill(0.0, subset=list(features))
    model = fit_pipeline(filled, RandomForestRegressor(**{**SELECTION_FOREST, **params}), features, target)
    found = model.stages[-1].featureImportances
    return {c: float(found[i]) for i, c in enumerate(features)}


def select(df: DataFrame, features: list[str], target: str = "y",
           max_features: int = MAX_FEATURES, **params) -> list[str]:
    """The best by F score and the best by importance, in order of importance.

    With no more than ``max_features`` usable ones the input list comes back unchanged.
    """
    kept = usable(df, features)
    if len(kept) <= max_features:
        return list(features)
    scores = f_scores(df, kept, target)
    by_f = [r.feature for r in scores.orderBy(F.desc_nulls_last("f_score"), "feature").limit(max_features).collect()]
    weight = importances(df, kept, target, **params)
    ranked = sorted(kept, key=lambda c: (-weight[c], c))
    wanted = set(by_f) | set(ranked[:max_features])
    return [c for c in ranked if c in wanted][:max_features]
