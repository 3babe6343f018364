"""Scoring and parity audit of any number of models in a few aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import evaluate as ev
from ..operators import fairness as fair


def leaderboard(predictions: DataFrame, y: str = "y", yhat: str = "yhat", by: str = "model") -> DataFrame:
    """Models as rows, point metrics as columns."""
    return ev.score(predictions, y, yhat, [by])


def quantile_leaderboard(predictions: DataFrame, quantiles: list[str], y: str = "y",
                         by: str = "model") -> DataFrame:
    return ev.score_quantiles(predictions, y, quantiles, [by])


def fairness_report(predictions: DataFrame, ts: str, y: str = "y", yhat: str = "yhat",
                    lower: str | None = None, upper: str | None = None, by: str = "model",
                    custom=None) -> DataFrame:
    """Parity statistics per model, grouping and metric over the time groups."""
    labelled = fair.with_groups(predictions, ts, custom)
    groupings = [*fair.GROUPINGS, *(custom or {})]
    return fair.fairness_summary(labelled, y, yhat, [by], lower, upper, groupings)
