"""Models by name.

Plain types need no series description; ``enhanced_*`` and ``ensemble`` search over time folds and take ``spec``,
as do the types that fit a model per series.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..series import SeriesSpec
from . import models, per_series, search
from .ensemble import Ensemble, FittedEnsemble
from .forest import FittedForest
from .least import FittedLinear
from .models import FittedModel, read_details
from .per_series import FittedPerSeries
from .quantile import FittedBoosting, FittedQuantileModel, LeafBoosting, QuantileBoosting


def _ensemble(spec: SeriesSpec, members: list | None = None, holdout: bool = False) -> Ensemble:
    chosen = members or [search.enhanced_linear(spec), search.enhanced_random_forest(spec),
                         search.enhanced_boosting(spec)]
    return Ensemble(chosen, spec, holdout)


BUILDERS = {
    "linear": models.linear,
    "random_forest": models.random_forest,
    "lightgbm": LeafBoosting,
    "gradient_boosting": models.boosting,
    "gradient_boosting_quantile": QuantileBoosting,
    "linear_per_series": per_series.PerSeries,
    "enhanced_per_series": per_series.enhanced_per_series,
    "enhanced_linear": search.enhanced_linear,
    "enhanced_random_forest": search.enhanced_random_forest,
    "enhanced_lightgbm": search.enhanced_boosting,
    "ensemble": _ensemble,
}

#: Types that take ``spec``.
NEED_SPEC = {t for t in BUILDERS if t.startswith("enhanced_") or t.endswith("_per_series")} | {"ensemble"}

SUPPORTS_INTERVALS = {"gradient_boosting_quantile"}


def create_model(model_type: str, **params):
    """An unfitted model; call ``fit(table, feature_names, target)`` on it."""
    if model_type not in BUILDERS:
        raise ValueError(f"unknown model type {model_type!r}; one of {', '.join(BUILDERS)}")
    return BUILDERS[model_type](**params)


def available_models() -> dict[str, dict]:
    """The plain model types with their display names and whether they give intervals."""
    return {t: {"name": n, "supports_intervals": t in SUPPORTS_INTERVALS} for t, n in models.NAMES.items()}


def load_model(spark: SparkSession, path: str):
    """The fitted model saved at ``path``, of whatever type."""
    kind = read_details(spark, path)["kind"]
    return {"linear": FittedLinear, "pipeline": FittedModel, "quantile": FittedQuantileModel,
            "ensemble": FittedEnsemble, "per_series": FittedPerSeries, "boosting": FittedBoosting, "forest": FittedForest}[kind].load(spark, path)
