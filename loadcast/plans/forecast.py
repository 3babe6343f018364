"""Forecasts for every series in one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..ml import NEED_SPEC, create_model, load_model
from ..operators.project import fill_constant, fixed_interval, last_row, tail
from ..operators.resample import future
from ..series import SeriesSpec
from ..session import keep_table
from ..sources.store import latest_model
from .features import basic, feature_names, model_table

MODEL_VERSION = "1.0"
OUTPUT = ["yhat", "model_name", "model_version"]


def future_rows(features: DataFrame, spec: SeriesSpec, horizon: int, step: str = "1 hour") -> DataFrame:
    """Each series' last feature row once per future step, calendar columns refreshed.

    Lags and rolling columns keep their last values, as do day_of_year and week_of_year.
    """
    ahead = future(last_row(features, spec), spec, horizon, step)
    fresh = {n: e for n, e in cal.temporal(spec.ts).items()
             if n in features.columns and n not in cal.NOT_REFRESHED}
    return ahead.withColumns(fresh) if fresh else ahead


def forecast(features: DataFrame, spec: SeriesSpec, predict: Callable[[DataFrame], DataFrame],
             horizon: int = 24, step: str = "1 hour", with_intervals: bool = False,
             model_name: str = "Unknown", inputs: list[str] | None = None) -> DataFrame:
    """``horizon`` steps ahead for every series.

    ``predict`` adds ``yhat`` (or ``q50``) to a table of feature rows.
    """
    inputs = inputs or feature_names(features, spec)
    rows = fill_constant(future_rows(features, spec, horizon, step), 0.0, inputs)
    out = predict(rows)
    if "yhat" not in out.columns:
        out = out.withColumn("yhat", F.col("q50"))
    return _finished(out, spec, with_intervals, model_name)


def naive_last(df: DataFrame, spec: SeriesSpec, horizon: int = 24, step: str = "1 hour",
               with_intervals: bool = False) -> DataFrame:
    """The last known value repeated; the model to fall back on, and a baseline."""
    ends = df.groupBy(*spec.keys).agg(
        F.max(spec.ts).alias(spec.ts),
        F.max_by(spec.target, F.when(F.col(spec.target).isNotNull(), spec.order_value)).alias("yhat"))
    return _finished(future(ends, spec, horizon, step), spec, with_intervals, "Naive Last")


def _finished(rows: DataFrame, spec: SeriesSpec, with_intervals: bool, model_name: str) -> DataFrame:
    rows = rows.withColumns({"model_name": F.lit(model_name), "model_version": F.lit(MODEL_VERSION)})
    columns = [*spec.keys, spec.ts, "horizon_step", *OUTPUT]
    if with_intervals:
        rows = rows.withColumns(fixed_interval("yhat"))
        columns += ["yhat_lower", "yhat_upper"]
    return rows.select(*columns)


def train_and_forecast(df: DataFrame, spec: SeriesSpec, model_type: str = "linear",
                       horizon: int = 24, step: str = "1 hour", with_intervals: bool = False,
                       training_rows: int | None = None, **params) -> DataFrame:
    """Features, a model fitted on them, and its forecast for every series.

    ``linear_per_series`` and ``enhanced_per_series`` fit one model per series, other types one for all series.
    ``training_rows`` keeps the newest rows of each series for the fit; by default all count. The features are
    stored once: fitting reads them several times.
    """
    features = keep_table(basic(df, spec), "features")
    names = feature_names(features, spec)
    recent = tail(features, spec, training_rows) if training_rows else features
    if model_type in NEED_SPEC:
        params = {"spec": spec, **params}
    model = create_model(model_type, **params).fit(model_table(recent, spec, names), names, spec.target)
    return forecast(features, spec, model.transform, horizon, step, with_intervals, model.name, names)


def forecast_latest(df: DataFrame, spec: SeriesSpec, runs: DataFrame | None, model_type: str = "linear",
                    horizon: int = 24, step: str = "1 hour", with_intervals: bool = False, **options) -> DataFrame:
    """Forecast with the newest saved model of a type; train one only if there is none.

    ``runs`` is the table of trained models, as ``sources.store`` keeps it.
    """
    newest = latest_model(runs, model_type).first() if runs is not None else None
    if newest is None:
        return train_and_forecast(df, spec, model_type, horizon, step, with_intervals, **options)
    model = load_model(df.sparkSession, newest["path"])
    predict = model.predict_median if hasattr(model, "predict_median") else model.transform
    return forecast(basic(df, spec), spec, predict, horizon, step, with_intervals, model.name, model.feature_names)
