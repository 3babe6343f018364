"""Complete feature sets for forecasting, composed of the single operators.

All look-back columns of a set are one projection over one chunk layout: one shuffle and
one sort, however many columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import ewma, windows as win
from ..operators.chunks import CHUNK, POS, Chunks, with_position
from ..operators.fill import fill, handle_missing, numeric_columns
from ..operators.project import drop_missing, fill_constant, resolve_target
from ..series import SeriesSpec, add, q

COMPACT_SIZE = 15
COMPACT_MEAN_WINDOWS = [24, 168]
COMPACT_STD_WINDOW = 24


def _prepared(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Resolved target and, off the grid, counted row positions."""
    df = resolve_target(df, spec.target)
    df = df.withColumn(spec.target, F.col(spec.target).cast("double"))
    return df if spec.step else with_position(df, spec)


def _measured(df: DataFrame, spec: SeriesSpec) -> list[str]:
    """Numeric source columns, the target among them."""
    return numeric_columns(df, (*spec.keys, *spec.order, POS, CHUNK))


def basic(df: DataFrame, spec: SeriesSpec, bfill: bool = True, tz: str | None = None,
          rows_per_chunk: int | None = None) -> DataFrame:
    """35 features: calendar, lags, rolling mean and deviation, weighted means.

    Look-back columns come from the target as observed, before gaps are filled.
    """
    y = spec.target
    df = _prepared(df, spec)
    source = [c for c in df.columns if c != POS]
    measured = _measured(df, spec)
    halo = max(*win.BASIC_LAGS, *win.BASIC_WINDOWS, ewma.halo_rows(ewma.BASIC_ALPHAS))
    c = Chunks(df.withColumns(cal.temporal(spec.ts, tz)), spec, halo, rows_per_chunk)
    lags = win.lag_columns(c, y, win.BASIC_LAGS)
    look_back = [*lags, *win.moment_names(y, win.BASIC_WINDOWS)]
    frame = win.add_moments(add(c.frame, lags), c, y, win.BASIC_WINDOWS)
    frame = ewma.add_ewma(frame, c, y, ewma.BASIC_ALPHAS)
    means = [ewma.ewma_name(y, a) for a in ewma.BASIC_ALPHAS]
    features = c.settle(frame, keep_chunk=True)
    filled = handle_missing(features, spec, [*measured, *look_back, *means], bfill=bfill)
    ordered = [*source, *cal.temporal(spec.ts), *look_back, *means]
    return drop_missing(filled, y).select(*ordered)


def advanced_windows(df: DataFrame, spec: SeriesSpec,
                     rows_per_chunk: int | None = None) -> DataFrame:
    """Lags, rolling statistics, z-scores, weighted means, differences and changes."""
    filled = df.withColumn("_filled", F.col(spec.target))
    filled = fill(filled, spec, ["_filled"], backward=False, rows_per_chunk=rows_per_chunk)
    c = Chunks(filled, spec, _advanced_halo(), rows_per_chunk)
    frame, names = _advanced(c, spec.target, "_filled", statistics=False)
    means = [ewma.ewma_name(spec.target, a) for a in ewma.ADVANCED_ALPHAS]
    settled = fill(c.settle(frame, keep_chunk=True), spec, means, backward=False)
    return settled.select(*df.columns, *names)


def _advanced_halo() -> int:
    return max(*win.ADVANCED_LAGS, *win.ADVANCED_WINDOWS, ewma.halo_rows(ewma.ADVANCED_ALPHAS))


def _advanced(c: Chunks, y: str, filled: str, statistics: bool) -> tuple[DataFrame, list[str]]:
    """The advanced look-back columns on a chunked frame, and their names in order.

    The quartiles of a window are computed once; its median and the distribution columns
    of ``statistics`` read from that one array.
    """
    first = {**win.lag_columns(c, y, win.ADVANCED_LAGS),
             **win.difference_columns(c, y, win.DIFFERENCES),
             **win.change_columns(c, y, win.DIFFERENCES, filled)}
    quartiles = win.quantile_columns(c, y, win.ADVANCED_WINDOWS)
    frame = add(c.frame, {**first, **quartiles})
    frame = win.add_moments(frame, c, y, win.ADVANCED_WINDOWS, extremes=True)
    moments = [*win.moment_names(y, win.ADVANCED_WINDOWS), *win.extreme_names(y, win.ADVANCED_WINDOWS)]
    second = {**win.median_columns(y, win.ADVANCED_WINDOWS),
              **win.zscore_columns(y, win.ADVANCED_WINDOWS)}
    if statistics:
        second |= win.quartile_columns(y, win.STATISTIC_WINDOWS)
        second |= win.percentile_columns(y, win.STATISTIC_WINDOWS)
    frame = add(frame, second).drop(*quartiles)
    frame = ewma.add_ewma(frame, c, y, ewma.ADVANCED_ALPHAS)
    means = [ewma.ewma_name(y, a) for a in ewma.ADVANCED_ALPHAS]
    return frame, [*first, *moments, *second, *means]


def comprehensive(df: DataFrame, spec: SeriesSpec, bfill: bool = True, tz: str | None = None,
                  rows_per_chunk: int | None = None) -> DataFrame:
    """114 features: the basic and advanced sets, interactions, Fourier terms, statistics.

    The look-back columns come from the filled target.
    """
    y = spec.target
    df = _prepared(df, spec)
    source = [c for c in df.columns if c != POS]
    measured = _measured(df, spec)
    df = handle_missing(df, spec, measured, bfill=bfill, rows_per_chunk=rows_per_chunk)
    calendar = {**cal.temporal(spec.ts, tz), **cal.advanced(spec.ts)}
    df = df.withColumns(calendar)
    if spec.step:
        df = with_position(df, spec)
    waves = cal.fourier(F.col(POS))
    df = df.withColumns(waves)
    c = Chunks(df, spec, _advanced_halo(), rows_per_chunk)
    frame, look_back = _advanced(c, y, y, statistics=True)
    joint = cal.interactions(frame.columns)
    frame = frame.withColumns(joint)
    # The target has no gaps here, so these lack values only in a series' first rows, and
    # those lie in its first chunk: positions count from the start of the series.
    late = [n for n in [*look_back, *joint]
            if any(p in n for p in ("_lag_", "_std_", "_zscore_", "_diff_", "_percentile_", "lag1_", "lag24_"))]
    head = f", first_value({{0}}) IGNORE NULLS {c.whole()}" if bfill else ""
    frame = add(frame, {n: f"coalesce({q(n)}{head.format(q(n))}, 0D)" for n in late})
    changes = [n for n in look_back if "_pct_change_" in n]
    full = fill(c.settle(frame, keep_chunk=True), spec, changes, backward=bfill, constant=0.0)
    return drop_missing(full, y).select(*source, *calendar, *look_back, *joint, *waves)


def compact(df: DataFrame, spec: SeriesSpec, max_features: int = COMPACT_SIZE,
            rows_per_chunk: int | None = None) -> DataFrame:
    """At most ``max_features`` features, the first ones in order; nulls filled forward, then 0."""
    y = spec.target
    df = _prepared(df, spec)
    identity = [*spec.keys, *spec.order]
    extra = [c for c in df.columns if c not in (*identity, y, POS)]
    measured = _measured(df, spec)
    t = cal.temporal(spec.ts)
    hour = F.hour(spec.ts)
    simple = {n: t[n] for n in ("hour", "day_of_week", "month", "is_weekend", "hour_sin", "hour_cos")}
    simple["is_peak_hour"] = hour.isin(cal.COMPACT_PEAK_HOURS).cast("int")
    simple["weekend_evening"] = (cal.is_weekend(F.col(spec.ts)) & (hour > 18)).cast("int")
    halo = max(*win.COMPACT_LAGS, *COMPACT_MEAN_WINDOWS)
    c = Chunks(df.withColumns(simple), spec, halo, rows_per_chunk)
    rolling = [f"{y}_rolling_mean_{w}" for w in COMPACT_MEAN_WINDOWS] + [f"{y}_rolling_std_{COMPACT_STD_WINDOW}"]
    lags = win.lag_columns(c, y, win.COMPACT_LAGS)
    look_back = [*lags, *rolling]
    frame = win.add_moments(add(c.frame, lags), c, y, COMPACT_MEAN_WINDOWS)
    frame = c.settle(frame, keep_chunk=True)
    full = fill(frame, spec, [*measured, *look_back], backward=False, constant=0.0)
    order = [*extra, "hour", "day_of_week", "month", "is_weekend", *look_back,
             "hour_sin", "hour_cos", "is_peak_hour", "weekend_evening"]
    return full.select(*identity, y, *order[:max_features])


def feature_names(features: DataFrame, spec: SeriesSpec) -> list[str]:
    """Model inputs: every numeric column besides identity and target."""
    return numeric_columns(features, (*spec.keys, *spec.order, spec.target))


def model_table(features: DataFrame, spec: SeriesSpec, names: list[str] | None = None) -> DataFrame:
    """Identity, target and inputs with the remaining nulls set to 0, ready to train on."""
    names = names or feature_names(features, spec)
    return fill_constant(features.select(*spec.keys, *spec.order, spec.target, *names), 0.0, names)
