"""Row-local projections and filters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..series import SeriesSpec, epoch_us, floor_div, step_us, without_nan
from .chunks import BUCKET, attach, bucket_us

# Names a target column may arrive under, the physical load limits in MW,
# the default time stamp format, and the width of a fixed forecast interval.
TARGET_CANDIDATES = ["consommation_mw", "consommation", "y"]
LOAD_LIMITS = (20000.0, 100000.0)
STAMP_FORMAT = "%Y%m%d_%H%M%S"
INTERVAL_SHARE = 0.1

_DIRECTIVES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD",
               "%y": "yy", "%f": "SSSSSS", "%p": "a", "%I": "hh", "%b": "MMM", "%B": "MMMM"}


def resolve_target(df: DataFrame, target: str = "y",
                   candidates: list[str] | None = None) -> DataFrame:
    """Rename the first candidate present to ``target``, replacing a column of that name."""
    found = next((c for c in candidates or TARGET_CANDIDATES if c in df.columns), None)
    if found is None:
        raise ValueError(f"no target column; expected one of {candidates or TARGET_CANDIDATES}")
    if found == target:
        return df
    return df.drop(target).withColumnRenamed(found, target)


def nan_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN means missing on arrival; columns that cannot hold it stay as they are."""
    return without_nan(df, columns)


def clip(column: Column | str, low: float = LOAD_LIMITS[0], high: float = LOAD_LIMITS[1]) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    return df.na.drop(subset=[column])


def select_features(df: DataFrame, target: str = "y", drop: list[str] | None = None) -> DataFrame:
    """Every column but the target and those named in ``drop``."""
    skip = {target, *(drop or [])}
    return df.select(*[c for c in df.columns if c not in skip])


def fill_constant(df: DataFrame, value: float = 0.0, columns: list[str] | None = None) -> DataFrame:
    return df.na.fill(value, subset=columns)


def format_timestamp(ts: Column | str, pattern: str = STAMP_FORMAT) -> Column:
    """Text form of a time stamp, by the usual percent directives."""
    parts = re.split(r"(%.)", pattern)
    unknown = [p for p in parts if p.startswith("%") and p not in _DIRECTIVES]
    if unknown:
        raise ValueError(f"unsupported directive {unknown[0]}")
    java = "".join(_DIRECTIVES.get(p, re.sub(r"([A-Za-z']+)", r"'\1'", p)) for p in parts)
    return F.date_format(ts, java)


def content_key(*columns: Column | str, **named: Column | str) -> Column:
    """md5 of the values joined by ``|``; named values follow by name as ``name:value``.

    Arrays, maps and structs enter as JSON. A missing value reads ``None``.
    """
    def text(c):
        c = F.col(c) if isinstance(c, str) else c
        return F.coalesce(c.cast("string"), F.lit("None"))

    parts = [text(c) for c in columns]
    parts += [F.concat(F.lit(f"{n}:"), text(c)) for n, c in sorted(named.items())]
    return F.md5(F.concat_ws("|", *parts))


def rounded(df: DataFrame, columns: list[str], places: int = 2) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def fixed_interval(yhat: Column | str, share: float = INTERVAL_SHARE) -> dict[str, Column]:
    """Bounds ``share`` below and above a forecast, ordered also for negative values."""
    c = F.col(yhat) if isinstance(yhat, str) else yhat
    a, b = c * F.lit(1 - share), c * F.lit(1 + share)
    return {"yhat_lower": F.least(a, b), "yhat_upper": F.greatest(a, b)}


def tail(df: DataFrame, spec: SeriesSpec, n: int) -> DataFrame:
    """The newest ``n`` rows of each series. On a grid they follow from its last time stamp."""
    if not spec.step:
        return newest_rows(df, spec, n)
    us = epoch_us(df, spec.ts)
    last = df.groupBy(*spec.keys).agg(F.max(us).alias("_end"))
    since = F.col("_end") - (n - 1) * step_us(spec.step)
    return attach(df, last, spec.keys).where(us >= since).drop("_end")


def newest_rows(df: DataFrame, spec: SeriesSpec, n: int) -> DataFrame:
    """The ``n`` rows with the latest time stamps of each series.

    Up to Spark's group limit every task keeps its best ``n`` per key before the shuffle.
    Beyond it the rows are first cut to the time buckets that can hold the newest ``n``.
    """
    down = [F.desc(c) for c in spec.order]
    if not spec.keys:
        return df.orderBy(*down).limit(n)
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    rows = df
    if n > limit:
        size = bucket_us(df, spec)
        rows = df.withColumn(BUCKET, floor_div(epoch_us(df, spec.ts), size))
        later = Window.partitionBy(*spec.keys).orderBy(F.desc(BUCKET)).rowsBetween(
            Window.unboundedPreceding, -1)
        needed = (rows.groupBy(*spec.keys, BUCKET).count()
                  .withColumn("_later", F.coalesce(F.sum("count").over(later), F.lit(0)))
                  .where(F.col("_later") < n).select(*spec.keys, BUCKET))
        rows = rows.join(needed, [*spec.keys, BUCKET], "left_semi")
    ranked = Window.partitionBy(*spec.keys).orderBy(*down)
    return (rows.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= n)
            .select(*df.columns))


def last_row(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """The newest row of each series, by an aggregate that combines before it shuffles."""
    others = [c for c in df.columns if c not in spec.keys]
    newest = F.max_by(F.struct(*others), spec.order_value).alias("_row")
    return df.groupBy(*spec.keys).agg(newest).select(*spec.keys, "_row.*").select(*df.columns)


def by_time(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Sorted by series and time, for sinks that want order."""
    return df.orderBy(*spec.keys, *spec.order)
