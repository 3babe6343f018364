"""Regular time grids: resampling with empty bins, future horizons, roll-ups, frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..series import DAY_US, SeriesSpec, epoch_us, floor_div, from_epoch_us, step_us, without_nan
from ..session import keep_table
from .chunks import BUCKET, ROWS_PER_BUCKET, attach, beside

BINS_PER_BLOCK = 65536

AGGREGATES = ("mean", "sum", "first", "last", "min", "max", "count")

# Names of the usual sampling steps, by their length in seconds.
STEP_NAMES = {900: "15min", 3600: "1h", 86400: "1d"}


def _aggregate(how: str, column: str, order: Column) -> Column:
    value = F.col(column)
    present = F.when(value.isNotNull(), order)
    if how == "mean":
        return F.avg(value)
    if how == "sum":
        return F.coalesce(F.sum(value), F.lit(0.0))
    if how == "first":
        return F.min_by(value, present)
    if how == "last":
        return F.max_by(value, present)
    if how == "min":
        return F.min(value)
    if how == "max":
        return F.max(value)
    if how == "count":
        return F.count(value)
    raise ValueError(f"unknown aggregate {how!r}; use one of {', '.join(AGGREGATES)}")


def resample(df: DataFrame, spec: SeriesSpec, step: str,
             how: str | dict[str, str] = "mean", fill_gaps: bool = True) -> DataFrame:
    """Aggregate each series into fixed bins, left-closed and labelled by their start.

    ``how`` is one aggregate for the target or a dict column -> aggregate. With
    ``fill_gaps`` every bin between the first and the last one of a series appears:
    sums and counts there are 0, everything else null. Bins of a size that does not
    divide a day start at midnight of the series' first day.

    The empty bins are added as rows without values before the one aggregation, so the
    data is combined per bin before its only shuffle and nothing is joined.
    """
    wanted = {spec.target: how} if isinstance(how, str) else dict(how)
    size = step_us(step)
    keys = list(spec.keys)
    us = epoch_us(df, spec.ts)
    raw = without_nan(df, list(wanted)).select(*keys, *dict.fromkeys([*spec.order, *wanted]), us.alias("_us"))
    raw = raw.where(F.col("_us").isNotNull())
    origin = _origin(size)
    ends = raw.groupBy(*keys).agg(F.min("_us").alias("_lo"), F.max("_us").alias("_hi"))
    if DAY_US % size:
        raw = attach(raw, ends.select(*keys, "_lo"), keys)
    raw = raw.withColumn("_start", origin + floor_div(F.col("_us") - origin, size) * size)
    values = [c for c in raw.columns if c not in (*keys, "_us", "_lo", "_start")]
    rows = raw.select(*keys, "_start", *values)
    if fill_gaps:
        blanks = _bin_starts(ends, keys, size, origin)
        types = {f.name: f.dataType for f in rows.schema.fields}
        rows = rows.unionByName(blanks.select(
            *keys, "_start", *[F.lit(None).cast(types[c]).alias(c) for c in values]))
    aggregates = [_aggregate(h, c, spec.order_value).alias(c) for c, h in wanted.items()]
    binned = rows.groupBy(*keys, "_start").agg(*aggregates)
    return binned.select(*keys, from_epoch_us(df, spec.ts, F.col("_start")).alias(spec.ts), *wanted)


def _origin(size: int) -> Column:
    """Where the bins of a series start to count: midnight of its first day, at ``_lo``, if they do not divide a day."""
    return floor_div(F.col("_lo"), DAY_US) * DAY_US if DAY_US % size else F.lit(0).cast("long")


def _bin_starts(ends: DataFrame, keys: list[str], size: int, origin: Column) -> DataFrame:
    """Every bin start between ``_lo`` and ``_hi``: first blocks of bins, spread over the
    cluster, then the bins of each block."""
    block = size * BINS_PER_BLOCK
    first = origin + floor_div(F.col("_lo") - origin, size) * size
    last = origin + floor_div(F.col("_hi") - origin, size) * size
    blocks = (ends.where(F.col("_lo").isNotNull())
              .select(*keys, first.alias("_first"), last.alias("_last"))
              .select(*keys, "_last", F.explode(F.sequence("_first", "_last", F.lit(block))).alias("_from"))
              .repartition(*keys, "_from"))
    until = F.least(F.col("_last"), F.col("_from") + (block - size))
    return blocks.select(*keys, F.explode(F.sequence("_from", until, F.lit(size).cast("long"))).alias("_start"))


def spine(df: DataFrame, spec: SeriesSpec, step: str) -> DataFrame:
    """The time stamps of the gap-free grid each series spans, without values: the bins of ``resample``."""
    us = epoch_us(df, spec.ts)
    ends = df.groupBy(*spec.keys).agg(F.min(us).alias("_lo"), F.max(us).alias("_hi"))
    starts = _bin_starts(ends, list(spec.keys), step_us(step), _origin(step_us(step)))
    return starts.select(*spec.keys, from_epoch_us(df, spec.ts, F.col("_start")).alias(spec.ts))


def on_spine(df: DataFrame, spec: SeriesSpec, step: str) -> DataFrame:
    """Put the rows of a series on its gap-free grid; missing stamps get null values.

    A row off the grid is an error, as no place on it is its own: ``resample`` bins such rows. Rows without a
    time stamp are left out.
    """
    size, keys = step_us(step), list(spec.keys)
    rows = df.withColumn("_us", epoch_us(df, spec.ts)).where(F.col("_us").isNotNull())
    if DAY_US % size:
        rows = attach(rows, rows.groupBy(*keys).agg(F.min("_us").alias("_lo")), keys)
    on_grid = F.pmod(F.col("_us") - _origin(size), F.lit(size).cast("long")) == 0
    stamp = F.when(on_grid, F.col(spec.ts)).otherwise(
        F.raise_error(F.lit(f"rows lie off the grid of {step}; resample them first")))
    checked = rows.withColumn(spec.ts, stamp).select(*df.columns)
    return spine(df, spec, step).join(checked, [*keys, spec.ts], "left")


def horizon_steps(horizon: int, unit: str = "hours", most: dict[str, int] | None = None) -> int:
    """Length of a forecast in hourly steps, given in hours or days; ``most`` may limit either."""
    factors = {"hours": 1, "days": 24}
    if unit not in factors:
        raise ValueError(f"unit must be hours or days, not {unit!r}")
    limit = (most or {}).get(unit)
    if horizon < 1 or (limit is not None and horizon > limit):
        raise ValueError(f"horizon must be at least 1{f' and at most {limit}' if limit else ''} {unit}")
    return horizon * factors[unit]


def future(last: DataFrame, spec: SeriesSpec, horizon: int, step: str = "1 hour") -> DataFrame:
    """Repeat each row ``horizon`` times with the time stamps that follow its own.

    Adds ``horizon_step`` counting from 1. A row-local expansion: nothing is shuffled.
    """
    ahead = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("horizon_step")
    us = epoch_us(last, spec.ts) + F.col("horizon_step").cast("long") * step_us(step)
    wide = last.select("*", ahead)
    return wide.withColumn(spec.ts, from_epoch_us(last, spec.ts, us))


def rollup(df: DataFrame, spec: SeriesSpec, granularity: str, columns: list[str]) -> DataFrame:
    """Daily or hourly mean of forecast columns for display."""
    steps = {"daily": "1 day", "hourly": "1 hour"}
    if granularity not in steps:
        raise ValueError(f"granularity must be daily or hourly, not {granularity!r}")
    return resample(df, spec, steps[granularity], {c: "mean" for c in columns})


def _stamps(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Distinct time stamps of each series with their number of rows, stored; a null stamp counts too."""
    return keep_table(df.groupBy(*spec.keys, epoch_us(df, spec.ts).alias("_us")).agg(F.count("*").alias("_n")), "stamps")


def _gaps(stamps: DataFrame, keys: list[str], rows_per_range: int) -> DataFrame:
    known = stamps.where(F.col("_us").isNotNull())
    parts = -(-max(known.count(), 1) // rows_per_range)
    if parts > 1:
        ranged = keep_table(known.repartitionByRange(parts, *keys, "_us")
                            .withColumn(BUCKET, F.spark_partition_id()), "ranges")
    else:
        ranged = known.withColumn(BUCKET, F.lit(0))
    one = F.lit(1).cast("long").alias("n")
    within = Window.partitionBy(*keys, BUCKET).orderBy("_us")
    inner = ranged.select(*keys, (F.col("_us") - F.lag("_us").over(within)).alias("gap_us"), one)
    found = inner.unionByName(known.where("_n > 1").select(
        *keys, F.lit(0).cast("long").alias("gap_us"), (F.col("_n") - 1).alias("n")))
    if parts > 1:
        across = Window.partitionBy(*keys).orderBy(BUCKET)
        ends = ranged.groupBy(*keys, BUCKET).agg(F.min("_us").alias("_lo"), F.max("_us").alias("_hi"))
        found = found.unionByName(ends.select(*keys, (F.col("_lo") - F.lag("_hi").over(across)).alias("gap_us"), one))
    return found.where(F.col("gap_us").isNotNull()).groupBy(*keys, "gap_us").agg(F.sum("n").alias("n"))


def successive_gaps(df: DataFrame, spec: SeriesSpec, rows_per_range: int = ROWS_PER_BUCKET) -> DataFrame:
    """How often (``n``) each gap in microseconds (``gap_us``) lies between neighbouring rows of a series.

    Rows of one time stamp are counted before anything is shuffled, so a burst on a stamp is one row. The distinct
    stamps are dealt into ranges of their order; a gap inside a range comes from a window over the range, a gap
    across from the first and last stamps of the ranges. ``df`` is read once.
    """
    return _gaps(_stamps(df, spec), list(spec.keys), rows_per_range)


def detect_frequency(df: DataFrame, spec: SeriesSpec, rows_per_range: int = ROWS_PER_BUCKET) -> DataFrame:
    """Most common gap of each series (ties: the smallest) and its name.

    Series of fewer than two rows are ``unknown``; a step without a usual name is
    ``custom_<seconds>s``.
    """
    keys = list(spec.keys)
    stamps = _stamps(df, spec)
    mode = _gaps(stamps, keys, rows_per_range).groupBy(*keys).agg(
        F.max_by("gap_us", F.struct(F.col("n"), -F.col("gap_us"))).alias("gap_us"))
    present = stamps.groupBy(*keys).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"))
    both = beside(present, mode, keys)
    seconds = F.col("gap_us") / F.lit(1e6)
    whole = F.col("gap_us") % 1_000_000 == 0
    text = F.when(whole, (seconds.cast("long")).cast("string")).otherwise(
        F.format_string("%.6f", seconds))
    name = F.when(F.col("gap_us").isNull(), "unknown")
    for length, label in STEP_NAMES.items():
        name = name.when(F.col("gap_us") == length * 1_000_000, label)
    return both.select(*keys, "n_rows", "gap_us",
                       name.otherwise(F.concat(F.lit("custom_"), text, F.lit("s"))).alias("frequency"))
