"""What a table holds: missing values, ranges, distributions, and whether it is usable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..series import SeriesSpec, epoch_us, without_nan
from .chunks import beside
from .fill import numeric_columns
from .quantiles import exact_quantiles
from .resample import detect_frequency


def completeness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing values per column, and the table's completeness in percent."""
    columns = columns or df.columns
    counts = without_nan(df, columns).agg(F.count("*").alias("_n"),
                    *[F.count_if(F.col(c).isNull()).alias(f"_m{i}") for i, c in enumerate(columns)])
    missing = [F.col(f"_m{i}") for i in range(len(columns))]
    total = sum(missing[1:], missing[0])
    overall = (1 - F.try_divide(total, F.col("_n") * len(columns))) * 100
    rows = F.array(*[F.struct(F.lit(c).alias("column"), m.alias("missing"))
                     for c, m in zip(columns, missing)])
    return counts.select("_n", overall.alias("completeness"), F.explode(rows).alias("r")).select(
        "r.column", "r.missing", F.col("_n").alias("n_rows"), "completeness")


def range_stats(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Rows, time range, real duration in hours and spread of the target, per series."""
    us = epoch_us(df, spec.ts)
    y = F.col(spec.target)
    return without_nan(df, [spec.target]).groupBy(*spec.keys).agg(
        F.count("*").alias("n_rows"),
        F.min(spec.ts).alias("start"), F.max(spec.ts).alias("end"),
        ((F.max(us) - F.min(us)) / F.lit(3.6e9)).alias("duration_hours"),
        F.min(y).alias("min_value"), F.max(y).alias("max_value"),
        F.avg(y).alias("mean_value"), F.stddev_samp(y).alias("std_value"))


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of each numeric column."""
    columns = columns or numeric_columns(df)
    df = without_nan(df, columns)
    aggregates = []
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        aggregates += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"s{i}"),
                       F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}")]
    rows = F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(f"n{i}").alias("count"), F.col(f"a{i}").alias("mean"),
        F.col(f"s{i}").alias("std"), F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max"))
        for i, c in enumerate(columns)])
    basic = df.agg(*aggregates).select(F.explode(rows).alias("r")).select("r.*")
    quartiles = exact_quantiles(df, columns, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return basic.join(quartiles, "column", "left")


def overview(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Shape, column types, time range in whole days and sampling step, per series."""
    us = epoch_us(df, spec.ts)
    days = F.call_function("div", F.max(us) - F.min(us), F.lit(86_400_000_000).cast("long"))
    stats = df.groupBy(*spec.keys).agg(
        F.count("*").alias("rows"), F.min(spec.ts).alias("start"), F.max(spec.ts).alias("end"),
        days.alias("duration_days"))
    types = F.lit(", ".join(f"{n} {t}" for n, t in df.dtypes))
    stats = stats.withColumns({"columns": F.lit(len(df.columns)), "data_types": types})
    step = detect_frequency(df, spec).select(*spec.keys, "frequency")
    return beside(stats, step, spec.keys)


def validate(df: DataFrame, required: list[str] | None = None, min_rows: int = 1) -> DataFrame:
    """One row: ``is_valid`` and the reasons when not.

    At most ``max(1, min_rows)`` rows are counted, however large the table is.
    """
    missing = sorted(set(required or []) - set(df.columns))
    needed = max(1, min_rows)
    seen = df.select(F.lit(1)).limit(needed).agg(F.count("*").alias("_n"))
    reasons = F.array_compact(F.array(
        F.when(F.col("_n") == 0, "empty"),
        F.when(F.col("_n").between(1, needed - 1), f"fewer than {needed} rows"),
        F.lit("missing columns: " + ", ".join(missing)) if missing else F.lit(None).cast("string")))
    return seen.select((F.size(reasons) == 0).alias("is_valid"), reasons.alias("reasons"))


def kpis(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Mean, extremes and sample deviation of a forecast."""
    return without_nan(df, [column]).groupBy(*(by or [])).agg(
        F.avg(column).alias("mean"), F.max(column).alias("max"),
        F.min(column).alias("min"), F.stddev_samp(column).alias("volatility"))
