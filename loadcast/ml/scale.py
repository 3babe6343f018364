"""Scaling features by robust or standard statistics, per series or over all rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chunks import attach
from ..operators.quantiles import exact_quantiles


@dataclass
class FittedScaler:
    """``stats`` has the keys and, per column, its centre and scale."""

    columns: list[str]
    keys: list[str]
    stats: DataFrame

    def transform(self, df: DataFrame) -> DataFrame:
        joined = attach(df, self.stats, self.keys)
        scaled = {c: (F.col(c) - F.col(f"_center_{c}")) / F.col(f"_scale_{c}") for c in self.columns}
        return joined.withColumns(scaled).select(*df.columns)


class Scaler:
    """``robust``: median and interquartile range; ``standard``: mean and population deviation.

    A column without spread is only centred.
    """

    def __init__(self, kind: str = "robust"):
        if kind not in ("robust", "standard"):
            raise ValueError(f"scaler must be robust or standard, not {kind!r}")
        self.kind = kind

    def fit(self, df: DataFrame, columns: list[str], keys: tuple[str, ...] | list[str] = ()) -> FittedScaler:
        keys = list(keys)
        if self.kind == "standard":
            raw = df.groupBy(*keys).agg(*[e for c in columns for e in (
                F.avg(c).alias(f"_center_{c}"), F.stddev_pop(c).alias(f"_scale_{c}"))])
        else:
            q = exact_quantiles(df, columns, {"low": 0.25, "mid": 0.5, "high": 0.75}, keys)
            raw = q.groupBy(*keys).agg(*[e for c in columns for e in (
                F.max(F.when(F.col("column") == c, F.col("mid"))).alias(f"_center_{c}"),
                F.max(F.when(F.col("column") == c, F.col("high") - F.col("low"))).alias(f"_scale_{c}"))])
        stats = raw.select(*keys, *[e for c in columns for e in (
            F.col(f"_center_{c}"),
            F.when(F.col(f"_scale_{c}") == 0, 1.0).otherwise(F.col(f"_scale_{c}")).alias(f"_scale_{c}"))])
        return FittedScaler(list(columns), keys, stats)
