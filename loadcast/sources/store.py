"""Reports, forecasts and the table of trained models."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY_SCHEMA = "model_type string, name string, path string, trained_at timestamp"


def write_report(df: DataFrame, path: str) -> None:
    """A result table as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Read a report back; name its schema to skip the inference pass."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def write_forecasts(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Forecasts as Parquet. Rows are gathered per partition value first, so that each
    folder gets few files; a large one is split by adaptive execution."""
    if partition_by:
        df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def register_model(spark: SparkSession, registry: str, model_type: str, name: str, path: str,
                   trained_at: dt.datetime) -> None:
    """Append one line to the table of trained models."""
    row = spark.createDataFrame([(model_type, name, path, trained_at)], REGISTRY_SCHEMA)
    row.coalesce(1).write.mode("append").parquet(registry)


def read_registry(spark: SparkSession, registry: str) -> DataFrame:
    return spark.read.schema(REGISTRY_SCHEMA).parquet(registry)


def latest_model(registry: DataFrame, model_type: str | None = None) -> DataFrame:
    """Path of the newest model whose type contains ``model_type``; no row if there is none."""
    rows = registry if model_type is None else registry.where(F.col("model_type").contains(model_type))
    newest = F.struct("trained_at", "path")
    return rows.agg(F.max_by("path", newest).alias("path"), F.max("trained_at").alias("trained_at"),
                    F.max_by("model_type", newest).alias("model_type")).where(F.col("path").isNotNull())
