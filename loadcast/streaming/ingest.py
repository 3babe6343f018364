"""Continuous ingest: landed record files become typed Parquet as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.merge import merge_rows
from ..sources.records import TIME_FIELD, parse_records

_LINE = "_line"


def record_stream(spark: SparkSession, path: str, files_per_batch: int = 1000, keep: list[str] | None = None) -> DataFrame:
    """Stream of parsed records from JSON-lines files appearing under ``path``; column ``_line`` is the line's md5."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(path)
    return parse_records(lines.withColumn(_LINE, F.md5("value")), keep=keep)


def ingest(spark: SparkSession, source: str, sink: str, checkpoint: str,
           late_by: str | None = None, interval: str | None = None) -> StreamingQuery:
    """Append records to Parquet exactly once; ``checkpoint`` remembers what was read.

    Without ``interval`` all files present are taken and the query ends. With ``late_by`` equal records within that
    delay are written once; records that share a time stamp alone are all kept.
    """
    stream = record_stream(spark, source, keep=[_LINE] if late_by else None)
    if late_by:
        stream = (stream.withWatermark(TIME_FIELD, late_by)
                  .dropDuplicatesWithinWatermark([TIME_FIELD, _LINE]).drop(_LINE))
    writer = (stream.writeStream.format("parquet").option("path", sink)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    return _started(writer, interval)


def ingest_merged(spark: SparkSession, source: str, sink: str, checkpoint: str, identity: list[str] | None = None,
                  interval: str | None = None) -> StreamingQuery:
    """Records as a table with one row for each ``identity``, the time stamp by default.

    A file landed twice adds nothing and a corrected record replaces the one before, however much later it comes.
    A batch repeated after a failure has the same number and so the same result.
    """
    def take(batch: DataFrame, number: int) -> None:
        merge_rows(batch, sink, identity or [TIME_FIELD], TIME_FIELD, number)

    writer = record_stream(spark, source).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return _started(writer, interval)


def _started(writer, interval: str | None) -> StreamingQuery:
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
