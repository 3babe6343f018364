"""Tables that may take the same rows again and corrected ones later, and hold one row for each."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.project import content_key
from ..session import keep_table

#: Columns of a merged table besides its own: folder, order of arrival, and what the row says.
DAY, ARRIVED, CONTENT = "_day", "_arrived", "_content"


def merge_rows(rows: DataFrame, path: str, identity: list[str], ts: str, arrived: int = 0) -> None:
    """Take ``rows`` into the Parquet table at ``path``, which has one row for each value of ``identity``.

    The row that arrived last stays; ``arrived`` orders the calls, and within one call the larger content key decides,
    so a call repeated after a failure changes nothing. Only the days that ``rows`` touch are read and replaced, all in
    one commit. Rows without a time stamp have no day and are left out. One writer at a time.
    """
    spark = rows.sparkSession
    values = [c for c in rows.columns if c not in identity]
    incoming = keep_table(rows.where(F.col(ts).isNotNull()).select(
        *rows.columns, F.to_date(ts).alias(DAY), F.lit(arrived).cast("long").alias(ARRIVED),
        content_key(**{c: F.col(c) for c in rows.columns}).alias(CONTENT)), "incoming")
    known = read_merged(spark, path, marks=True)
    if known is not None:
        days = F.broadcast(incoming.select(DAY).distinct())  # a row for each day touched; prunes the folders read
        incoming = known.join(days, DAY, "left_semi").select(incoming.columns).union(incoming)
    last = incoming.groupBy(*identity).agg(
        F.max_by(F.struct(*values, DAY, ARRIVED, CONTENT), F.struct(ARRIVED, CONTENT)).alias("_row"))
    kept = keep_table(last.select(*identity, "_row.*").select(incoming.columns), "merged")
    (kept.hint("rebalance", DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(DAY).parquet(path))


def read_merged(spark: SparkSession, path: str, marks: bool = False) -> DataFrame | None:
    """The table at ``path``, with its columns of bookkeeping if asked for; None if nothing was merged yet."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return found if marks else found.drop(DAY, ARRIVED, CONTENT)
