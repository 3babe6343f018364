"""Exact duplicates by a stateful stream whose keyed state never expires."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import shared_folder, stored
from .filters import bitmap_of, maybe_in

#: Parts into which the rows of a very frequent digest are dealt.
SALTS = 64
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": _ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # each partition has a store of its own, most of them small: no space set aside on disk
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # one bound for all state of an executor, whatever the number of partitions
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    """SHA-256 of a normalised text, in hexadecimal digits."""
    return F.sha2(text, 256)


@contextmanager
def _settings(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class ExactDedup:
    """Deduplicates a growing folder of Parquet files.

    The state of the stream lies on the executors' disks (RocksDB) and in ``checkpoint``. For each digest it keeps the
    smallest document id, the locator of that document's content (file and row) and the number of documents, and it
    keeps them for ever. Equal documents of one batch are combined before the shuffle, so a text that makes up a third
    of all rows sends one row per task to its key.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, checkpoint: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text", digest=sha256, files_per_batch: int = 10_000) -> None:
        self.spark, self.path, self.schema = spark, path, schema
        self.checkpoint = checkpoint or shared_folder(spark, "exact")
        self.id_col, self.text_col, self.digest = id_col, text_col, digest
        self.files_per_batch = files_per_batch

    def _rows(self, df: DataFrame) -> DataFrame:
        return (df.select(F.col(self.id_col).alias("doc_id"), normalised(F.col(self.text_col)).alias("content"),
                          F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
                .withColumn("digest", F.unhex(self.digest(F.col("content")))))

    def ingest(self) -> None:
        """Add the files that the stream has not seen yet to the state."""
        # as a pattern the path may be a single file too, which a stream does not take otherwise
        pattern = f"{self.path.rstrip('/')[:-1]}[{self.path.rstrip('/')[-1]}]"
        source = (self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.files_per_batch)
                  .parquet(pattern))
        grouped = self._rows(source).groupBy("digest").agg(
            F.min(F.struct("doc_id", "file", "row")).alias("first"), F.count("*").alias("group_size"))
        with _settings(self.spark):
            query = (grouped.writeStream.outputMode("update").format("noop").trigger(availableNow=True)
                     .option("checkpointLocation", self.checkpoint).start())
            query.awaitTermination()

    def state(self) -> DataFrame:
        """digest, first (doc_id, file, row) and group_size, read from the state store."""
        with _settings(self.spark):
            kept = self.spark.read.format("statestore").load(self.checkpoint)
        first, size = kept.schema["value"].dataType.names
        return kept.select(F.col("key.digest").alias("digest"), F.col(f"value.{first}").alias("first"),
                           F.col(f"value.{size}").alias("group_size"))

    def result(self) -> DataFrame:
        """One row per document: doc_id, keep_id, group_size, kept, digest (bytes).

        Of equal contents the row with the smallest (id, file, row) stays, a null id first. Rows that share a digest
        are compared byte by byte with the row that stays; those that differ form groups by their whole content.
        Null texts count as empty, repeated rows are duplicates, an empty table gives no rows.
        """
        table = stored(self.state(), "digests")
        rows = self._rows(self.spark.read.schema(self.schema).parquet(self.path))
        thin = stored(rows.select("doc_id", "file", "row", "digest"), "rows")
        place = F.struct("doc_id", "file", "row")
        grouped = thin.join(table, "digest")
        many = table.where("group_size > 1")
        hits = thin.select("file", "row", "digest").join(many.select("digest"), "digest", "left_semi")
        # whole contents are read again, but only those of rows in groups are normalised and shuffled
        again = maybe_in(self.spark.read.schema(self.schema).parquet(self.path)
                         .select(F.col(self.id_col).alias("doc_id"), F.col(self.text_col).alias("t"),
                                 F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")),
                         bitmap_of(hits, "file", "row"), "file", "row")
        content = again.withColumn("content", normalised(F.col("t"))).withColumn(
            "digest", F.unhex(self.digest(F.col("content")))).drop("t")
        # a digest with over a thousandth of all rows, of which there are under a thousand, is spread over salts
        hot = F.broadcast(many.where(F.col("group_size") > thin.count() / 1000).select("digest", F.lit(True).alias("hot")))
        zero, parts = F.lit(0).cast("bigint"), F.lit(SALTS).cast("bigint")
        salted = content.join(hot, "digest", "left").withColumn(
            "salt", F.when(F.col("hot"), F.pmod(F.xxhash64("file", "row"), parts)).otherwise(zero))
        salted = stored(salted, "contents")
        salts = F.when(F.col("hot"), F.sequence(zero, parts - 1)).otherwise(F.array(zero))
        first = (salted.join(many.select("first.file", "first.row"), ["file", "row"], "left_semi")
                 .select("digest", F.explode(salts).alias("salt"), F.col("content").alias("first_content")))
        differing = stored(salted.join(first, ["digest", "salt"]).where("content <> first_content")
                           .select("digest", "content", "doc_id", "file", "row"), "differing")
        if differing.isEmpty():
            return grouped.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
                                  (place == F.col("first")).alias("kept"), "digest")
        other = differing.groupBy("digest", "content").agg(F.min(place).alias("other"), F.count("*").alias("other_size"))
        moved = (differing.join(other, ["digest", "content"]).select("digest", "file", "row", "other", "other_size"))
        left = differing.groupBy("digest").agg(F.count("*").alias("gone"))
        full = grouped.join(moved, ["digest", "file", "row"], "left").join(left, "digest", "left")
        head = F.coalesce("other", "first")
        return full.select("doc_id", head["doc_id"].alias("keep_id"),
                           F.coalesce("other_size", F.col("group_size") - F.coalesce("gone", F.lit(0))).alias("group_size"),
                           (place == head).alias("kept"), "digest")


def exact_duplicates(spark: SparkSession, path: str, schema: StructType, **options) -> DataFrame:
    """Run the stream over all files of ``path`` and return ``ExactDedup.result``."""
    stream = ExactDedup(spark, path, schema, **options)
    stream.ingest()
    return stream.result()
