"""Token ids and masks in Arrow files of equal-length sequences, written in order of the documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from . import tokens
from .common import byte_texts, map_arrow, shared_folder, steps, stored

SEQUENCE = 2048
#: Sequences in a record batch of a file.
BATCH = 64
MANIFEST = "shard int, path string, docs_path string, n_docs bigint, n_tokens bigint"


def location(path: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a folder or file that Spark names, such as ``file:/x`` or ``hdfs://host/x``."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"/{path}")


class SequenceWriter:
    """Cuts a stream of ids into sequences of one length and writes them as fixed-size lists.

    Each record batch has a column of ids and one of masks, which are true for ids and false for what fills up the
    last sequence. Ids are stored as they lie in memory, without compression, so that a reader can map a file and
    look at any sequence without a copy.
    """

    def __init__(self, sink: pa.NativeFile, sequence: int, width: str) -> None:
        self.sequence, self.width = sequence, width
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(np.dtype(width)), sequence)),
                                 ("mask", pa.list_(pa.bool_(), sequence))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids.astype(self.width))
        self.size += len(ids)
        if self.size >= self.sequence * BATCH:
            flat = np.concatenate(self.waiting)
            whole = len(flat) // (self.sequence * BATCH) * self.sequence * BATCH
            for at in range(0, whole, self.sequence * BATCH):
                self._write(flat[at : at + self.sequence * BATCH], self.sequence * BATCH)
            self.waiting, self.size = [flat[whole:]], len(flat) - whole

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        self.writer.write_batch(pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (ids, mask)], schema=self.schema))

    def close(self) -> None:
        flat = np.concatenate(self.waiting) if self.waiting else np.zeros(0, self.width)
        if len(flat):
            full = -(-len(flat) // self.sequence) * self.sequence
            self._write(np.concatenate([flat, np.zeros(full - len(flat), self.width)]), len(flat))
        self.writer.close()


class SequenceReader:
    """Random access to the sequences of one file."""

    def __init__(self, path: str) -> None:
        system, name = location(path)
        local = isinstance(system, pa.fs.LocalFileSystem)
        self.reader = pa.ipc.open_file(pa.memory_map(name) if local else system.open_input_file(name))
        self.sequence = self.reader.schema.field("ids").type.list_size
        self.per_batch = self.sequence * BATCH
        self.number, self.found = -1, None

    def _ids(self, number: int) -> np.ndarray:
        """Ids of one record batch, a view of the file where it is mapped."""
        if number != self.number:
            self.number, self.found = number, self.reader.get_batch(number)
        return self.found.column(0).flatten().to_numpy(zero_copy_only=True)

    def sequence_at(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one sequence."""
        place = number % BATCH
        ids = self._ids(number // BATCH)[place * self.sequence : (place + 1) * self.sequence]
        return ids, self.found.column(1)[place].values.to_numpy(zero_copy_only=False)

    def ids(self, start: int, count: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` on, in views of one record batch at most."""
        while count:
            part = self._ids(start // self.per_batch)[start % self.per_batch :][:count]
            yield part
            start, count = start + len(part), count - len(part)


def write(docs: DataFrame, path: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text",
          spaced: bool = True, sequence: int = SEQUENCE) -> DataFrame:
    """Encode all texts, append ``end_id`` to each and write them to ``folder`` in ascending order of the id.

    Returns the stored manifest: a row per file with its place in the order, its path, that of the Arrow file of its
    documents (doc_id, start in this file, n_tokens), and counts. A file holds a range of ids and is written by one
    task under a name of its own; a task that is run again writes another file, and the manifest names those that
    count. Null texts count as empty; rows with the same id are ordered by their text; a null id comes first. An
    empty table gives an empty manifest.
    """
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path, spaced)
        width = "uint16" if encoder.vocabulary <= 1 << 16 else "uint32"
        context = TaskContext.get()
        system, place = location(folder)
        names = [f"{kind}-{context.partitionId():06d}-{context.taskAttemptId()}.arrow" for kind in ("ids", "docs")]
        sinks, total, count = [], 0, 0
        for some in steps(batches, 1, tokens.STEP_BYTES):
            if not sinks:
                system.create_dir(place, recursive=True)
                sinks = [system.open_output_stream(f"{place}/{n}") for n in names]
                sequences = SequenceWriter(sinks[0], sequence, width)
                schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                index = pa.ipc.new_file(sinks[1], schema)
            for part, ids, n in encoder.encoded(byte_texts(some.column(1))):
                rows = some.slice(part.start, part.stop - part.start)
                ids, n = tokens.end_each(ids, n, end_id)
                sequences.add(ids)
                index.write_batch(pa.RecordBatch.from_arrays(
                    [rows.column(0).cast(id_type), pa.array(total + np.cumsum(n) - n),
                     pa.array(n)], schema=schema))
                total, count = total + int(n.sum()), count + len(n)
        if sinks:
            sequences.close()
            index.close()
            for sink in sinks:
                sink.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([context.partitionId()], pa.int32()), *(pa.array([f"{folder}/{n}"]) for n in names),
                 pa.array([count]), pa.array([total])], [f.split()[0] for f in MANIFEST.split(", ")])

    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "t")
    return stored(map_arrow(ordered, run, MANIFEST), "manifest")


def read(manifest: DataFrame, kind: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    ``kind`` is the SQL type of the id. ``ids_crc32`` is over the ids as little-endian 32-bit numbers.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file, so the running sum is over few rows
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = SequenceReader(row["path"])
                system, name = location(row["docs_path"])
                with pa.ipc.open_file(system.open_input_file(name)) as index:
                    for number in range(index.num_record_batches):
                        found = index.get_batch(number)
                        sums = []
                        for start, n in zip(found.column(1).to_pylist(), found.column(2).to_pylist(), strict=True):
                            crc = 0
                            for part in reader.ids(start, n):
                                crc = zlib.crc32(part.astype("<u4"), crc)
                            sums.append(crc)
                        yield pa.RecordBatch.from_arrays(
                            [found.column(0), pa.array(found.column(1).to_numpy() + row["base"]), found.column(2),
                             pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = max(1, manifest.count())
    return map_arrow(placed.repartition(parts, "shard"), run,
                     f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def new_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share."""
    return shared_folder(spark, "ids")
