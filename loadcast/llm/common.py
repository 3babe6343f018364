"""Batches of whole texts for operators that work on Arrow data, and tables kept between jobs."""

from __future__ import annotations

import ctypes
import os
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from itertools import count
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import shared_folder

#: Bytes of text that one step of an Arrow operator works on; a longer single text forms a step alone.
STEP_BYTES = 4_000_000
#: Rows of an Arrow batch between Spark and its Python workers.
BATCH_ROWS = 1_000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def steps(batches: Iterator[pa.RecordBatch], place: int, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts, in column ``place``, have about ``limit`` bytes; one text at least."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False))
        start = before = 0
        while start < len(ends):
            stop = int(np.searchsorted(ends, before + limit - size, side="right"))
            if stop == start and not size:
                stop += 1  # a single text over the limit
            if stop > start:
                waiting.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1]) - before
                start, before = stop, int(ends[stop - 1])
            if start < len(ends) or size >= limit:
                yield _joined(waiting)
                waiting, size = [], 0
    if waiting:
        yield _joined(waiting)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def numbered(words: Sequence) -> tuple[np.ndarray, list]:
    """A number for each word, equal for equal words, and the distinct words in that order."""
    seen: defaultdict = defaultdict(count().__next__)
    return np.fromiter(map(seen.__getitem__, words), np.int64, len(words)), list(seen)


def map_arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` whose workers look for this package where the driver has it, besides their own path.

    Rows hold whole texts, so the session's Arrow batches are limited to ``BATCH_ROWS`` of them; workers put them
    together again as they need. A worker outlives its task; at the end of each task it gives back the memory that is
    kept for reuse, which other tasks of the executor may need.
    """
    conf = df.sparkSession.conf
    if int(conf.get(_BATCH_ROWS)) > BATCH_ROWS or int(conf.get(_BATCH_ROWS)) <= 0:
        conf.set(_BATCH_ROWS, str(BATCH_ROWS))
    environment, root = df.sparkSession.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(tidy, schema)


def give_back() -> None:
    """Return unused memory of the Arrow pool and of the C library to the system, where they can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_texts(df: DataFrame, id_col: str, text_col: str, work: Callable, fields: str) -> DataFrame:
    """One result row per input row: the id as ``doc_id`` and the columns that ``work`` makes of the texts.

    ``work`` takes a list of byte texts and returns equally long arrays in the order of ``fields``.
    Other columns of ``df`` are not read, so their names cannot clash.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in steps(batches, 1):
            yield pa.RecordBatch.from_arrays([rows.column(0), *map(pa.array, work(byte_texts(rows.column(1))))],
                                             ["doc_id", *[f.split()[0] for f in fields.split(", ")]])

    return map_arrow(rows, run, f"doc_id {kind}, {fields}")


def filter_texts(df: DataFrame, text_col: str, keep: Callable) -> DataFrame:
    """The rows of ``df`` whose text ``keep`` accepts, with every column, in one pass without a shuffle.

    ``keep`` takes a list of byte texts and returns a list or array of booleans. Columns are handled by
    position, so repeated or odd names do no harm.
    """
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in steps(batches, place):
            yield rows.filter(pa.array([bool(x) for x in keep(byte_texts(rows.column(place)))], pa.bool_()))

    return map_arrow(df, run, df.schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and safe from lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bits(column: Column | str, mask: int) -> Column:
    """``column & mask`` for a 64-bit mask given as an unsigned number."""
    return F.col(column).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)) if isinstance(column, str) \
        else column.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
