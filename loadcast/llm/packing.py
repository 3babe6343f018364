"""Packing of documents into training sequences with lexically related neighbours, by sharded BM25 retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from . import tokens
from .common import byte_texts, map_arrow, steps, stored

WINDOW = 4096
#: Tokens of the documents that one inverted index holds; neighbours come from the same shard.
SHARD_TOKENS = 1 << 21
#: Passes over all documents that fit the routing to shards, and tokens that one task of a pass reads, about.
ROUNDS, ROUND_TOKENS = 5, 1 << 25
#: Documents that may be the first pivots.
STARTS = 256
#: Weights in a pass are whole numbers, so that their sums do not depend on the order of the rows.
WHOLE = 1 << 16
#: Pivots of the routing, how many of them, nearest first, make a route, and how many of these count tokens.
PIVOTS, ROUTE, PREFIX = 16, 8, 4
#: Tokens of the documents that one task packs, about; only its last sequence may be short.
TASK_TOKENS = 1 << 23
#: Terms of a seed that are looked up: those with the largest weight in it.
QUERY_TERMS = 32
K1, B = 1.2, 0.75
PIECES = ("doc_id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
          "ids binary")


def pivots(docs: DataFrame, text_col: str, path: str) -> np.ndarray:
    """One row per id of the vocabulary, one column per pivot: what the id adds to a document's closeness to it."""
    made = stored(tokenised(docs.withColumn("doc_id", F.lit(0)), "doc_id", text_col, path, 0), "tokens")
    n_docs, n_tokens = made.agg(F.count("*"), F.sum("n")).first()
    vocabulary = tokens.encoder(path, False).vocabulary
    return fitted(made, document_frequencies(made, vocabulary), n_docs, n_tokens or 0)


def fitted(table: DataFrame, counts: np.ndarray, n_docs: int, n_tokens: int, rounds: int = ROUNDS) -> np.ndarray:
    """The pivots of ``tokenised`` documents: means of all of them as vectors of inverse document frequencies.

    Spherical k-means: each round is a pass over all documents, in which tasks add up the weights of the ids by nearest
    pivot. One row of sums per id of the vocabulary comes back, whatever the corpus. The first pivots are documents far
    from each other among those with the smallest hashes of their ids; they are replaced in the first round. An id that
    all documents hold counts nothing. Similar pivots get neighbouring numbers. Neither the order of the rows nor how
    they are partitioned matters.
    """
    vocabulary = len(counts)
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"
    idf = np.where((counts > 0) & (counts < n_docs), np.log1p((n_docs - counts + 0.5) / (counts + 0.5)), 0)
    means = _first_pivots(table, idf, width)
    if not means.any():
        return np.zeros((vocabulary, PIVOTS), np.float32)
    spark = table.sparkSession
    # few tasks, as each returns a row per id
    tasks = max(spark.sparkContext.defaultParallelism, -(-n_tokens // ROUND_TOKENS))
    names = [f"s{j}" for j in range(PIVOTS)]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(((means * idf[:, None]).astype(np.float32), idf))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pivot, idf = shared.value
            total = np.zeros(vocabulary * PIVOTS)
            for batch in batches:
                held = _arrays(batch.column(0), width)
                nearest = _closeness(held, pivot).argmax(1)
                owner, flat, weight = _weights(held, idf)
                total += np.bincount(flat * PIVOTS + nearest[owner], np.rint(weight * WHOLE), vocabulary * PIVOTS)
            total = total.reshape(-1, PIVOTS)
            some = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some), *(pa.array(total[some, j].astype(np.int64)) for j in range(PIVOTS))], ["id", *names])

        fields = ", ".join(f"{name} bigint" for name in ("id", *names))
        found = map_arrow(table.select("distinct").coalesce(tasks), run, fields)
        sums = found.groupBy("id").agg(*(F.sum(name).alias(name) for name in names)).toArrow()
        shared.unpersist()
        fresh = np.zeros((vocabulary, PIVOTS))
        fresh[sums.column("id").to_numpy()] = np.stack([sums.column(name).to_numpy() for name in names], axis=1)
        size = np.sqrt((fresh * fresh).sum(0))
        # a pivot that is nearest to no document stays as it is
        means = np.where(size > 0, fresh / np.maximum(size, 1e-9), means)
    alike = means.T @ means
    centred = alike - alike.mean(0) - alike.mean(1)[:, None] + alike.mean()
    order = np.argsort(np.linalg.eigh(centred)[1][:, -1], kind="stable")
    return (means[:, order] * idf[:, None]).astype(np.float32)


def _weights(held: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the document, id and weight for each id of each document; a document's weights have length 1."""
    sizes = np.fromiter(map(len, held), np.int64, len(held))
    flat = np.concatenate(held).astype(np.int64)
    owner, first = np.repeat(np.arange(len(held)), sizes), np.cumsum(sizes) - sizes
    weight = idf[flat]
    return owner, flat, weight / np.maximum(np.sqrt(np.add.reduceat(weight * weight, first)), 1e-9)[owner]


def _first_pivots(table: DataFrame, idf: np.ndarray, width: str) -> np.ndarray:
    """Up to ``PIVOTS`` different documents as columns, each the farthest from those before it."""
    rows = table.select(F.xxhash64("distinct").alias("h"), "distinct")
    # equal documents count once; their hashes alone are shuffled
    least = rows.select("h").distinct().orderBy("h").limit(STARTS)
    some = rows.join(F.broadcast(least), "h").groupBy("h").agg(F.min("distinct").alias("ids")).orderBy("h").collect()
    means = np.zeros((len(idf), PIVOTS))
    held = [x for x in (np.frombuffer(r.ids, width) for r in some) if idf[x].any()]
    if not held:
        return means
    owner, flat, weight = _weights(held, idf)
    near, j = np.full(len(held), -1.0), 0
    for k in range(PIVOTS):
        means[flat[owner == j], k] = weight[owner == j]
        near = np.maximum(near, np.bincount(owner, means[flat, k] * weight, len(held)))
        near[j] = np.inf
        j = int(near.argmin())
        if near[j] > 1 - 1e-9:
            break
    return means


def _closeness(held: list[np.ndarray], pivot: np.ndarray) -> np.ndarray:
    """Of each document to each pivot; ``held``: its distinct ids."""
    first = np.cumsum([0] + [len(x) for x in held[:-1]])
    return np.add.reduceat(pivot[np.concatenate(held)], first, axis=0)


def routes(held: list[np.ndarray], pivot: np.ndarray) -> np.ndarray:
    """The nearest pivots of each document, nearest first, as digits of one number; ``held``: its distinct ids."""
    best = np.argsort(-_closeness(held, pivot), axis=1, kind="stable")[:, :ROUTE].astype(np.int64)
    return best @ (PIVOTS ** np.arange(ROUTE - 1, -1, -1, dtype=np.int64))


def routed(table: DataFrame, pivot: np.ndarray) -> DataFrame:
    """``tokenised`` documents with their route."""
    shared = table.sparkSession.sparkContext.broadcast(pivot)
    width = "<u2" if len(pivot) <= 1 << 16 else "<u4"
    at = table.columns.index("distinct")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array(routes(_arrays(batch.column(at), width), shared.value))
            yield batch.remove_column(at).append_column("route", made)

    fields = [field for field in table.schema.fields if field.name != "distinct"]
    return map_arrow(table, run, StructType([*fields, StructField("route", LongType())]))


def tokenised(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int, spaced: bool = False,
              pivot: np.ndarray | None = None) -> DataFrame:
    """doc_id, n (ids with the end id), ids (little-endian, 16 bits if the vocabulary allows, else 32), distinct and held.

    ``distinct`` has the different ids in ascending order, ``held``, in some of the rows, how many documents of a batch
    hold each id. With pivots there is ``route`` in place of ``distinct``.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path, spaced)
        width = "<u2" if encoder.vocabulary <= 1 << 16 else "<u4"
        for some in steps(batches, 1, tokens.STEP_BYTES):
            for part, ids, n in encoder.encoded(byte_texts(some.column(1))):
                rows = some.slice(part.start, part.stop - part.start)
                ids, n = tokens.end_each(ids, n, end_id)
                small = ids.astype(width)
                begin = np.cumsum(n) - n
                # what these documents add to the document frequencies goes with the first of them
                of_doc = [np.unique(small[a:b]) for a, b in zip(begin.tolist(), (begin + n).tolist(), strict=True)]
                distinct = np.concatenate(of_doc)
                held = np.bincount(distinct, minlength=encoder.vocabulary).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(n), _binary(small, n),
                     _binary(distinct, np.fromiter(map(len, of_doc), np.int64, len(n))),
                     pa.array([held.tobytes()] + [None] * (len(n) - 1), pa.binary())],
                    ["doc_id", "n", "ids", "distinct", "held"])

    made = map_arrow(rows, run, f"doc_id {kind}, n bigint, ids binary, distinct binary, held binary")
    return made if pivot is None else routed(made, pivot)


def _binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One binary value for each run of so many numbers."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64) * flat.itemsize
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).cast(pa.binary())


def dealt(table: DataFrame, n_tokens: int, task_tokens: int, sizes: DataFrame | None = None) -> DataFrame:
    """The rows in as many partitions as ``task_tokens`` asks for, about equal in tokens, in the order of routes.

    Tokens are counted by the first ``PREFIX`` pivots of a route (at most ``PIVOTS ** PREFIX`` numbers). A prefix
    takes its share of the whole order and spreads its rows over it by a hash of the stored row number, so that a
    prefix or a repeated id of any number of rows is split. ``sizes`` has route and n of the same rows, if they are
    quicker to get without the ids.
    """
    prefix = F.expr(f"route div {PIVOTS ** (ROUTE - PREFIX)}").alias("prefix")
    counted = sorted((table if sizes is None else sizes).groupBy(prefix).agg(F.sum("n")).collect())
    ends = np.cumsum([size for _, size in counted])
    spans = [(p, int(end) - size, size) for (p, size), end in zip(counted, ends, strict=True)]
    known = table.sparkSession.createDataFrame(spans, "prefix bigint, begin bigint, size bigint")
    tasks = max(1, -(-n_tokens // task_tokens))
    place = F.col("begin") + F.pmod(F.xxhash64("row"), F.lit(1 << 20)) / (1 << 20) * F.col("size")
    task = F.least(F.floor(place * tasks / max(n_tokens, 1)), F.lit(tasks - 1)).cast("int").alias("task")
    rows = table.select("doc_id", "ids", "route", "row", prefix).join(F.broadcast(known), "prefix")
    return (rows.select("doc_id", "ids", "route", "row", task).repartitionById(tasks, "task")
            .sortWithinPartitions("route", "doc_id", "row").select("doc_id", "ids"))


def _arrays(column: pa.Array, width: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), width) for x in column]


def document_frequencies(tokenized: DataFrame, vocabulary: int) -> np.ndarray:
    """Number of documents that hold each id: one number per id of the vocabulary, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for held in batch.column(0):
                total += np.frombuffer(held.as_py(), "<u4")
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    counts = np.zeros(vocabulary)
    found = map_arrow(tokenized.select("held").where("held IS NOT NULL"), run, "id bigint, n bigint")
    for row in found.groupBy("id").agg(F.sum("n")).collect():
        counts[row[0]] = row[1]
    return counts


class Shard:
    """Documents and their inverted index with BM25 weights."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        self.size = len(docs)
        lengths = np.fromiter(map(len, docs), np.float64, len(docs))
        flat = np.concatenate(docs).astype(np.int64) if docs else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(docs)), lengths.astype(np.int64))
        # one entry per document and term, ordered by document
        key, tf = np.unique(owner * len(idf) + flat, return_counts=True)
        self.doc, self.term = np.divmod(key, len(idf))
        norm = K1 * (1 - B + B * lengths[self.doc] / mean)
        self.weight = idf[self.term] * tf * (K1 + 1) / (tf + norm)
        self.of_doc = np.searchsorted(self.doc, np.arange(len(docs) + 1))
        order = np.argsort(self.term, kind="stable")
        self.posting_doc, self.posting_weight = self.doc[order], self.weight[order]
        self.of_term = np.searchsorted(self.term[order], np.arange(len(idf) + 1))

    def neighbours(self, seed: int, terms: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a leading term with ``seed``, best first."""
        part = slice(self.of_doc[seed], self.of_doc[seed + 1])
        weight, term = self.weight[part], self.term[part]
        if len(term) > terms:
            term = term[np.argpartition(-weight, terms - 1)[:terms]]
        starts, sizes = self.of_term[term], self.of_term[term + 1] - self.of_term[term]
        at = tokens.places(starts, sizes)
        score = np.bincount(self.posting_doc[at], self.posting_weight[at], self.size)
        found = np.flatnonzero((score > 0) & unused)
        return found[np.argsort(-score[found], kind="stable")]


def pack(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW, terms: int = QUERY_TERMS,
         room: int = 0) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) in order, and the room left in the last sequence.

    The first unused document is the seed of a sequence; its unused neighbours follow, best first, then the next
    seed. What does not fit is cut, and its rest begins the next sequence. ``room`` is what an earlier shard has
    left in sequence 0.
    """
    shard = Shard(docs, idf, mean)
    used = np.zeros(len(docs), bool)
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence, left = (0, room) if room else (-1, 0)
    queue: list[int] = []
    at = 0
    while True:
        while queue and used[queue[-1]]:
            queue.pop()
        if not queue:
            while at < len(docs) and used[at]:
                at += 1
            if at == len(docs):
                return pieces, left
            queue.append(at)
        doc = queue.pop()
        used[doc] = True
        start, total = 0, len(docs[doc])
        cut = False
        while start < total:
            if not left:
                cut, sequence, left = True, sequence + 1, window
            n = min(left, total - start)
            pieces.append((doc, start, n, sequence, window - left))
            start, left = start + n, left - n
        if cut and left or not queue:
            # the document that opens a sequence is its seed
            queue = shard.neighbours(doc, terms, ~used)[::-1].tolist() if left else []


def packed(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
           window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, task_tokens: int = TASK_TOKENS,
           terms: int = QUERY_TERMS) -> DataFrame:
    """Pieces of documents in sequences: the columns of ``PIECES``; ``ids`` are little-endian 32 bits.

    Document frequencies, the mean length and the pivots are those of all documents. Documents are routed by the pivots
    they are closest to, so that related ones meet in a shard, and dealt to tasks by tokens. Every id lies in one piece;
    sequences are full but for the last one of a task. Null texts count as empty and give a piece with the end id alone; repeated rows are packed each for itself; an
    empty table gives no rows. ``path`` is a word-level tokenizer file.
    """
    spark = docs.sparkSession
    vocabulary = tokens.encoder(path, False).vocabulary
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"
    kind = docs.schema[id_col].dataType.simpleString()
    table = stored(tokenised(docs, id_col, text_col, path, end_id)
                   .withColumn("row", F.monotonically_increasing_id()), "tokens")
    n_docs, n_tokens = table.agg(F.count("*"), F.sum("n")).first()
    counts = document_frequencies(table, vocabulary)
    pivot = fitted(table, counts, n_docs, n_tokens or 0)
    sizes = routed(table.select("n", "distinct"), pivot)
    rows = dealt(routed(table.select("doc_id", "ids", "distinct", "row"), pivot), n_tokens or 0, task_tokens, sizes)
    idf = np.log1p((n_docs - counts + 0.5) / (counts + 0.5))
    mean = (n_tokens or 1) / max(n_docs, 1)
    shared = spark.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task's number leaves the lower 40 bits for its sequences
        first = TaskContext.get().partitionId() << 40
        room, waiting, names, size = 0, [], [], 0
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), _arrays(batch.column(1), width), strict=True):
                names.append(name)
                waiting.append(ids)
                size += len(ids)
                if size >= shard_tokens:
                    made, first, room = emit(names, waiting, first, room)
                    yield from made
                    waiting, names, size = [], [], 0
        if waiting:
            yield from emit(names, waiting, first, room)[0]

    def emit(names: list, ids: list[np.ndarray], first: int, room: int) -> tuple[list[pa.RecordBatch], int, int]:
        pieces, left = pack(ids, shared.value, mean, window, terms, room)
        doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
        made = []
        for at in range(0, len(doc), 1024):
            part = slice(at, at + 1024)
            made.append(pa.RecordBatch.from_arrays([
                pa.array([names[d] for d in doc[part]], type=id_type), *map(pa.array, (
                    start[part], length[part], np.array([len(ids[d]) for d in doc[part]], np.int64),
                    sequence[part] + first, offset[part])),
                pa.array([ids[d][s : s + n].astype("<u4").tobytes()
                          for d, s, n in zip(doc[part], start[part], length[part], strict=True)], pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]))
        last = first + int(sequence[-1])
        return made, (last if left else last + 1), left

    id_type = to_arrow_type(docs.schema[id_col].dataType)
    return map_arrow(rows, run, PIECES.format(kind=kind))
