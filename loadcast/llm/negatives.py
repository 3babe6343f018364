"""Hard negatives by slots: rows of another label that score just below an anchor's positives.

The upper limits of an anchor's positives cut the scores into disjoint slots. Every partition keeps the best rows of
each slot, so that one pass serves all positives of an anchor whatever their windows share; merging the slots from
the lowest upwards gives the best rows below each limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_folder
from .common import map_arrow, stored
from .whitening import _matrix, scaled

#: Bytes of the anchors' vectors that one pass over the rows takes along.
BLOCK_BYTES = 8_000_000
#: Scores held at once: anchors of a block times rows.
SCORES = 1 << 19
#: Stands for a null id in comparisons: such rows come last among equals.
_LAST = np.iinfo(np.int64).max


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products, as 64-bit integers."""
    if anchors.shape[1] != rows.shape[1]:
        raise ValueError(f"vectors of different lengths: {anchors.shape[1]}, {rows.shape[1]}")
    most = int(np.abs(anchors).max(initial=0)) * int(np.abs(rows).max(initial=0)) * anchors.shape[1]
    if most < 1 << 53:
        return (anchors.astype(float) @ rows.astype(float).T).astype(np.int64)
    if most < 1 << 63:
        return anchors @ rows.T
    raise OverflowError("inner products exceed 64-bit integers")


class _Best:
    """The ``k`` best rows of each of ``groups`` groups: higher scores first, then smaller ids."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.group, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(groups, np.iinfo(np.int64).min)  # the last row of each full group
        self.last = np.full(groups, _LAST)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        better = (score > self.least[group]) | ((score == self.least[group]) & (ids < self.last[group]))
        if not better.any():
            return
        group, score, ids = (np.concatenate([a, b[better]])
                             for a, b in ((self.group, group), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        first = np.flatnonzero(np.diff(group, prepend=-1))
        place = np.arange(len(group)) - np.repeat(first, np.diff(first, append=len(group)))
        keep = place < self.k
        self.group, self.score, self.id = group[keep], score[keep], ids[keep]
        full = place == self.k - 1
        self.least[group[full]], self.last[group[full]] = score[full], ids[full]


def _search(rows: DataFrame, groups: int, k: int, entries) -> DataFrame:
    """Per partition, the ``k`` best entries (g, s, i) of each group; ``entries`` yields group, score and row place.

    ``entries(x, y)`` gets the vectors and labels of some rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(groups, k)
        for b in batches:
            if b.num_rows:
                ids = b.column(0).fill_null(_LAST).to_numpy()
                x, y = _matrix(b.column(2)), b.column(1).to_numpy()
                for group, score, place, at in entries(x, y):
                    best.add(group, score, ids[at + place])
        ids = pa.array(best.id, pa.int64(), mask=best.id == _LAST)
        yield pa.RecordBatch.from_arrays([pa.array(best.group), pa.array(best.score), ids], ["g", "s", "i"])

    return map_arrow(rows, run, "g bigint, s bigint, i bigint")


def _top(found: DataFrame, k: int, *groups: str) -> DataFrame:
    """The ``k`` best of each group over all partitions, numbered (column n) from 1."""
    order = Window.partitionBy(*groups).orderBy(F.desc("s"), F.asc_nulls_last("i"))
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def _steps(anchors: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Scores of all anchors with some of the rows at a time, and the place of the first of these."""
    size = max(16, SCORES // max(len(anchors), 1))
    for at in range(0, len(x), size):
        yield at, _scores(anchors, x[at : at + size])


def _positives(rows: DataFrame, ids: np.ndarray, x: np.ndarray, y: np.ndarray, k: int) -> DataFrame:
    """The ``k`` best other rows of each anchor's label: columns g (place of the anchor), j (from 1), i, s.

    The anchor itself is among its best ``k + 1`` or beyond them; one row with its id and its score is taken out.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((x, y))

    def entries(rows_x: np.ndarray, rows_y: np.ndarray) -> Iterator[tuple]:
        anchors, labels = shared.value
        for at, score in _steps(anchors, rows_x):
            g, place = np.nonzero(labels[:, None] == rows_y[at : at + score.shape[1]])
            yield g, score[g, place], place, at

    own = [int(_scores(a[None], a[None])[0, 0]) for a in x]
    anchors = spark.createDataFrame(list(zip(range(len(x)), ids.tolist(), own)), "g bigint, anchor_id bigint, own bigint")
    found = _top(_search(rows, len(x), k + 1, entries), k + 1, "g").join(F.broadcast(anchors), "g")
    itself = (F.col("i") == F.col("anchor_id")) & (F.col("s") == F.col("own"))
    twin = F.row_number().over(Window.partitionBy("g", itself).orderBy("n"))
    others = found.withColumn("twin", twin).where(~F.coalesce(itself, F.lit(False)) | (F.col("twin") > 1))
    return _top(others.drop("n", "twin", "own"), k, "g").withColumnRenamed("n", "j")


def _slots(rows: DataFrame, x: np.ndarray, y: np.ndarray, limits: np.ndarray, least: np.ndarray, k: int) -> DataFrame:
    """The ``k`` best rows of other labels in each slot: columns g, slot (from 1), i, s.

    ``limits`` holds each anchor's upper limits, falling; slot j takes the scores from limit j down to above the next
    one, the last slot those down to ``least``.
    """
    shared = rows.sparkSession.sparkContext.broadcast((x, y, limits, least))
    m = limits.shape[1]

    def entries(rows_x: np.ndarray, rows_y: np.ndarray) -> Iterator[tuple]:
        anchors, labels, limits, least = shared.value
        for at, score in _steps(anchors, rows_x):
            inside = (score <= limits[:, :1]) & (score >= least[:, None]) & (labels[:, None] != rows_y[at : at + score.shape[1]])
            g, place = np.nonzero(inside)
            s = score[g, place]
            yield g * m + (s[:, None] <= limits[g]).sum(axis=1) - 1, s, place, at

    found = _search(rows, len(x) * m, k, entries)
    return (_top(found, k, "g").drop("n").withColumn("slot", (F.pmod("g", F.lit(m)) + 1).cast("int"))
            .withColumn("g", F.expr(f"g div {m}")))


def _below_limits(slots: DataFrame, m: int, k: int) -> DataFrame:
    """Columns g, j, best: the ``k`` best rows (struct s, i) of slots j to ``m``, merged from the lowest slot upwards."""
    entry = F.struct((-F.col("s")).alias("minus"), F.col("i").isNull().alias("none"), "i")
    per_slot = slots.groupBy("g").agg(*[F.collect_list(F.when(F.col("slot") == j, entry)).alias(f"c{j}")
                                        for j in range(1, m + 1)])
    merged = per_slot.withColumn(f"b{m}", F.array_sort(f"c{m}"))
    for j in range(m - 1, 0, -1):
        merged = merged.withColumn(f"b{j}", F.slice(F.array_sort(F.concat(f"c{j}", f"b{j + 1}")), 1, k))
    return merged.select("g", F.posexplode(F.array(*[f"b{j}" for j in range(1, m + 1)])).alias("j", "best")).withColumn(
        "j", F.col("j") + 1)


def _mined(rows: DataFrame, some: list, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The result for one block of anchors (rows i, x, y)."""
    ids = np.array([r["i"] for r in some], np.int64)
    x, y = np.array([r["x"] for r in some], np.int64), np.array([r["y"] for r in some], np.int64)
    chosen = stored(_positives(rows, ids, x, y, positives), "positives")
    limits = np.full((len(some), positives), np.iinfo(np.int64).min)
    least = np.full(len(some), _LAST)
    for r in chosen.where("s >= 0").select("g", "j", "s").collect():  # up to ``positives`` for each anchor of the block
        limits[r["g"], r["j"] - 1] = high * r["s"] // 100
        least[r["g"]] = min(least[r["g"]], -(-low * r["s"] // 100))
    merged = _below_limits(_slots(rows, x, y, limits, least, negatives), positives, negatives)
    pairs = (chosen.join(merged, ["g", "j"]).select("anchor_id", F.col("i").alias("positive_id"), F.col("s").alias("ps"),
                                                    F.posexplode("best").alias("at", "e")))
    score = -F.col("e.minus")
    return pairs.where((F.lit(low) * F.col("ps") <= F.lit(100) * score)).select(
        "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("e.i").alias("negative_id"),
        F.col("ps").alias("positive_score"), score.alias("negative_score"))


def mine(vectors: DataFrame, is_anchor: str, id_col: str = "vec_id", vector_col: str = "embedding",
         label_col: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         factor: int = 256) -> DataFrame:
    """Columns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Entries become ``floor(factor * x)``; a row's score is its inner product with the anchor. Higher scores come
    first, ties by smaller id, rows without an id last. An anchor's positives are its first ``positives`` other rows
    of its label. Each positive's negatives are the first ``negatives`` rows of other labels whose score is from
    ``low`` to ``high`` percent of the positive's score; below 0 there are none. ``is_anchor`` is a SQL condition on
    the id, there named ``i``; ids and labels are integers.

    Rows with a null label, a null or empty vector, or a null or non-finite entry take no part. Repeated rows are rows
    of their own: one is a positive of the other. Vectors of different lengths, and scores beyond 64 bits, are errors.
    No anchor, or no negative in a window, gives no rows.

    Every anchor is held against every row, as the task is stated, in blocks of anchors of bounded size: two passes
    over the rows for each block. Of each partition and slot only the best rows are shuffled.
    """
    if not 0 <= low <= high:
        raise ValueError("low and high are percentages, low no more than high")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("long").alias("y"),
                          F.col(vector_col).alias("v"))
    rows = stored(rows.select("i", "y", scaled("v", factor).alias("x"))
                  .where((F.size("x") > 0) & F.col("y").isNotNull()), "vectors")
    anchors = rows.where("i IS NOT NULL").where(is_anchor)
    n, width = anchors.agg(F.count("*"), F.max(F.size("x"))).first()
    schema = ("anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, "
              "negative_score bigint")
    if not n:
        return spark.createDataFrame([], schema)
    blocks = -(-n * width * 8 // BLOCK_BYTES)
    dealt = stored(anchors.repartition(blocks).withColumn("block", F.spark_partition_id()), "anchors")
    folder = shared_folder(spark, "negatives")
    for block in range(blocks):
        some = dealt.where(F.col("block") == block).collect()  # about BLOCK_BYTES
        if some:
            _mined(rows, some, positives, negatives, low, high).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)
