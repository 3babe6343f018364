"""Ordered work on series of any length: row positions, bounded chunks and halo rows.

A window partitioned by the series key puts a whole series into one task, which fails
as soon as one series holds a large share of the data. Here every ordered operator works
on chunks of a bounded number of consecutive rows. The last ``halo`` rows of a chunk are
copied into the next one, so a frame that looks back at most ``halo`` rows sees exactly
what it would see in the unbroken series; the copies are dropped afterwards.

Row positions need no shuffle when the series lies on a fixed grid. Otherwise the rows are dealt
into ranges of their order, ties included, and counted in two steps: rows per range, then a running
total over the ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..series import SeriesSpec, epoch_us, floor_div, known_us, q, step_us, without_nan
from ..session import cut_lineage, keep_table

# Spark's windows keep this many rows of a partition in a plain array; beyond it they spill
ROWS_IN_WINDOW = 4096
ROWS_PER_BUCKET = 1 << 20
BROADCAST_ROWS = 200_000
BROADCAST_CELLS = 2_000_000

POS, CHUNK, COPY, BUCKET = "_pos", "_chunk", "_copy", "_bucket"


def attach(df: DataFrame, summary: DataFrame, keys: list[str] | tuple[str, ...]) -> DataFrame:
    """Add the columns of a one-row-per-series table to rows of any number.

    The table is stored first, so its size is known: up to ``BROADCAST_ROWS`` rows and ``BROADCAST_CELLS``
    values it is broadcast and the rows stay where they are, beyond that both sides are shuffled.
    Without keys it is one row and becomes a scalar subquery, so there is no join at all.
    """
    if keys:
        stored = cut_lineage(summary)
        rows = stored.count()
        if rows <= BROADCAST_ROWS and rows * len(stored.columns) <= BROADCAST_CELLS:
            stored = F.broadcast(stored)
        return df.join(stored, list(keys), "left")
    return beside(df, summary, keys)


def beside(left: DataFrame, right: DataFrame, keys: list[str] | tuple[str, ...]) -> DataFrame:
    """Put two summaries side by side; ``right`` has one row per key."""
    if keys:
        return left.join(right, list(keys), "left")
    names = [c for c in right.columns if c not in keys]
    one = right.select(F.struct(*names).alias("s")).scalar()
    wide = left.withColumn("_one", one)
    return wide.select(*left.columns, *[F.col(f"_one.{n}").alias(n) for n in names])


def bucket_us(df: DataFrame, spec: SeriesSpec, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Width of time buckets that hold about ``rows_per_bucket`` rows, checked on the data.

    Bursts are met by narrowing the width until the fullest bucket is small enough; each
    check is an aggregate that counts before it shuffles.
    """
    us = epoch_us(df, spec.ts)
    stats = df.agg(F.count("*").alias("n"), F.min(us).alias("lo"), F.max(us).alias("hi")).first()
    if not stats.n or stats.lo is None:
        return 1
    span = stats.hi - stats.lo + 1
    if stats.n <= rows_per_bucket:
        return span
    size = max(1, span * rows_per_bucket // stats.n)
    while size > 1:
        fullest = (df.groupBy(*spec.keys, floor_div(us, size).alias(BUCKET)).count()
                   .agg(F.max("count")).first()[0])
        if fullest <= 4 * rows_per_bucket:
            break
        size = max(1, size // 8)
    return size


def with_position(df: DataFrame, spec: SeriesSpec, name: str = POS,
                  rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """0-based row position from the start of each series, as column ``name``."""
    if spec.step:
        us = known_us(df, spec)
        start = df.groupBy(*spec.keys).agg(F.min(us).alias("_start"))
        return (attach(df, start, spec.keys)
                .withColumn(name, floor_div(us - F.col("_start"), step_us(spec.step)))
                .drop("_start"))
    # ranges of the whole order: a busy stretch of time, or a single busy time stamp, spreads over several
    parts = -(-max(df.count(), 1) // rows_per_bucket)
    ranged = (df.withColumn("_us", known_us(df, spec)).repartitionByRange(parts, *spec.keys, "_us", *spec.tie)
              .withColumn(BUCKET, F.spark_partition_id()))
    ranged = keep_table(ranged, "ranges")
    before = Window.partitionBy(*spec.keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy(*spec.keys, BUCKET).count()
               .select(*spec.keys, BUCKET, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset")))
    within = Window.partitionBy(*spec.keys, BUCKET).orderBy(*spec.order)
    return (attach(ranged.withColumn("_rank", F.row_number().over(within)), offsets, [*spec.keys, BUCKET])
            .withColumn(name, F.col("_offset") + F.col("_rank") - 1)
            .select(*df.columns, name))


def with_place(df: DataFrame, spec: SeriesSpec, position: str, length: str) -> DataFrame:
    """Row position and number of rows of the row's series."""
    if not spec.step:
        lengths = df.groupBy(*spec.keys).agg(F.count("*").alias(length))
        return attach(with_position(df, spec, position), lengths, spec.keys)
    us = known_us(df, spec)
    extent = df.groupBy(*spec.keys).agg(F.min(us).alias("_start"), F.count("*").alias(length))
    return (attach(df, extent, spec.keys)
            .withColumn(position, floor_div(us - F.col("_start"), step_us(spec.step)))
            .select(*df.columns, position, length))


class Chunks:
    """A table of series cut into chunks, and the window frames that fit them.

    ``frame`` carries the copied halo rows; :meth:`settle` removes them again. Positions
    already present as column ``_pos`` are used as they are.
    """

    def __init__(self, df: DataFrame, spec: SeriesSpec, halo: int,
                 rows_per_chunk: int | None = None):
        self.spec = spec
        self.halo = halo
        self.rows = max(rows_per_chunk or max(ROWS_IN_WINDOW - halo, 3 * halo), halo, 1)
        self.columns = df.columns
        df = without_nan(df, [spec.target])
        if POS in df.columns:
            placed = df
        elif spec.step:
            placed = df.withColumn(POS, floor_div(known_us(df, spec), step_us(spec.step)))
        else:
            placed = with_position(df, spec)
        home = floor_div(F.col(POS), self.rows)
        if halo:
            near_end = F.pmod(F.col(POS), F.lit(self.rows).cast("long")) >= self.rows - halo
            homes = F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))
            self.frame = (placed.withColumn(CHUNK, F.explode(homes))
                          .withColumn(COPY, F.col(CHUNK) != home))
        else:
            self.frame = placed.withColumn(CHUNK, home).withColumn(COPY, F.lit(False))

    @property
    def partition(self) -> list[str]:
        return [*self.spec.keys, CHUNK]

    @property
    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.partition).orderBy(*self.spec.order)

    def over(self, frame: str = "") -> str:
        """SQL window over the chunk in time order, with a frame clause if given."""
        part, order = (", ".join(map(q, names)) for names in (self.partition, self.spec.order))
        return f"OVER (PARTITION BY {part} ORDER BY {order}{frame})"

    def last_rows(self, n: int) -> str:
        """SQL window over the current row and the ``n - 1`` before it."""
        if n - 1 > self.halo:
            raise ValueError(f"a frame of {n} rows needs a halo of {n - 1}, have {self.halo}")
        return self.over(f" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW")

    def whole(self) -> str:
        """SQL window over all rows of the chunk, copies included."""
        return self.over(" ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING")

    def lag(self, column: str, k: int) -> str:
        """SQL for the value ``k`` rows before."""
        if k > self.halo:
            raise ValueError(f"a lag of {k} rows needs a halo of {k}, have {self.halo}")
        return f"lag({q(column)}, {k}) {self.over()}"

    def offset(self) -> Column:
        """Position inside the chunk, counted from the first halo row."""
        return F.col(POS) - F.col(CHUNK) * self.rows + self.halo

    def settle(self, df: DataFrame, keep_chunk: bool = False) -> DataFrame:
        """Drop the copied rows; with ``keep_chunk`` the chunk column stays for a next step
        that wants the same partitioning."""
        helpers = [c for c in (POS, COPY) if c not in self.columns]
        helpers += [] if keep_chunk else [CHUNK]
        return df.where(~F.col(COPY)).drop(*helpers)
