"""Filling missing values along a series of any length.

Inside a chunk the last known value is a window. The rows filled so far are stored once. What
must cross a chunk border is one value per column and chunk: a small table of each chunk's
first and last known values, scanned over the chunks and attached by (keys, chunk).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..series import SeriesSpec, floor_div, q, without_nan
from ..session import keep_table
from .chunks import CHUNK, Chunks, attach

GROUP = "_group"
CHUNKS_PER_GROUP = 4096


def fill(df: DataFrame, spec: SeriesSpec, columns: list[str], forward: bool = True,
         backward: bool = True, constant: float | None = None,
         rows_per_chunk: int | None = None) -> DataFrame:
    """Forward fill, then backward fill, then a constant, each when asked for.

    Backward filling after forward filling only reaches the nulls before a series' first
    known value, so it takes that value. Backward filling alone takes the next known one.
    """
    if CHUNK in df.columns:
        return _fill_chunks(df, spec, columns, forward, backward, constant)
    c = Chunks(df, spec, 0, rows_per_chunk)
    chunked = c.settle(c.frame, keep_chunk=True)
    return _fill_chunks(chunked, spec, columns, forward, backward, constant).drop(CHUNK)


def _fill_chunks(df: DataFrame, spec: SeriesSpec, columns: list[str], forward: bool,
                 backward: bool, constant: float | None) -> DataFrame:
    if not (forward or backward):
        return df if constant is None else df.na.fill(constant, subset=columns)
    identity = [*spec.keys, CHUNK]
    direction = "" if forward else " DESC"
    ordered = ", ".join(q(c) + direction for c in spec.order)
    rows = f"(PARTITION BY {', '.join(map(q, identity))} ORDER BY {ordered} ROWS UNBOUNDED PRECEDING)"
    df = without_nan(df, columns)
    inside = {c: f"last_value({q(c)}) IGNORE NULLS OVER {rows}" for c in columns}
    within = df.selectExpr(*[f"{inside[c]} AS {q(c)}" if c in inside else q(c) for c in df.columns])
    # read twice from here on, by the summary and by the result
    within = keep_table(within, "filled")
    joined = attach(within, _across(within, spec, columns, forward, backward), identity)
    filled = {}
    for i, name in enumerate(columns):
        choices = [q(name), f"_near{i}"] + ([f"_head{i}"] if forward and backward else [])
        if constant is not None:
            choices.append(f"CAST({constant} AS {df.schema[name].dataType.simpleString()})")
        filled[name] = f"coalesce({', '.join(choices)})"
    return joined.selectExpr(*[f"{filled[c]} AS {q(c)}" if c in filled else q(c) for c in df.columns])


def _across(df: DataFrame, spec: SeriesSpec, columns: list[str], forward: bool, backward: bool) -> DataFrame:
    """Per chunk what comes from others: the nearest known value before it (after it, if only filling
    backward) as ``_near<i>``, and the series' first known value as ``_head<i>``.

    The chunks are scanned in two levels, inside groups of chunks and over the groups, so that no task holds
    all chunks of a long series.
    """
    order = f"struct({', '.join(map(q, spec.order))})" if spec.tie else q(spec.ts)
    pick, direction = ("max_by", "") if forward else ("min_by", " DESC")
    count = range(len(columns))

    def known(function: str, value: str, by: str, name: str):
        return F.expr(f"{function}({value}, {by}) FILTER (WHERE {value} IS NOT NULL) AS {name}")

    def scan(part: list[str], by: str) -> list[str]:
        over = (f"({_partition(part)}ORDER BY {by}{direction} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
        return [f"last_value(_end{i}) IGNORE NULLS OVER {over} AS _near{i}" for i in count]

    ends = [known(pick, q(c), order, f"_end{i}") for i, c in enumerate(columns)]
    heads = [known("min_by", q(c), order, f"_first{i}") for i, c in enumerate(columns)] if forward and backward else []
    chunks = keep_table(df.groupBy(*spec.keys, CHUNK).agg(*ends, *heads), "chunks")
    chunks = chunks.withColumn(GROUP, floor_div(F.col(CHUNK), CHUNKS_PER_GROUP))
    keys = [*spec.keys, GROUP]
    groups = chunks.groupBy(*keys).agg(*[known(pick, f"_end{i}", CHUNK, f"_end{i}") for i in count])
    between = groups.selectExpr(*map(q, keys), *scan(list(spec.keys), GROUP)).withColumnsRenamed(
        {f"_near{i}": f"_far{i}" for i in count})
    inner = chunks.selectExpr(*map(q, [*keys, CHUNK]), *scan(keys, CHUNK))
    out = inner.join(between, keys, "left").selectExpr(
        *map(q, [*spec.keys, CHUNK]), *[f"coalesce(_near{i}, _far{i}) AS _near{i}" for i in count])
    if not heads:
        return out
    firsts = chunks.groupBy(*spec.keys).agg(*[known("min_by", f"_first{i}", CHUNK, f"_head{i}") for i in count])
    return attach(out, firsts, spec.keys)


def _partition(keys: tuple[str, ...] | list[str]) -> str:
    return f"PARTITION BY {', '.join(map(q, keys))} " if keys else ""


def numeric_columns(df: DataFrame, besides: list[str] | tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in besides]


def fill_median(df: DataFrame, spec: SeriesSpec, columns: list[str]) -> DataFrame:
    """Replace nulls by the exact median of the column in its series."""
    from .quantiles import exact_quantiles

    medians = exact_quantiles(df, columns, {"median": 0.5}, spec.keys)
    wide = medians.groupBy(*spec.keys).pivot("column", columns).agg(F.first("median"))
    renamed = wide.select(*spec.keys, *[F.col(f"`{c}`").alias(f"_median_{c}") for c in columns])
    joined = attach(df, renamed, spec.keys)
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.col(f"_median_{c}")) for c in columns}).select(*df.columns)


def handle_missing(df: DataFrame, spec: SeriesSpec, columns: list[str] | None = None,
                   bfill: bool = True, rows_per_chunk: int | None = None) -> DataFrame:
    """Forward then backward fill of every numeric column, the target included.

    A column can only stay null after both when the whole series lacks it, and then it
    has no median either. ``bfill=False`` keeps early lags from seeing later values.
    """
    skip = (*spec.keys, spec.ts, *spec.tie, CHUNK)
    columns = columns if columns is not None else numeric_columns(df, skip)
    return fill(df, spec, columns, backward=bfill, rows_per_chunk=rows_per_chunk) if columns else df
