"""Exponentially weighted means with adjusted weights, as window sums.

With d = 1 - alpha the mean at row t is sum(d^(t-j) x_j) / sum(d^(t-j)) over the known
rows j <= t. Inside a block of rows the sums are d^r * cumsum(x_j d^-r_j); the block is
short enough for d^-r to stay finite and long enough for everything before the previous
block to weigh less than rounding. A halo gives each chunk that history. At a null row
the mean equals the one at the last known row, so nulls are forward-filled.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from ..series import SeriesSpec, add, q
from .chunks import Chunks
from .fill import fill

BASIC_ALPHAS = [0.1, 0.3]
ADVANCED_ALPHAS = [0.1, 0.3, 0.5, 0.7]

_MEMORY = 40.0      # e^-40 is below double precision
_HEADROOM = 600.0   # e^600 stays far from overflow


def ewma_name(y: str, alpha: float) -> str:
    return f"{y}_ewma_{str(alpha).replace('.', '_')}"


def _rate(alpha: float) -> float:
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    return -math.log1p(-alpha)


def halo_rows(alphas: list[float]) -> int:
    """Rows of history after which a value no longer shows in any of the means."""
    return max(math.ceil(_MEMORY / _rate(a)) for a in alphas)


def _block_groups(alphas: list[float]) -> list[tuple[int, list[float]]]:
    """Alphas that can share one block length, so that they share one sort."""
    groups: list[tuple[int, list[float]]] = []
    for a in sorted(alphas, reverse=True):
        if groups and _MEMORY / _rate(a) <= groups[-1][0]:
            groups[-1][1].append(a)
        else:
            groups.append((int(_HEADROOM / _rate(a)), [a]))
    return groups


def add_ewma(frame: DataFrame, c: Chunks, y: str, alphas: list[float]) -> DataFrame:
    """Add the means to a frame of ``c``; null wherever the target is null."""
    if c.halo < halo_rows(alphas):
        raise ValueError(f"ewma needs a halo of {halo_rows(alphas)} rows, have {c.halo}")
    partition, order = ", ".join(map(q, c.partition)), ", ".join(map(q, c.spec.order))
    for block, members in _block_groups(alphas):
        frame = frame.withColumn("_i", c.offset())
        frame = add(frame, {"_block": f"_i div {block}", "_r": f"_i % {block}"})
        inside = (f"OVER (PARTITION BY {partition}, _block ORDER BY {order} "
                  "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
        earlier = (f"OVER (PARTITION BY {partition} ORDER BY {order} "
                   "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
        sums, carries, means = {}, {}, {}
        for i, a in enumerate(members):
            d = f"{1 - a!r}D"
            value = f"CASE WHEN {q(y)} IS NULL THEN 0D ELSE {q(y)} * pow({d}, -_r) END"
            weight = f"CASE WHEN {q(y)} IS NULL THEN 0D ELSE pow({d}, -_r) END"
            sums[f"_num{i}"] = f"pow({d}, _r) * sum({value}) {inside}"
            sums[f"_den{i}"] = f"pow({d}, _r) * sum({weight}) {inside}"
            for s in (f"_num{i}", f"_den{i}"):
                ends = f"CASE WHEN _r = {block - 1} THEN {s} END"
                carries[f"{s}c"] = f"coalesce(last_value({ends}) IGNORE NULLS {earlier}, 0D)"
            reach = f"pow({d}, _r + 1)"
            means[ewma_name(y, a)] = (
                f"CASE WHEN {q(y)} IS NOT NULL THEN "
                f"try_divide(_num{i} + {reach} * _num{i}c, _den{i} + {reach} * _den{i}c) END")
        frame = add(add(add(frame, sums), carries), means)
        frame = frame.drop("_i", "_block", "_r", *sums, *carries)
    return frame


def with_ewma(df: DataFrame, spec: SeriesSpec, alphas: list[float] | None = None,
              rows_per_chunk: int | None = None) -> DataFrame:
    alphas = alphas or BASIC_ALPHAS
    c = Chunks(df, spec, halo_rows(alphas), rows_per_chunk)
    names = [ewma_name(spec.target, a) for a in alphas]
    raw = c.settle(add_ewma(c.frame, c, spec.target, alphas), keep_chunk=True)
    return fill(raw, spec, names, backward=False).select(*df.columns, *names)
