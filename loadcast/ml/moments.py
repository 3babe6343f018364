"""Means and scatter matrices of many groups at once: all that least squares, ridge and elastic nets need of the rows.

Each task keeps one matrix per group it meets, so rows are not shuffled; the matrices of a group are merged in a tree.
Groups may be series, time blocks, or both. Everything is centred before it is multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import keep_table, reach_package

#: Bytes of matrices that a task holds before it hands them on, and matrices of a group that one merge takes in.
HELD_BYTES = 64 << 20
FAN = 16
_PARTIAL = "_part bigint, _n bigint, _mean array<double>, _scatter array<double>"


@dataclass
class Scatter:
    """``n`` rows with their means and the sums of products of their distances from these."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Scatter:
        mean = rows.mean(axis=0)
        away = rows - mean
        return cls(len(rows), mean, away.T @ away)

    def __add__(self, other: Scatter) -> Scatter:
        n = self.n + other.n
        away = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(away, away) * (self.n / n * other.n)
        return Scatter(n, self.mean + away * (other.n / n), scatter)


def group_moments(df: DataFrame, columns: list[str], groups: list[str]) -> DataFrame:
    """One row per group: the group columns, ``_n``, ``_mean`` and ``_scatter`` (row by row), as a stored table.

    Null values make a group's moments NaN. Without group columns there is one row, if there are any rows.
    """
    reach_package(df.sparkSession)
    width = len(columns)
    rows = df.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
                     *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)],
                     F.spark_partition_id().cast("long").alias("_part"))
    kinds = [T.StructField(f"_g{i}", df.schema[g].dataType) for i, g in enumerate(groups)]
    schema = T.StructType([*kinds, *T.StructType.fromDDL(_PARTIAL).fields])
    names = [k.name for k in kinds]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Scatter] = {}
        keys: dict[tuple, pa.Table] = {}
        part = 0

        def flush() -> pa.RecordBatch:
            own = list(held.values())
            lead = pa.concat_tables(keys.values()).combine_chunks().columns if names else []
            values = [pa.array([part] * len(own)), pa.array([s.n for s in own]), pa.array([s.mean for s in own]),
                      pa.array([s.scatter.ravel() for s in own])]
            out = pa.RecordBatch.from_arrays(
                [*[c.combine_chunks() for c in lead], *values], [*names, "_part", "_n", "_mean", "_scatter"])
            held.clear()
            keys.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            part = batch.column(batch.num_columns - 1)[0].as_py()
            values = np.column_stack([batch.column(len(names) + i).to_numpy(zero_copy_only=False) for i in range(width)])
            code = np.zeros(batch.num_rows, np.int64)
            for i in range(len(names)):
                coded = batch.column(i).dictionary_encode(null_encoding="encode")
                code = np.unique(code * len(coded.dictionary) + coded.indices.to_numpy(), return_inverse=True)[1]
            order = np.argsort(code, kind="stable")
            edges = np.flatnonzero(np.diff(code[order], prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                first = int(order[a])
                key = tuple(table.column(i)[first].as_py() for i in range(len(names)))
                found = Scatter.of(values[order[a:b]])
                if key in held:
                    held[key] = held[key] + found
                else:
                    held[key], keys[key] = found, table.select(names).take([first])
            if len(held) * width * (width + 1) * 8 > HELD_BYTES:
                yield flush()
        if held:
            yield flush()

    def merge(some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values(["_part", "_n"], kind="stable")
        total = sum_of([Scatter(n, np.asarray(m), np.asarray(s).reshape(width, width))
                        for n, m, s in zip(some["_n"], some["_mean"], some["_scatter"], strict=True)])
        out = some.iloc[:1].copy()
        out["_part"] = some["_part"].iloc[0] // FAN
        out["_n"], out["_mean"], out["_scatter"] = total.n, [total.mean], [total.scatter.ravel()]
        return out

    found = keep_table(rows.mapInArrow(partial, schema), "moments")
    while True:
        most = found.groupBy(*names).count().agg(F.max("count")).first()[0]
        if (most or 0) <= 1:
            break
        by = [F.col(c) for c in names] + [F.expr(f"_part div {FAN}")]
        found = keep_table(found.groupBy(*by).applyInPandas(merge, schema), "moments")
    return found.select(*[F.col(f"_g{i}").alias(g) for i, g in enumerate(groups)], "_n", "_mean", "_scatter")


def sum_of(parts: list[Scatter]) -> Scatter:
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


def scatter_of(row, width: int) -> Scatter:
    """A row of ``group_moments`` as a :class:`Scatter`."""
    return Scatter(int(row["_n"]), np.asarray(row["_mean"], float), np.asarray(row["_scatter"], float).reshape(width, width))


def squared_error(test: Scatter, weights: np.ndarray, intercept: float) -> float:
    """Mean of (y - Xw - b)^2 over the rows behind ``test``, whose last column is y."""
    away = np.append(-weights, 1.0)
    return float(away @ test.scatter @ away / test.n + (away @ test.mean - intercept) ** 2)


def elastic(train: Scatter, alpha: float, l1_ratio: float, rounds: int = 100_000) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of the elastic net, by coordinate descent on the scatter matrix.

    Minimises |y - Xw - b|^2 / 2n + alpha (l1_ratio |w|_1 + (1 - l1_ratio) |w|^2 / 2) until no step changes a
    prediction's deviation noticeably. Without a penalty on the squares, constant features get 0.
    """
    gram, right = train.scatter[:-1, :-1] / train.n, train.scatter[:-1, -1] / train.n
    lasso, ridge = alpha * l1_ratio, alpha * (1 - l1_ratio)
    size = np.diag(gram)
    weights, fitted = np.zeros(len(right)), np.zeros(len(right))
    enough = 1e-13 * np.sqrt(max(train.scatter[-1, -1] / train.n, np.finfo(float).tiny))
    spread = np.sqrt(size)
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(right)):
            if not size[j]:
                continue
            pull = right[j] - fitted[j] + size[j] * weights[j]
            new = np.sign(pull) * max(abs(pull) - lasso, 0.0) / (size[j] + ridge)
            if new != weights[j]:
                fitted += gram[:, j] * (new - weights[j])
                moved = max(moved, abs(new - weights[j]) * spread[j])
                weights[j] = new
        if moved <= enough:
            break
    return weights, float(train.mean[-1] - train.mean[:-1] @ weights)
