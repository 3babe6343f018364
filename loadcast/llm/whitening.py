"""Whitened embeddings: principal components by incremental eigendecomposition, scaled to unit variance."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stored
from .spectra import Spectrum

#: Spectra or matrices that one step of a merge tree takes in.
FAN = 8
#: Vectors of a partition of the fit list for each dimension: merging a spectrum costs an update for each dimension.
ROWS_PER_DIMENSION = 16
#: Eigenvalues up to this share of the largest count as zero: the arithmetic knows no better.
EMPTY = 1e-13


def scaled(vector: str, factor: int = 256) -> Column:
    """``floor(factor * x)`` of each entry as long; null where the vector is null or holds null or a non-finite entry."""
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * factor).cast("long") + 0)
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(fine, whole)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Columns i (the id) and x (the vector as integers) of the rows with a whole, non-empty vector."""
    rows = vectors.select(F.col(id_col).alias("i"), F.col(vector_col).alias("v"))
    return rows.select("i", scaled("v").alias("x")).where(F.size("x") > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long vectors as a matrix of 64-bit integers."""
    sizes = np.unique(np.diff(column.offsets.to_numpy()))
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sizes[:5].tolist()}")
    return column.flatten().to_numpy().reshape(len(column), -1)


def _merged(parts: DataFrame, merge) -> bytes | None:
    """All ``data`` of a table (part, data) merged by ``merge``, ``FAN`` at a time in a tree of stored tables.

    No task holds more than ``FAN`` of them, and only the last one, of a size that does not depend on the rows, comes
    to the driver. None for an empty table.
    """

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        return pd.DataFrame({"part": [int(rows["part"].iloc[0]) // FAN], "data": [merge(rows["data"].tolist())]})

    left = stored(parts, "spectra")
    while left.count() > 1:
        left = stored(left.groupBy(F.expr(f"part div {FAN}")).applyInPandas(group, "part bigint, data binary"), "spectra")
    row = left.first()
    return None if row is None else bytes(row["data"])


def _by_part(rows: DataFrame, work) -> DataFrame:
    """``work`` of all vectors of each partition, given in blocks: a table (part, data)."""
    numbered = rows.select("x", F.spark_partition_id().cast("long").alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[int] = []

        def blocks() -> Iterator[np.ndarray]:
            for b in batches:
                if b.num_rows:
                    part[:] = [b.column(1)[0].as_py()]
                    yield _matrix(b.column(0))

        data = work(blocks())
        if part:
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([data], pa.binary())], ["part", "data"])

    return map_arrow(numbered, run, "part bigint, data binary")


def _spectrum(blocks: Iterator[np.ndarray]) -> bytes:
    found = None
    for rows in blocks:
        found = found or Spectrum.empty(rows.shape[1])
        found.add(rows)
    return pickle.dumps(found)


def _join_spectra(parts: list[bytes]) -> bytes:
    found = pickle.loads(parts[0])
    for part in parts[1:]:
        found.join(pickle.loads(part))
    return pickle.dumps(found)


def _join_matrices(parts: list[bytes]) -> bytes:
    return pickle.dumps(sum(pickle.loads(p) for p in parts))


def _covariance(fit_list: DataFrame, n: int, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Covariance of the fit list's projections on the columns of ``basis``: centred, multiplied, then summed."""

    def run(blocks: Iterator[np.ndarray]) -> bytes:
        total = np.zeros((basis.shape[1], basis.shape[1]))
        for rows in blocks:
            here = (rows - mean) @ basis
            total += here.T @ here
        return pickle.dumps(total)

    return pickle.loads(_merged(_by_part(fit_list, run), _join_matrices)) / n


class Whitening:
    """Components of a fit list: ``n`` vectors with exact ``sums``, ``values`` falling, ``vectors`` as columns.

    ``explained`` is each value's share of the trace; ``identity_error`` is the largest absolute entry of the whitened
    fit list's covariance minus the identity, measured over the whole list. Values of 0 have no whitened direction.
    """

    def __init__(self, n: int, sums: np.ndarray, values: np.ndarray, vectors: np.ndarray, trace: float,
                 identity_error: float):
        self.n, self.sums, self.values, self.vectors = n, sums, values, vectors
        self.trace, self.identity_error = trace, identity_error

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace > 0 else np.zeros(len(self.values))

    def deviations(self, rows: np.ndarray) -> list[int]:
        """Exact sums over dimensions of (n x - S)^2, in 64-bit integers where no step can exceed them."""
        far = self.n * int(np.abs(rows).max(initial=0)) + max((abs(int(s)) for s in self.sums), default=0)
        exact = np.int64 if far * far * rows.shape[1] < 1 << 62 else object
        away = rows.astype(exact) * self.n - self.sums.astype(exact)
        return (away * away).sum(axis=1).tolist()

    def whitened(self, rows: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            found = (rows - (self.sums / self.n).astype(float)) @ self.vectors / np.sqrt(self.values)
        return np.where(self.values > 0, found, np.nan)


def fit(rows: DataFrame, components: int) -> Whitening | None:
    """Fit on each distinct x once; None where there is none.

    Each partition of the fit list keeps the spectrum of its centred scatter matrix, by one rank-one update a vector;
    a tree of tasks merges the spectra by further rank-one updates. A last pass over the whole list takes the
    covariance of the projections on the merged basis (Rayleigh-Ritz), whose eigenvectors turn the basis: what
    rounding the many updates left behind is gone then. Memory is in proportion to the square of the dimension.
    """
    distinct = stored(rows.groupBy("x").agg(F.count("*").alias("copies")).select("x"), "fit_list")
    n, size = distinct.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n:
        return None
    fit_list = distinct.coalesce(max(1, n // (ROWS_PER_DIMENSION * size)))  # no more partitions than are worth a merge
    merged: Spectrum = pickle.loads(_merged(_by_part(fit_list, _spectrum), _join_spectra))
    mean = (merged.sums / n).astype(float)
    values, turn = np.linalg.eigh(_covariance(fit_list, n, mean, merged.basis))
    order = np.argsort(-values, kind="stable")
    trace, values = float(values.sum()), values[order][:components]
    vectors = merged.basis @ turn[:, order[:components]]
    missing = min(components, size) - len(values)  # directions that no vector has
    if missing > 0:
        rest = np.linalg.svd(np.column_stack([vectors, np.zeros((size, 1))]))[0][:, len(values) : len(values) + missing]
        vectors, values = np.column_stack([vectors, rest]), np.append(values, np.zeros(missing))
    values = np.where(values > EMPTY * max(values.max(initial=0.0), 0.0), values, 0.0)
    # either sign will do: the largest entry is positive, so that the same rows give the same signs
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1, 1)
    full = values > 0
    error = 0.0
    if full.any():
        after = _covariance(fit_list, n, mean, vectors[:, full] / np.sqrt(values[full]))
        error = float(np.abs(after - np.eye(int(full.sum()))).max())
    return Whitening(n, merged.sums, values, vectors, trace, error)


OUTPUT = "component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each row with a usable vector and each component: vec_id and the columns of ``OUTPUT``.

    Entries become ``floor(256 c)``. Rows whose vector is null, empty, or holds null or a non-finite entry drop out;
    rows without an id stay, with a null id. Repeated vectors count once in the fit and all get a result. Vectors of
    different lengths are an error. Components without variance have a null ``whitened`` and ``explained`` 0. There
    are as many components as dimensions, if fewer than asked for. No usable row gives no rows.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, {OUTPUT}"
    rows = stored(usable(vectors, id_col, vector_col), "vectors")
    model = fit(rows, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.values)
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            size = len(x)
            each = np.repeat(np.arange(size), k)
            deviation = pa.array(model.deviations(x), pa.decimal128(38, 0))
            white = model.whitened(x).ravel()
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                 pa.array(np.full(size * k, model.n)), deviation.take(pa.array(each)),
                 pa.array(white, mask=np.isnan(white)), pa.array(np.tile(model.explained, size)),
                 pa.array(np.full(size * k, model.identity_error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_arrow(rows, run, schema)
