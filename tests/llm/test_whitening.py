"""Whitening against a dense solver, and rank-one updates against whole matrices."""

import math
import random

import numpy as np
import pytest

from loadcast.llm import whitening
from loadcast.llm.queries import QUERIES
from loadcast.llm.spectra import Spectrum, updated

SCHEMA = "vec_id bigint, embedding array<float>, label int, i string, x double, n bigint, component string"
CLASH = ("clash", 1.5, 7, "clash")


def tables():
    rng = np.random.default_rng(3)
    yield "spread", np.floor(rng.normal(0, 40, (90, 7))).astype(np.int64)
    yield "repeated", rng.integers(0, 2, (60, 5))
    yield "few", rng.integers(-50, 50, (3, 6))
    yield "constant column", np.column_stack([np.full(40, 9), rng.integers(-9, 9, (40, 3))])
    yield "dependent", rng.integers(-9, 9, (70, 2)) @ rng.integers(-5, 5, (2, 8))
    yield "equal values", np.vstack([s * 5 * np.eye(4, dtype=np.int64) for s in (1, -1, 1)])
    yield "sizes apart", np.floor(rng.normal(0, 1, (80, 6)) * 10.0 ** np.arange(6)).astype(np.int64)
    yield "one dimension", rng.integers(-9, 9, (20, 1))
    yield "one vector", rng.integers(-9, 9, (1, 3))
    yield "same vectors", np.tile(rng.integers(-9, 9, (1, 3)), (12, 1))


@pytest.mark.parametrize(("name", "rows"), list(tables()), ids=[n for n, _ in tables()])
def test_updates_and_merges_give_the_scatter_matrix(name, rows):
    for cuts in ([], [len(rows) // 3], sorted({1, len(rows) // 2, len(rows)})):
        found = Spectrum.empty(rows.shape[1])
        for part in np.split(rows, cuts):
            one = Spectrum.empty(rows.shape[1])
            one.add(part)
            found.join(one)
        away = rows - rows.mean(axis=0)
        scatter = away.T @ away
        assert found.n == len(rows) and (found.sums == rows.sum(axis=0)).all()
        size = max(1.0, np.abs(scatter).max())
        assert np.abs((found.basis * found.values) @ found.basis.T - scatter).max() < 1e-10 * size
        assert np.abs(found.basis.T @ found.basis - np.eye(len(found.values))).max(initial=0) < 1e-12
        assert (np.diff(found.values) >= 0).all()


def test_update_that_touches_nothing_changes_nothing():
    values, basis = updated(np.array([1.0, 2.0]), np.eye(3)[:, :2], np.zeros(3))
    assert values.tolist() == [1, 2] and (basis == np.eye(3)[:, :2]).all()


def brute(rows, components):
    """Result rows by a dense solver, signs aside: per row and component n, deviation, |whitened|, explained."""
    usable = [(i, [math.floor(256 * float(np.float32(c))) + 0 for c in v]) for i, v in rows
              if v and all(c is not None and math.isfinite(c) for c in v)]
    if not usable:
        return []
    fit = np.array(sorted({tuple(x) for _, x in usable}), dtype=np.int64)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    away = fit - np.array(sums) / n
    values, vectors = np.linalg.eigh(away.T @ away / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    found = []
    for i, x in usable:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        for k in range(min(components, len(sums))):
            empty = values[k] <= 1e-13 * values[0]
            white = None if empty else abs(float((np.array(x) - np.array(sums) / n) @ vectors[:, k] / math.sqrt(values[k])))
            found.append((i, k + 1, n, deviation, white, 0.0 if empty else values[k] / values.sum()))
    return found


def check(found, expected):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], -1 if r[4] is None else round(r[4], 6))
    found = [(r.vec_id, r.component, r.n, int(r.deviation), None if r.whitened is None else abs(r.whitened), r.explained)
             for r in found]
    assert len(found) == len(expected)
    for a, b in zip(sorted(found, key=key), sorted(expected, key=key), strict=True):
        assert a[:4] == b[:4]
        assert (a[4] is None) == (b[4] is None) and (a[4] is None or a[4] == pytest.approx(b[4], abs=1e-7))
        assert a[5] == pytest.approx(b[5], abs=1e-10)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None, *CLASH) for i, v in rows], SCHEMA)


def test_awkward_rows_equal_a_dense_solver(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.2 + 0.3 * k) for k in range(6)]) for i in range(300)]
    rows += [(400, None), (401, []), (402, [None] * 6), (403, [float("nan")] + [0.0] * 5), (404, [float("inf")] + [0.0] * 5),
             (405, [-0.0] * 6), (405, [0.0] * 6), (None, [0.1] * 6), (None, None)]
    rows += [(500 + i, rows[0][1]) for i in range(150)] + [rows[1]] * 3  # a third of all is one vector
    table = frame(spark, rows).repartition(5)
    result = whitening.whiten(table, 4).collect()
    check(result, brute(rows, 4))
    assert len({r.identity_error for r in result}) == 1 and result[0].identity_error < 1e-9
    by_component = {}
    for r in result:
        if r.vec_id in (405, 0):
            by_component.setdefault((r.vec_id, r.component), set()).add(r.whitened)
    assert all(len(x) == 1 for x in by_component.values())  # equal vectors, equal results


def test_merge_tree_of_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS_PER_DIMENSION", 1)
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1 + k) for k in range(4)]) for i in range(200)]
    check(whitening.whiten(frame(spark, rows).repartition(8), 4).collect(), brute(rows, 4))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5]), (2, [0.75])],
                                  [(1, [1.0, 2.0, 3.0, 4.0, 5.0]), (2, [2.0, 2.0, 3.0, 4.0, 5.0])], [(1, [0.5, 0.5])] * 4])
def test_small_tables(spark, rows):
    check(whitening.whiten(frame(spark, rows), 4).collect(), brute(rows, 4))


def test_deviation_beyond_64_bits(spark):
    rows = [(i, [4e12 * (1 if i % 2 else -1), float(i)]) for i in range(5)]
    check(whitening.whiten(frame(spark, rows), 2).collect(), brute(rows, 2))


def test_vectors_of_different_lengths_are_an_error(spark):
    with pytest.raises(Exception, match="different lengths|reshape|dimension"):
        whitening.whiten(frame(spark, [(1, [1.0]), (2, [1.0, 2.0]), (3, [0.5, 3.0])]), 2).collect()


def test_query(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    result = QUERIES["op11_whitening"](spark, folder)
    assert dict(result.dtypes)["deviation"] == "bigint"
    check(result.collect(), brute(rows, 4))
    assert result.first().identity_error < 1e-9
