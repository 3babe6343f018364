"""Hard negatives against all scores of every anchor."""

import math
import random

import pytest

from loadcast.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, i string, s double, g bigint, y string, anchor_id string"
CLASH = ("clash", 1.5, 7, "clash", "clash")


def brute(rows, every=5, positives=5, count=3, low=50, high=95):
    kept = [(n, i, y, [math.floor(256 * c) for c in v]) for n, (i, v, y) in enumerate(rows)
            if y is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    found = []
    for n, a, label, x in kept:
        if a is None or a % every:
            continue
        scored = [(-sum(p * q for p, q in zip(x, z, strict=True)), j is None, j, y) for m, j, y, z in kept if m != n]
        scored.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        for ps, _, p, _ in [r for r in scored if r[3] == label][:positives]:
            inside = [r for r in scored if r[3] != label and low * -ps <= 100 * -r[0] <= high * -ps][:count]
            found += [(a, p, k, r[2], -ps, -r[0]) for k, r in enumerate(inside, 1)]
    return sorted(found, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, *CLASH) for i, v, y in rows], SCHEMA)


def mined(spark, rows, **options):
    found = negatives.mine(frame(spark, rows).repartition(4), "i % 5 = 0", **options)
    return sorted((tuple(r) for r in found.collect()), key=str)


def vectors(seed, n, size, spread=8):
    rng = random.Random(seed)
    return [(i, [rng.randint(-2, spread) / 8 for _ in range(size)], rng.randint(0, 3)) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_ties_and_hot_vectors(spark, seed):
    rows = vectors(seed, 160, 3)
    rows += [(1000 + i, rows[0][1], i % 2) for i in range(80)]  # a third is one vector
    assert mined(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    rows = vectors(7, 60, 4)
    rows += [(200, None, 1), (205, [], 1), (210, [1.0, None, 1.0, 1.0], 1), (215, [float("nan")] * 4, 1),
             (220, [float("inf")] * 4, 1), (225, [1.0] * 4, None), (None, [1.0] * 4, 1), (None, [0.5] * 4, 2),
             (230, [0.0] * 4, 1), (235, [-1.0] * 4, 1), (240, [1.0] * 4, 9)]
    rows += [rows[0]] * 3 + [rows[5]] * 7 + [(10, [0.25] * 4, 1)]  # repeated rows, also anchors, and an id used twice
    assert mined(spark, rows) == brute(rows)


@pytest.mark.parametrize("options", [{"positives": 1}, {"positives": 3, "negatives": 1}, {"negatives": 7, "low": 0, "high": 100}])
def test_parameters(spark, options):
    rows = vectors(11, 70, 3)
    assert mined(spark, rows, **options) == brute(rows, **{{"negatives": "count"}.get(k, k): v for k, v in options.items()})


def test_blocks_of_anchors(spark, monkeypatch):
    rows = vectors(13, 120, 3)
    whole = brute(rows)
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 200)
    monkeypatch.setattr(negatives, "SCORES", 64)
    assert mined(spark, rows) == whole


@pytest.mark.parametrize("rows", [[], [(1, [1.0], 1)], [(5, [1.0], 1)], [(5, [1.0], 1), (6, [1.0], 1)],
                                  [(5, [1.0], 1), (6, [1.0], 1), (7, [0.75], 2)]])
def test_small_tables(spark, rows):
    assert mined(spark, rows) == brute(rows)


def test_large_scores_are_exact(spark):
    rows = [(i, [2.0**22 + i, 3.0 * i], i % 2) for i in range(12)]
    assert mined(spark, rows) == brute(rows)


def test_errors(spark):
    with pytest.raises(Exception, match="different lengths"):
        mined(spark, [(5, [1.0], 1), (6, [1.0, 2.0], 1)])
    with pytest.raises(ValueError, match="low"):
        mined(spark, [], low=80, high=60)
