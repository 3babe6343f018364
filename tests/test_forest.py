"""Forests without a bound on depth: against trees grown one node after the other, in one task and over many."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadcast.ml import create_model, forest, load_model
from loadcast.ml.forest import DeepForest
from loadcast.ml.search import BOOSTING_GRID, DEEP_GRID, LEAF_GRID, BoostingSearch, ForestSearch, folded
from loadcast.ml.trees import Rule, draws, grown
from loadcast.series import SeriesSpec

NAMES = ["a", "b", "c"]


def brute(x, y, w, rule, depth=0):
    """One node after the other, every feature and value tried."""
    if y.min() == y.max() or not rule.may_split(len(y), depth):
        return float(np.average(y, weights=w))
    best = (-np.inf, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for low, high in zip(values[:-1], values[1:], strict=True):
            left = x[:, f] <= low
            if min(left.sum(), (~left).sum()) >= rule.min_leaf:
                gain = (w * y)[left].sum() ** 2 / w[left].sum() + (w * y)[~left].sum() ** 2 / w[~left].sum()
                if gain > best[0] + 1e-9:
                    best = (gain, f, (low + high) / 2)
    if best[1] is None:
        return float(np.average(y, weights=w))
    _, f, t = best
    left = x[:, f] <= t
    return f, t, brute(x[left], y[left], w[left], rule, depth + 1), brute(x[~left], y[~left], w[~left], rule, depth + 1)


def walked(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def table(n=700, seed=3):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"a": rng.integers(0, 40, n) * 1.0, "b": rng.integers(0, 9, n) - 4.0, "c": rng.integers(0, 90, n) / 8})
    pdf["y"] = np.round(np.where(pdf.a > 12, pdf.b, -pdf.b) * 3 + pdf.c + rng.integers(0, 9, n))
    pdf["ts"] = pd.date_range("2024-01-01", periods=n, freq="h")
    return pdf


@pytest.fixture(scope="module")
def data(spark):
    pdf = table()
    return pdf, spark.createDataFrame(pdf).repartition(5)


@pytest.mark.parametrize("rule", [Rule(), Rule(0), Rule(4), Rule(None, 10, 4), Rule(7, 5, 2)])
def test_a_tree_is_the_brute_force_tree(rule):
    pdf = table(160)
    x, y = pdf[NAMES].to_numpy(), pdf.y.to_numpy()
    w = np.random.default_rng(1).integers(1, 4, len(y))
    got = grown(x, y, w, rule).walk(x, [None])[:, 0]
    np.testing.assert_allclose(got, [walked(brute(x, y, w, rule), r) for r in x], atol=1e-9)


def test_a_cut_is_a_shallower_tree():
    pdf = table(300)
    x, y, w = pdf[NAMES].to_numpy(), pdf.y.to_numpy(), np.ones(300)
    cut = grown(x, y, w, Rule()).walk(x, [0, 2, 5, None])
    for c, depth in enumerate((0, 2, 5, None)):
        np.testing.assert_allclose(cut[:, c], grown(x, y, w, Rule(depth)).walk(x, [None])[:, 0])


def test_odd_values():
    x = np.array([[0.0, np.inf], [0.0, -np.inf], [5e-324, 1.0], [0.0, 1.0]])
    y = np.array([1.0, 2.0, 3.0, 4.0])
    np.testing.assert_allclose(grown(x, y, np.ones(4), Rule()).walk(x, [None])[:, 0], y)
    same = np.zeros((5, 1))
    assert len(grown(same, np.arange(5.0), np.ones(5), Rule()).feature) == 1


def test_rows_are_drawn_like_a_bootstrap():
    w = draws(np.random.default_rng(0).integers(-(2**62), 2**62, 100_000), 7, 42)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and abs((w == 0).mean() - np.exp(-1)) < 0.01


def rows_of(table_):
    pdf = table_.toPandas()
    return np.array(pdf.x.tolist()), pdf.y.to_numpy(), pdf.u.to_numpy()


def brute_forest(x, y, u, trees, seed, rule, at):
    total = np.zeros(len(at))
    for t in range(trees):
        w = draws(u, t, seed)
        tree = brute(x[w > 0], y[w > 0], w[w > 0], rule)
        total += [walked(tree, r) for r in at]
    return total / trees


@pytest.mark.parametrize("params", [{}, {"minSamplesSplit": 9}, {"minInstancesPerNode": 3}])
def test_forest_in_a_few_tasks(data, params):
    pdf, df = data
    estimator = DeepForest(numTrees=3, **params)
    stored = forest.training_table(df, NAMES, "y", 42)
    got = estimator.fit_table(stored, NAMES, "y").transform(df).toPandas()
    want = brute_forest(*rows_of(stored), 3, 42, estimator.rule, got[NAMES].to_numpy())
    np.testing.assert_allclose(got.yhat, want, atol=1e-9)


@pytest.mark.parametrize("cells,params", [(60, {}), (300, {"minInstancesPerNode": 2}), (300, {"maxDepth": 4})])
def test_forest_over_many_tasks(data, monkeypatch, cells, params):
    """With fewer values than bins the passes see every split, so the trees are the brute-force ones up to thresholds
    that lie between the same two values."""
    pdf, df = data
    monkeypatch.setattr(forest, "LOCAL_CELLS", cells)
    monkeypatch.setattr(forest, "HIST_BYTES", 3 * forest.BINS * 24 * 2)
    estimator = DeepForest(numTrees=2, **params)
    stored = forest.training_table(df, NAMES, "y", 42)
    model = estimator.fit_table(stored, NAMES, "y")
    assert max(len(t.feature) for t in model.tops) > 5
    got = model.transform(df).toPandas()
    want = brute_forest(*rows_of(stored), 2, 42, estimator.rule, got[NAMES].to_numpy())
    far = np.abs(got.yhat - want) > 1e-9
    assert far.mean() < 0.1  # rows not drawn may lie between a threshold and the next value


def test_a_model_too_large_for_every_task(data, monkeypatch, tmp_path, spark):
    pdf, df = data
    monkeypatch.setattr(forest, "LOCAL_CELLS", 300)
    model = DeepForest(numTrees=3).fit(df, NAMES)
    cuts = [(3, None), (1, 4), (2, 0)]
    here = model.predicted(df, cuts, "p").orderBy("ts").toPandas()
    monkeypatch.setattr(forest, "MODEL_NODES", 1)
    monkeypatch.setattr(forest, "GROUP_ROWS", 50)
    there = model.predicted(df, cuts, "p").orderBy("ts").toPandas()
    np.testing.assert_allclose(np.array(there.p.tolist()), np.array(here.p.tolist()))
    assert list(there.columns) == list(here.columns)
    model.save(str(tmp_path / "f"))
    again = load_model(spark, str(tmp_path / "f")).transform(df).orderBy("ts").toPandas()
    np.testing.assert_allclose(again.yhat, np.array(here.p.tolist())[:, 0])


def test_values_closer_than_bins(spark, monkeypatch):
    """Nearly all rows share one value; the bins of the whole table cannot part the rest, those of a node can."""
    monkeypatch.setattr(forest, "LOCAL_CELLS", 8)
    rng = np.random.default_rng(5)
    x = np.where(np.arange(3000) < 2600, 7.0, -rng.random(3000))
    df = spark.createDataFrame(pd.DataFrame({"a": x, "y": np.floor(x * 40)}))
    model = DeepForest(numTrees=2).fit(df, ["a"])
    out = model.transform(df).toPandas()
    assert np.abs(out.yhat - out.y).max() < 3 and (out.yhat[out.a == 7] == 280).all()


def test_edges(data, spark):
    pdf, df = data
    with pytest.raises(ValueError, match="no row"):
        DeepForest().fit(df.where("false"), NAMES)
    with pytest.raises(ValueError, match="null values in b"):
        DeepForest().fit(df.withColumn("b", F.when(F.col("a") > 3, F.col("b"))), NAMES)
    with pytest.raises(TypeError, match="depth"):
        DeepForest(depth=3)
    one = spark.createDataFrame([(1.0, 5.0), (2.0, None)], "a double, y double")
    assert {r.yhat for r in DeepForest(numTrees=2).fit(one, ["a"]).transform(one).collect()} == {5.0}
    assert create_model("random_forest", n_estimators=2).fit(df, NAMES).transform(df.where("false")).count() == 0


def test_search_is_one_fit_per_setting(data):
    pdf, df = data
    spec = SeriesSpec(step="1 hour")
    grid = [{"numTrees": t, "maxDepth": d, "minSamplesSplit": s} for t in (1, 3) for d in (2, None) for s in (2, 20)]
    search = ForestSearch("Forest", grid, spec)
    model = search.fit(df, NAMES)
    assert len(DEEP_GRID) == 81 and search.best_params == min(search.results, key=lambda r: r["mean_mse"])["params"]
    assert model.evaluate(df).first().r2 > 0.5
    stored = forest.training_table(folded(df, spec), NAMES, "y", 42, ["_block"])
    rows = stored.toPandas()
    x, y, u, block = np.array(rows.x.tolist()), rows.y.to_numpy(), rows.u.to_numpy(), rows._block.to_numpy()
    kinds = search._kinds()
    large = search._large_errors(stored, NAMES, kinds)
    small = search._small_errors(stored, kinds)
    for key, found in small.items():
        np.testing.assert_allclose(found, large[key])
    g, k = 0, 2
    for (trees, depth), error in zip(kinds[g][2], small[g, k], strict=True):
        p = brute_forest(x[block < k], y[block < k], u[block < k], trees, 42, Rule(depth), x[block == k])
        assert error == pytest.approx(((p - y[block == k]) ** 2).mean())
    with pytest.raises(ValueError, match="too few rows"):
        search.fit(df.limit(2), NAMES)


@pytest.mark.parametrize("grid", [
    [{"maxIter": i, "stepSize": 0.3, "maxDepth": d} for i in (2, 5) for d in (1, 3)],
    [{"num_leaves": n, "feature_fraction": 0.7, "n_estimators": i} for n in (3, 6) for i in (2, 7)]])
def test_boosting_search_is_one_fit_per_setting(data, grid):
    pdf, df = data
    spec = SeriesSpec(step="1 hour")
    search = BoostingSearch("Boosting", grid, spec)
    model = search.fit(df, NAMES)
    assert len(BOOSTING_GRID) == 18 and len(LEAF_GRID) == 81 and len(search.results) == len(grid)
    assert search.best_params == min(search.results, key=lambda r: r["mean_mse"])["params"]
    assert model.evaluate(df).first().r2 > 0
    if "maxIter" not in grid[0]:
        return  # rows are drawn by numbers that each fit makes for itself
    parts = folded(df, spec).toPandas()
    for result in search.results:
        errors = []
        for k in (1, 2, 3):
            early = df.sparkSession.createDataFrame(parts[parts._block < k])
            late = df.sparkSession.createDataFrame(parts[parts._block == k])
            from loadcast.ml.quantile import LeafBoosting
            fitted = LeafBoosting(**search._settings(result["params"])).fit(early, NAMES)
            errors.append(fitted.evaluate(late).first().mse)
        assert result["mean_mse"] == pytest.approx(np.mean(errors))
    stored = forest.training_table(folded(df, spec), NAMES, "y", 42, ["_block"])
    large, small = search._large_errors(stored, NAMES, search._kinds()), search._small_errors(stored, search._kinds())
    for key, found in small.items():
        np.testing.assert_allclose(found, large[key])
