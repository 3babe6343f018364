"""Models from moments: per series, per fold, elastic nets; against dense solvers."""

import numpy as np
import pandas as pd
import pytest

from loadcast.ml import create_model, load_model, moments
from loadcast.ml.linear import ELASTIC_GRID, RIDGE_GRID
from loadcast.ml.moments import Scatter, elastic, group_moments, scatter_of, squared_error
from loadcast.ml.search import LinearSearch
from loadcast.plans import forecast
from loadcast.series import SeriesSpec

SPEC = SeriesSpec(keys=("a", "b"), step="1 hour")
SINGLE = SeriesSpec(step="1 hour")
NAMES = ["u", "v", "w"]


def to_spark(spark, pdf):
    kinds = {"a": "string", "b": "int", "ts": "timestamp_ntz"}
    return spark.createDataFrame(pdf, ", ".join(f"{c} {kinds.get(c, 'double')}" for c in pdf.columns))


def rows(n=400, keys=(("x", 1), ("x", 2), ("y", 1)), seed=1):
    rng = np.random.default_rng(seed)
    parts = []
    for k, (a, b) in enumerate(keys):
        size = n * (10 if k == 0 else 1)  # one series holds most rows
        x = rng.normal(size=(size, 3)) * [1, 1e3, 1e-3] + [0, 1e6, 5]
        y = x @ (np.array([1.0, 2e-3, 3e3]) * (k + 1)) + rng.normal(size=size) + 100 * k
        parts.append(pd.DataFrame({"a": a, "b": b, "ts": pd.date_range("2024-01-01", periods=size, freq="h"),
                                   "y": y, "u": x[:, 0], "v": x[:, 1], "w": x[:, 2]}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def table(spark):
    pdf = rows()
    return pdf, to_spark(spark, pdf).repartition(6).persist()


@pytest.mark.parametrize("fan", [2, 16])
def test_moments_of_groups(table, monkeypatch, fan):
    pdf, df = table
    monkeypatch.setattr(moments, "FAN", fan)
    monkeypatch.setattr(moments, "HELD_BYTES", 64 if fan == 2 else 1 << 26)  # hands on after every batch
    found = {(r.a, r.b): scatter_of(r, 4) for r in group_moments(df, [*NAMES, "y"], ["a", "b"]).collect()}
    assert set(found) == {("x", 1), ("x", 2), ("y", 1)}
    for key, part in pdf.groupby(["a", "b"]):
        x = part[[*NAMES, "y"]].to_numpy()
        away = x - x.mean(0)
        assert found[key].n == len(part)
        np.testing.assert_allclose(found[key].mean, x.mean(0), rtol=1e-12)
        np.testing.assert_allclose(found[key].scatter, away.T @ away, rtol=1e-9, atol=1e-9 * np.abs(away.T @ away).max())
    whole = scatter_of(group_moments(df, [*NAMES, "y"], []).first(), 4)
    assert whole.n == len(pdf)
    assert group_moments(df.where("false"), NAMES, ["a"]).isEmpty() and group_moments(df.where("false"), NAMES, []).isEmpty()


def test_one_line_per_series(spark, table, tmp_path):
    pdf, df = table
    model = create_model("linear_per_series", spec=SPEC).fit(df, NAMES)
    model.save(str(tmp_path / "m"))
    for fitted in (model, load_model(spark, str(tmp_path / "m"))):
        got = fitted.transform(df).toPandas().sort_values(["a", "b", "ts"])
        for key, part in got.groupby(["a", "b"]):
            x = np.c_[np.ones(len(part)), part[NAMES]]
            want = x @ np.linalg.lstsq(x, part.y, rcond=None)[0]
            np.testing.assert_allclose(part.yhat, want, rtol=1e-8)
    assert model.problems().isEmpty() and model.evaluate(df).first().r2 > 0.9
    unknown = model.transform(df.limit(3).selectExpr("'new' AS a", "b", "ts", "u", "v", "w"))
    assert [r.yhat for r in unknown.collect()] == [None] * 3
    with pytest.raises(ValueError, match="keys"):
        create_model("linear_per_series", spec=SINGLE)


def test_a_series_without_a_fit_leaves_the_others_alone(spark, table):
    _, df = table
    bad = spark.sql("""SELECT 'nan' AS a, 1 AS b, timestampadd(HOUR, CAST(id AS INT), TIMESTAMP_NTZ'2024-01-01') AS ts,
        CAST(id AS DOUBLE) AS y, CASE WHEN id <> 3 THEN 1D * id END AS u, 1D AS v, double('inf') AS w FROM range(9)
        UNION ALL SELECT 'none', 1, TIMESTAMP_NTZ'2024-01-01', NULL, 1D, 1D, 1D
        UNION ALL SELECT 'one', 1, TIMESTAMP_NTZ'2024-01-01', 7D, 1D, 1D, 1D""")
    kept = df.where("a = 'y'").select(bad.columns)
    model = create_model("linear_per_series", spec=SPEC).fit(kept.union(bad), NAMES)
    assert [r.a for r in model.problems().collect()] == ["nan"]
    assert {r.a: r._n for r in model.table.collect()} == {"y": 400, "nan": 9, "one": 1}
    out = {r.a: r.yhat for r in model.transform(bad).collect()}
    assert out["nan"] is None and out["none"] is None and out["one"] == pytest.approx(7)
    alone = create_model("linear_per_series", spec=SPEC).fit(kept, NAMES).table.first()
    assert [x for x in model.table.where("a = 'y'").first()][3:] == pytest.approx([x for x in alone][3:])


def ridge(x, y, alpha):
    m = x.mean(0)
    w = np.linalg.solve((x - m).T @ (x - m) + alpha * np.eye(x.shape[1]), (x - m).T @ (y - y.mean()))
    return w, y.mean() - m @ w


def test_penalty_searched_in_each_series(spark):
    pdf = rows(n=90, seed=5)
    pdf["v"], pdf["w"] = pdf.v / 1e3, pdf.w * 1e3
    model = create_model("enhanced_per_series", spec=SPEC).fit(to_spark(spark, pdf), NAMES)
    table = {(r.a, r.b): r for r in model.table.collect()}
    for key, part in pdf.groupby(["a", "b"]):
        x, y = part[NAMES].to_numpy(), part.y.to_numpy()
        size, errors = len(part) // 4, []
        for s in RIDGE_GRID:
            each = []
            for k in (1, 2, 3):
                end = len(part) - size * (4 - k)
                w, c = ridge(x[:end], y[:end], s["alpha"])
                each.append(((y[end : end + size] - x[end : end + size] @ w - c) ** 2).mean())
            errors.append(np.mean(each))
        row = table[key]
        assert row._alpha == RIDGE_GRID[int(np.argmin(errors))]["alpha"]
        w, c = ridge(x, y, row._alpha)
        np.testing.assert_allclose([row._w0, row._w1, row._w2, row._intercept], [*w, c], rtol=1e-7)


@pytest.mark.parametrize("settings", ELASTIC_GRID)
def test_elastic_net_meets_its_conditions(settings):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6))
    x[:, 5] = 4.0  # constant
    y = x @ [3, 0, -2, 0.1, 0, 1] + rng.normal(size=300)
    alpha, l1 = settings["alpha"], settings["l1_ratio"]
    w, c = elastic(Scatter.of(np.c_[x, y]), alpha, l1)
    assert w[5] == 0 and c == pytest.approx(y.mean() - x.mean(0) @ w)
    away = x - x.mean(0)
    slope = away.T @ (y - c - x @ w) / 300 - alpha * (1 - l1) * w
    for s, k in zip(slope, w, strict=True):
        assert abs(s - np.sign(k) * alpha * l1) < 1e-8 if k else abs(s) <= alpha * l1 + 1e-8


@pytest.mark.parametrize("grid", [RIDGE_GRID, ELASTIC_GRID])
def test_search_equals_fits_on_rows(spark, table, grid):
    pdf, _ = table
    one = pdf[pdf.a == "y"].reset_index(drop=True)
    one["v"], one["w"] = one.v / 1e3, one.w * 1e3
    search = LinearSearch("search", grid, SINGLE)
    model = search.fit(to_spark(spark, one).repartition(3), NAMES)
    x, y = one[NAMES].to_numpy(), one.y.to_numpy()
    for result in search.results:
        each = []
        for k in (1, 2, 3):
            end = 400 - 100 * (4 - k)
            if "l1_ratio" in result["params"]:
                w, c = elastic(Scatter.of(np.c_[x, y][:end]), **result["params"])
            else:
                w, c = ridge(x[:end], y[:end], result["params"]["alpha"])
            each.append(((y[end : end + 100] - x[end : end + 100] @ w - c) ** 2).mean())
        assert result["mean_mse"] == pytest.approx(np.mean(each), rel=1e-8)
    best = min(search.results, key=lambda r: r["mean_mse"])["params"]
    assert search.best_params == best and model.details["best_params"] == best


def test_error_from_moments():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(50, 3)) + 1e4
    w, c = np.array([0.5, -2.0]), 3.0
    assert squared_error(Scatter.of(x), w, c) == pytest.approx(((x[:, 2] - x[:, :2] @ w - c) ** 2).mean(), rel=1e-9)


def test_search_needs_rows(spark, table):
    _, df = table
    with pytest.raises(ValueError, match="no row"):
        LinearSearch("search", RIDGE_GRID, SINGLE).fit(df.where("false"), NAMES)
    with pytest.raises(ValueError, match="null"):
        LinearSearch("search", RIDGE_GRID, SINGLE).fit(df.where("a = 'y'").selectExpr("ts", "y", "nullif(u, u) AS u"), ["u"])


def test_train_and_forecast_per_series(table):
    _, df = table
    for kind in ("linear_per_series", "enhanced_per_series"):
        out = forecast.train_and_forecast(df.select("a", "b", "ts", "y"), SPEC, kind, horizon=2).toPandas()
        assert len(out) == 6 and out.yhat.notna().all() and out.model_name.nunique() == 1
        assert out.groupby(["a", "b"]).yhat.first().nunique() == 3
