import numpy as np
import pandas as pd
import pytest
from frames import to_spark

from loadcast.ml import available_models, create_model, load_model, select
from loadcast.ml.ensemble import Ensemble, weights
from loadcast.ml.scale import Scaler
from loadcast.ml.linear import ELASTIC_GRID, RIDGE_GRID, ElasticNet, Ridge
from loadcast.ml.search import BOOSTING_GRID, FOREST_GRID, GridSearch, folded
from loadcast.plans import features, forecast
from loadcast.series import SeriesSpec

GRID = SeriesSpec(step="1 hour")


@pytest.fixture(scope="module")
def table(spark):
    """721 hours with a daily wave, noise and two unrelated features."""
    rng = np.random.default_rng(42)
    n = 721
    pdf = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=n, freq="h"),
                        "y": 100 + 10 * np.sin(2 * np.pi * np.arange(n) / 24) + rng.normal(0, 5, n),
                        "feature1": rng.normal(size=n), "feature2": rng.normal(size=n),
                        "wave": np.sin(2 * np.pi * np.arange(n) / 24)})
    return pdf, to_spark(spark, pdf).persist()


def test_names(spark):
    assert create_model("linear").name == "Linear Regression"
    assert create_model("random_forest").name == "Random Forest"
    assert create_model("enhanced_linear", spec=GRID).name == "Enhanced Ridge"
    with pytest.raises(ValueError):
        create_model("invalid_model")
    with pytest.raises(ValueError):
        create_model("enhanced_linear", spec=GRID, regularization="none")
    assert [t for t, m in available_models().items() if m["supports_intervals"]] == ["gradient_boosting_quantile"]


def test_linear_training_and_scores(table):
    pdf, df = table
    model = create_model("linear").fit(df, ["feature1", "feature2"])
    assert model.feature_names == ["feature1", "feature2"]
    assert model.transform(df.limit(10)).count() == 10
    row = model.evaluate(df).first()
    assert all(isinstance(row[m], float) for m in ("mae", "rmse", "r2", "mape"))
    x = np.c_[np.ones(len(pdf)), pdf[["feature1", "feature2"]]]
    want = x @ np.linalg.lstsq(x, pdf.y, rcond=None)[0]
    got = model.transform(df).orderBy("ts").toPandas().yhat
    np.testing.assert_allclose(got, want, rtol=1e-10)


def test_save_and_load(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 4.0, 10.0), (2.0, 5.0, 20.0), (3.0, 6.0, 30.0)],
                               "feature1 double, feature2 double, y double")
    model = create_model("linear").fit(df, ["feature1", "feature2"])
    model.save(str(tmp_path / "m"))
    again = load_model(spark, str(tmp_path / "m"))
    assert (again.name, again.feature_names) == ("Linear Regression", ["feature1", "feature2"])
    a, b = (sorted(r.yhat for r in m.transform(df).collect()) for m in (model, again))
    np.testing.assert_array_almost_equal(a, b)
    np.testing.assert_allclose(a, [10, 20, 30], atol=1e-4)


@pytest.mark.parametrize("alpha", [0.1, 100.0])
def test_ridge_closed_form(table, alpha):
    pdf, df = table
    names = ["feature1", "feature2", "wave"]
    x = pdf[names].to_numpy()
    centred, target = x - x.mean(0), pdf.y - pdf.y.mean()
    w = np.linalg.solve(centred.T @ centred + alpha * np.eye(3), centred.T @ target)
    got = Ridge(alpha).fit(df, names).transform(df).orderBy("ts").toPandas().yhat
    np.testing.assert_allclose(got, pdf.y.mean() + centred @ w, rtol=1e-9)


def test_elastic_net_is_optimal(table):
    pdf, df = table
    names, alpha, l1 = ["feature1", "feature2", "wave"], 0.3, 0.5
    model = ElasticNet(alpha, l1).fit(df, names)
    w = np.array(model.coefficients)
    x = pdf[names].to_numpy() - pdf[names].to_numpy().mean(0)
    rest = pdf.y.to_numpy() - pdf.y.mean() - x @ w
    slope = x.T @ rest / len(pdf) - alpha * (1 - l1) * w
    for s, c in zip(slope, w):  # the subgradient conditions of the penalised problem
        assert abs(s - np.sign(c) * alpha * l1) < 1e-6 if c else abs(s) <= alpha * l1 + 1e-6
    assert (w == 0).any() and (w != 0).any()


def test_forest_and_boosting_learn_the_wave(table):
    _, df = table
    for kind, params in (("random_forest", {"n_estimators": 10, "maxDepth": 5}), ("lightgbm", {"n_estimators": 40}),
                         ("gradient_boosting", {"maxIter": 10, "maxDepth": 3})):
        model = create_model(kind, **params).fit(df, ["wave", "feature1"])
        assert model.evaluate(df).first().r2 > 0.6


def test_quantile_boosting(spark, table, tmp_path):
    pdf, df = table
    short = create_model("gradient_boosting_quantile", n_estimators=2, max_depth=3, learning_rate=0.5)
    long = create_model("gradient_boosting_quantile", n_estimators=12, max_depth=3, learning_rate=0.5, sort_crossing=True)
    a, b = short.fit(df, ["wave"]), long.fit(df, ["wave"])
    la, lb = a.evaluate_quantiles(df).first(), b.evaluate_quantiles(df).first()
    for q in ("q10", "q50", "q90"):
        assert lb[f"pinball_loss_{q}"] < la[f"pinball_loss_{q}"]
    assert 0.7 < lb.coverage_probability < 0.9
    out = b.transform(df).orderBy("ts").toPandas()
    assert ((out.q10 <= out.q50) & (out.q50 <= out.q90)).all()
    assert 0.05 < (out.y < out.q10).mean() < 0.15
    assert b.evaluate(df).first().r2 > 0.6
    b.save(str(tmp_path / "q"))
    again = load_model(spark, str(tmp_path / "q"))
    back = again.transform(df).orderBy("ts").toPandas()
    np.testing.assert_allclose(back[["q10", "q50", "q90"]], out[["q10", "q50", "q90"]])
    without = create_model("gradient_boosting_quantile", quantiles=[0.29], n_estimators=1).fit(df, ["wave"])
    assert "q29" in without.transform(df).columns
    with pytest.raises(ValueError):
        without.predict_median(df)


def test_grid_search_uses_expanding_folds(table):
    pdf, df = table
    blocks = folded(df, GRID).groupBy("_block").agg({"ts": "max", "*": "count"}).orderBy("_block").collect()
    assert [b["count(1)"] for b in blocks] == [181, 180, 180, 180]
    search = GridSearch("Enhanced Ridge", Ridge, [{"alpha": a} for a in (1.0, 1e6)], GRID)
    model = search.fit(df, ["wave", "feature1"])
    assert search.best_params == {"alpha": 1.0} and model.details["best_params"] == {"alpha": 1.0}
    errors = []
    for k in (1, 2, 3):
        end = 721 - 180 * (4 - k)
        train, test = pdf.iloc[:end], pdf.iloc[end:end + 180]
        x = train[["wave", "feature1"]].to_numpy()
        c = x - x.mean(0)
        w = np.linalg.solve(c.T @ c + np.eye(2), c.T @ (train.y - train.y.mean()))
        p = train.y.mean() + (test[["wave", "feature1"]].to_numpy() - x.mean(0)) @ w
        errors.append(((test.y - p) ** 2).mean())
    assert search.results[0]["mean_mse"] == pytest.approx(np.mean(errors), rel=1e-9)


def test_searches_over_trees(table):
    _, df = table
    assert len(FOREST_GRID) == 27 and len(BOOSTING_GRID) == 18 and len(RIDGE_GRID) == 4 and len(ELASTIC_GRID) == 9
    for kind, grid in (("enhanced_random_forest", [{"n_estimators": 2, "maxDepth": d} for d in (1, 4)]),
                       ("enhanced_lightgbm", [{"maxIter": 2, "stepSize": 0.5, "maxDepth": d} for d in (1, 3)])):
        search = create_model(kind, spec=GRID, grid=grid)
        model = search.fit(df, ["wave"])
        assert search.best_params["maxDepth"] == grid[1]["maxDepth"] and model.evaluate(df).first().r2 > 0.5


def test_ensemble(table):
    _, df = table
    members = [create_model("linear"), create_model("random_forest", n_estimators=5, maxDepth=4)]
    for holdout in (False, True):
        fitted = Ensemble(members, GRID, holdout).fit(df, ["wave", "feature1"])
        assert sum(fitted.member_weights) == pytest.approx(1) and min(fitted.member_weights) >= 0
        shares = fitted.contributions(df).orderBy("ts").toPandas()
        total = fitted.transform(df).orderBy("ts").toPandas().yhat
        np.testing.assert_allclose(shares["Linear Regression"] + shares["Random Forest"], total)


class Broken:
    """Fits, but cannot predict: at once, or only when the rows are read."""

    def __init__(self, late):
        self.name, self.late = f"Broken {late}", late

    def fit(self, df, features, target):
        return self

    def transform(self, df):
        return df.selectExpr("*", "raise_error('no prediction') + 0D AS yhat" if self.late else "no_such_column AS yhat")


@pytest.mark.parametrize("late", [False, True])
def test_a_member_that_cannot_predict(table, late):
    _, df = table
    fitted = Ensemble([Broken(late), create_model("linear")], GRID).fit(df, ["wave"])
    assert fitted.member_weights == [0, 1] and list(fitted.errors) == [0]
    assert ("no prediction" if late else "no_such_column") in fitted.errors[0]
    alone = create_model("linear").fit(df, ["wave"]).evaluate(df).first()
    assert fitted.evaluate(df).first().rmse == pytest.approx(alone.rmse)
    shares = fitted.contributions(df).first()
    assert shares[f"Broken {late}"] == 0 and shares["Linear Regression"] == shares.yhat
    later = Ensemble([create_model("linear"), create_model("linear")], GRID).fit(df, ["wave"])
    later.members[0] = Broken(False)  # fails only after it was weighted
    assert later.transform(df).where("yhat IS NOT NULL").count() == 721 and list(later.errors) == [0]
    nothing = Ensemble([Broken(late)], GRID).fit(df, ["wave"])
    assert nothing.member_weights == [0] and nothing.transform(df).first().yhat == 0


def test_weights_are_equal_when_all_fail(spark):
    df = spark.createDataFrame([(1.0, 9.0, -9.0), (2.0, 8.0, 7.0), (3.0, -5.0, 6.0)], "y double, a double, b double")
    assert weights(df, "y", ["a", "b"]).first().asDict() == {"weight_a": 0.5, "weight_b": 0.5}


def test_selection(table):
    pdf, df = table
    wide = df.selectExpr("*", "1.0D AS flat", "CASE WHEN feature1 > 3 THEN 1D END AS rare", "wave * 2 + feature1 * 0.1 AS near")
    names = ["feature1", "feature2", "wave", "flat", "rare", "near"]
    assert select.usable(wide, names) == ["feature1", "feature2", "wave", "near"]
    assert select.select(wide, names, max_features=6) == names
    chosen = select.select(wide, names, max_features=2, numTrees=5, maxDepth=4)
    assert set(chosen) == {"wave", "near"}
    r = np.corrcoef(pdf.wave, pdf.y)[0, 1]
    got = {x.feature: x.f_score for x in select.f_scores(wide, ["wave"]).collect()}
    assert got["wave"] == pytest.approx(r * r / (1 - r * r) * 719)


def test_scalers(table):
    pdf, df = table
    names = ["feature1", "wave"]
    flat = df.withColumnRenamed("feature2", "other").selectExpr("*", "3.0D AS flat")
    robust = Scaler("robust").fit(flat, [*names, "flat"]).transform(flat).orderBy("ts").toPandas()
    standard = Scaler("standard").fit(flat, [*names, "flat"]).transform(flat).orderBy("ts").toPandas()
    for c in names:
        x = pdf[c]
        np.testing.assert_allclose(robust[c], (x - x.median()) / (x.quantile(0.75) - x.quantile(0.25)), atol=1e-12)
        np.testing.assert_allclose(standard[c], (x - x.mean()) / x.std(ddof=0), atol=1e-9)
    assert (robust["flat"] == 0).all() and (standard["flat"] == 0).all()
    with pytest.raises(ValueError):
        Scaler("minmax")


def test_forecast_keeps_lags_and_moves_the_calendar(spark, table):
    _, df = table
    basic = features.basic(df.select("ts", "y"), GRID)
    rows = forecast.future_rows(basic, GRID, 5).orderBy("ts").toPandas()
    last = basic.orderBy("ts").toPandas().iloc[-1]
    assert list(rows.hour) == [(last.ts.hour + i) % 24 for i in range(1, 6)]
    for c in ("y_lag_1", "y_rolling_mean_24", "day_of_year", "week_of_year"):
        assert (rows[c] == last[c]).all()


def test_train_and_forecast(table):
    _, df = table
    one = forecast.train_and_forecast(df.select("ts", "y"), GRID, horizon=1, with_intervals=True).collect()
    assert len(one) == 1 and one[0].yhat_lower <= one[0].yhat <= one[0].yhat_upper
    assert one[0].model_name == "Linear Regression" and one[0].model_version == "1.0"
    q = forecast.train_and_forecast(df.select("ts", "y"), GRID, "gradient_boosting_quantile", 3, n_estimators=2, max_depth=2)
    assert q.count() == 3 and q.where("yhat IS NULL").count() == 0
