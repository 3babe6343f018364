"""Missing, infinite and misplaced values; long series; dependent features; models read back."""

import datetime as dt
import math
import time

import numpy as np
import pandas as pd
import pytest
from frames import hourly, to_spark
from pyspark.sql import functions as F

from loadcast import catalogue as cat
from loadcast.functions import metrics as M
from loadcast.ml import create_model, load_model
from loadcast.ml.least import moments, solve
from loadcast.operators import ewma, fill, profile, resample, windows
from loadcast.operators.quantiles import exact_quantiles, value_at_rank
from loadcast.plans import features, forecast
from loadcast.series import SeriesSpec
from loadcast.sources import store

RAW, GRID = SeriesSpec(), SeriesSpec(step="1 hour")


@pytest.fixture(scope="module")
def nan_and_null(spark):
    """The same series, with missing values as NaN and as null."""
    pdf = hourly(300, seed=8)
    null = to_spark(spark, pdf)
    nan = null.withColumn("y", F.coalesce("y", F.lit(float("nan"))))
    return nan, null


@pytest.mark.parametrize("make", [
    lambda d: resample.resample(d, RAW, "3 hours", "max"), lambda d: resample.resample(d, RAW, "3 hours", "mean"),
    lambda d: windows.with_rolling(d, GRID).drop("y"), lambda d: ewma.with_ewma(d, GRID).drop("y"),
    lambda d: windows.with_changes(d, GRID).drop("y"), lambda d: fill.fill(d, GRID, ["y"]),
    lambda d: features.basic(d, GRID), lambda d: features.compact(d, GRID),
    lambda d: profile.describe(d, ["y"]), lambda d: d.agg(M.mae("y", F.lit(100.0)).alias("a"), M.skipped("y", F.lit(1.0)).alias("b"))])
def test_nan_is_missing(nan_and_null, make):
    a, b = (sorted(map(repr, make(d).collect())) for d in nan_and_null)
    assert a == b and not any("nan" in r for r in a)


@pytest.mark.parametrize("limit", [10, 1_000_000])
@pytest.mark.parametrize("odd", [[math.inf], [-math.inf, math.inf], [math.nan], [1e300, -1e300, 1e-300, 5e-324], [0.0] * 80])
def test_quantiles_end_on_any_input(spark, limit, odd):
    values = [float(i) for i in range(100)] + odd
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = exact_quantiles(df, ["v"], {"p0": 0.0, "p50": 0.5, "p93": 0.93, "p100": 1.0}, sort_limit=limit).first()
    known = sorted(v for v in values if not math.isnan(v))
    for name, p in (("p0", 0.0), ("p50", 0.5), ("p93", 0.93), ("p100", 1.0)):
        h = (len(known) - 1) * p
        low, high = known[math.floor(h)], known[math.ceil(h)]
        want = low if low == high else low + (high - low) * (h - math.floor(h))
        assert got[name] == pytest.approx(want)


def test_ranks_that_share_a_bound(spark):
    """Many ranks of one skewed column, narrowed far."""
    rng = np.random.default_rng(3)
    v = np.round(np.exp(rng.normal(0, 8, 5000)), 3)
    df = spark.createDataFrame([(float(x), "a") for x in v], "v double, k string")
    levels = {f"q{i}": i / 20 for i in range(21)}
    got = exact_quantiles(df, ["v"], levels, ["k"], sort_limit=50).first()
    np.testing.assert_allclose([got[n] for n in levels], np.quantile(v, list(levels.values())), rtol=1e-12)
    rank = spark.createDataFrame([("a", 1234)], "k string, rank bigint")
    assert value_at_rank(df, "v", rank, ["k"], sort_limit=50).first().value == np.sort(v)[1234]


@pytest.mark.parametrize("make", [
    lambda d: windows.with_lags(d, GRID), lambda d: windows.with_lags(d, RAW), lambda d: fill.fill(d, GRID, ["y"])])
def test_null_stamps_are_an_error(spark, make):
    df = to_spark(spark, hourly(20)).union(spark.sql("SELECT CAST(NULL AS TIMESTAMP_NTZ), 1D"))
    with pytest.raises(Exception, match="null in time column"):
        make(df).collect()


@pytest.mark.parametrize("step", ["100 minutes", "7 hours", "1 hour"])
def test_spine_has_the_bins_of_resample(spark, step):
    pdf = hourly(200, nulls=0.0, leading=0)
    pdf["ts"] = pdf.ts + pd.to_timedelta(np.arange(200) % 50, "min")
    binned = resample.resample(to_spark(spark, pdf), RAW, step, "sum")
    placed = resample.on_spine(binned, RAW, step)
    assert placed.count() == binned.count() and placed.where("y IS NULL").isEmpty()
    assert placed.agg(F.sum("y")).first()[0] == pytest.approx(pdf.y.sum())


def test_rows_off_the_grid_are_an_error(spark):
    df = to_spark(spark, hourly(10)).withColumn("ts", F.expr("ts + INTERVAL 1 MINUTE"))
    with pytest.raises(Exception, match="off the grid"):
        resample.on_spine(df, RAW, "1 hour").collect()


@pytest.mark.parametrize("forward,backward", [(True, False), (False, True), (True, True)])
def test_fill_over_groups_of_chunks(spark, monkeypatch, forward, backward):
    monkeypatch.setattr(fill, "CHUNKS_PER_GROUP", 2)
    pdf = hourly(300, seed=4, nulls=0.9)
    got = fill.fill(to_spark(spark, pdf), GRID, ["y"], forward, backward, rows_per_chunk=7).orderBy("ts").toPandas().y
    want = pdf.y
    want = want.ffill() if forward else want
    want = want.bfill() if backward else want
    np.testing.assert_array_equal(got.astype(float), want)


def test_backward_fill_is_linear(spark):
    """40,000 chunks of one series."""
    long = spark.range(80_000).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"),
                                      F.when(F.col("id") % 997 == 0, F.col("id").cast("double")).alias("y"))
    start = time.perf_counter()
    got = fill.fill(long, GRID, ["y"], forward=False, rows_per_chunk=2).agg(F.sum("y"), F.count("y")).first()
    assert time.perf_counter() - start < 20
    known = range(0, 80_000, 997)
    want = sum(997 * k for k in known[1:])
    assert got[0] == want and got[1] == known[-1] + 1


def test_features_read_what_was_stored_once(spark, folder):
    df = features.basic(cat.hourly(spark, folder, "sum"), cat.HOURLY)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert text.count("Scan parquet") == 1 and "Window" not in text


def test_least_squares_of_dependent_features(spark, folder):
    names = ["a", "b", "twice", "constant", "sum"]
    rng = np.random.default_rng(5)
    a, b = rng.normal(1000, 3, 400), rng.normal(0, 1e-3, 400)
    pdf = pd.DataFrame({"a": a, "b": b, "twice": 2 * a, "constant": 7.0, "sum": a + 1000 * b})
    pdf["y"] = 3 * a - 50 * b + rng.normal(0, 1, 400)
    df = spark.createDataFrame(pdf)
    weights, intercept = solve(moments(df, names, "y"))
    x = pdf[names].to_numpy()
    want = np.linalg.lstsq(x - x.mean(0), pdf.y - pdf.y.mean(), rcond=1e-10)[0]
    np.testing.assert_allclose(weights, want, atol=1e-7)
    fitted = create_model("linear").fit(df, names)
    best = ((pdf.y - pdf.y.mean() - (x - x.mean(0)) @ want) ** 2).mean()
    assert fitted.evaluate(df).first().mse == pytest.approx(best, rel=1e-6)


def test_least_squares_on_basic_features(spark, folder):
    table = features.model_table(features.basic(cat.hourly(spark, folder, "sum"), cat.HOURLY), cat.HOURLY)
    names = features.feature_names(table, cat.HOURLY)
    fitted = create_model("linear").fit(table, names)
    pdf = fitted.transform(table).toPandas()
    x = pdf[names].to_numpy(float)
    centred, target = x - x.mean(0), pdf.y - pdf.y.mean()
    best = target - centred @ np.linalg.lstsq(centred, target, rcond=None)[0]
    assert ((pdf.y - pdf.yhat) ** 2).mean() == pytest.approx((best**2).mean(), rel=1e-6)


def test_least_squares_refuses_what_it_cannot_fit(spark):
    for y, x, message in ((None, 1.0, "no row"), (1.0, None, "null values"), (1.0, math.inf, "infinite")):
        df = spark.createDataFrame([(x, y), (2.0, y)], "x double, y double")
        with pytest.raises(ValueError, match=message):
            create_model("linear").fit(df, ["x"])


def test_ensemble_round_trip_and_scores(spark, tmp_path):
    df = to_spark(spark, hourly(200, nulls=0.0, leading=0)).withColumns(
        {"wave": F.sin(F.hour("ts") / 24 * 2 * math.pi), "x": F.col("y") * 0.5})
    members = [create_model("linear"), create_model("random_forest", n_estimators=3, maxDepth=3)]
    fitted = create_model("ensemble", spec=GRID, members=members).fit(df, ["wave", "x"])
    fitted.save(str(tmp_path / "e"))
    again = load_model(spark, str(tmp_path / "e"))
    a, b = (sorted(r.yhat for r in m.transform(df).collect()) for m in (fitted, again))
    np.testing.assert_allclose(a, b)
    assert fitted.evaluate(df).first().r2 > 0.9


def test_forecast_takes_the_newest_saved_model(spark, folder, tmp_path):
    h = cat.hourly(spark, folder, "sum")
    table = features.basic(h, cat.HOURLY)
    registry = str(tmp_path / "registry")
    for i, names in enumerate((["y_lag_1"], ["y_lag_24"])):
        create_model("linear").fit(features.model_table(table, cat.HOURLY, names), names).save(str(tmp_path / f"m{i}"))
        store.register_model(spark, registry, "linear", "Linear Regression", str(tmp_path / f"m{i}"), dt.datetime(2024, 1, 1 + i))
    runs = store.read_registry(spark, registry)
    got = forecast.forecast_latest(h, cat.HOURLY, runs, "linear", 5).orderBy("event_type", "ts").collect()
    newest = load_model(spark, str(tmp_path / "m1"))
    want = forecast.forecast(table, cat.HOURLY, newest.transform, 5, model_name="Linear Regression",
                             inputs=["y_lag_24"]).orderBy("event_type", "ts").collect()
    assert got == want and len(got) > 0
    trained = forecast.forecast_latest(h, cat.HOURLY, runs, "random_forest", 2, n_estimators=2, maxDepth=2)
    assert {r.model_name for r in trained.collect()} == {"Random Forest"}


@pytest.mark.parametrize("limit", [20, 10**6])
def test_quantiles_of_several_columns(spark, limit):
    """Keys of very different size, a column without values in one of them, equal values, levels at the ends."""
    rng = np.random.default_rng(5)
    rows = [("a", float(x), float(round(x)), None) for x in rng.normal(size=3000)]
    rows += [("b", float(x), 7.0, float(-x) if x > 0 else None) for x in rng.normal(size=40)] + [("c", 1.0, None, float("nan"))]
    df = spark.createDataFrame(rows, "k string, x double, y double, z double")
    levels = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p51": 0.51, "p100": 1.0}
    got = {(r.k, r.column): [r[n] for n in levels]
           for r in exact_quantiles(df, ["x", "y", "z"], levels, ["k"], sort_limit=limit).collect()}
    want = {}
    for i, c in enumerate("xyz"):
        for k in "abc":
            values = [r[i + 1] for r in rows if r[0] == k and r[i + 1] is not None and r[i + 1] == r[i + 1]]
            if values:
                want[k, c] = [float(np.quantile(values, p)) for p in levels.values()]
    assert got.keys() == want.keys()
    for spot, values in want.items():
        assert got[spot] == pytest.approx(values, rel=1e-12), spot
    empty = exact_quantiles(df.limit(0), ["x", "y"], levels, ["k"], sort_limit=limit)
    assert empty.count() == 0 and empty.columns == ["k", "column", *levels]
