import math

import pytest
from pyspark.sql import functions as F

from loadcast.functions import metrics as M
from loadcast.functions.special import erf, normal_cdf
from loadcast.operators import evaluate as ev
from loadcast.operators import fairness as fair
from loadcast.operators import profile, project
from loadcast.series import SeriesSpec


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [("a", 10.0, 12.0), ("a", 20.0, 18.0), ("a", 0.0, 1.0), ("a", None, 5.0), ("a", 7.0, None),
            ("b", 5.0, 5.5), ("b", 5.0, 4.0)]
    return spark.createDataFrame(rows, "model string, y double, yhat double")


def test_point_metrics_by_hand(pairs):
    out = {r.model: r for r in ev.score(pairs, "y", "yhat", ["model"]).collect()}
    a, b = out["a"], out["b"]
    assert a.mae == pytest.approx(5 / 3) and a.mse == pytest.approx(3.0) and a.rmse == pytest.approx(math.sqrt(3))
    assert a.r2 == pytest.approx(1 - 9 / 200)
    assert (a.n_scored, a.n_skipped) == (3, 2)
    assert a.mape == pytest.approx((0.2 + 0.1 + 1e8) / 3 * 100, rel=1e-9)
    assert b.r2 == 0.0  # constant truth


def test_mape_without_epsilon_skips_zero_truth(pairs):
    row = pairs.where("model = 'a'").agg(M.mape("y", "yhat", 0.0).alias("m"), M.zero_truth("y").alias("z")).first()
    assert row.m == pytest.approx(15.0) and row.z == 1


def test_pinball_and_intervals(spark):
    df = spark.createDataFrame([(1.0, 0.0, 2.0), (5.0, 0.0, 2.0), (None, 0.0, 2.0), (1.0, None, 2.0)],
                               "y double, q10 double, q90 double")
    row = ev.score_quantiles(df, "y", ["q10", "q90"]).first()
    assert row.pinball_loss_q10 == pytest.approx((0.1 * 1 + 0.1 * 5) / 2)
    assert row.pinball_loss_q90 == pytest.approx((0.1 + 0.9 * 3 + 0.1) / 3)
    assert row.coverage_probability == 0.25 and row.coverage_deviation == pytest.approx(0.55)
    assert row.average_interval_width == 2.0
    assert df.agg(M.coverage("y", "q10", "q90", count_missing=False)).first()[0] == 0.5
    assert M.quantile_of("q2.5") == 0.025 and M.quantile_of("yhat") is None


def test_erf_over_the_line(spark):
    rows = spark.range(-1300, 1301).select((F.col("id") / 200.0).alias("x")).select(
        "x", erf(F.col("x")).alias("e"), normal_cdf(F.col("x")).alias("c")).collect()
    assert max(abs(r.e - math.erf(r.x)) for r in rows) < 1e-15
    assert max(abs(r.c - (1 + math.erf(r.x / math.sqrt(2))) / 2) for r in rows) < 1e-15


def test_crps_is_not_mae(spark):
    df = spark.createDataFrame([(1.0, 0.0, 1.0), (0.0, 0.0, 2.0), (3.0, 1.0, 0.0)], "y double, p double, s double")
    got = df.agg(M.crps_gaussian("y", "p", "s")).first()[0]

    def crps(z, s):
        cdf, pdf = (1 + math.erf(z / math.sqrt(2))) / 2, math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        return s * (z * (2 * cdf - 1) + 2 * pdf - 1 / math.sqrt(math.pi))
    assert got == pytest.approx((crps(1, 1) + crps(0, 2)) / 2)


def test_best_model(spark):
    board = spark.createDataFrame([("b", 1.0, 0.5), ("a", 1.0, 0.9), ("c", None, 0.1)], "model string, rmse double, r2 double")
    assert ev.best_model(board).first().model == "a"
    assert ev.best_model(board, "r2", ascending=False).first().model == "a"
    assert ev.best_model(board, "r2").first().model == "c"
    with pytest.raises(ValueError):
        ev.best_model(board, "mae")


def test_single_label_has_no_parity(spark):
    df = spark.createDataFrame([("m", "x", "p", 1.0, 2.0), ("m", "x", "q", 1.0, 4.0), ("m", "x", None, 1.0, 9.0)],
                               "model string, one string, two string, y double, yhat double")
    rows = {r.grouping: r for r in fair.parity(df, "y", "yhat", ["model"], ["one", "two"]).collect()}
    assert rows["one"].mae_variance is None and rows["one"].n_groups == 1
    two = rows["two"]
    assert (two.mae_variance, two.mae_range, two.mae_cv) == (1.0, 2.0, 0.5)
    summary = fair.fairness_summary(df, "y", "yhat", ["model"], groupings=["one", "two"])
    assert {r.grouping for r in summary.collect()} == {"two"}
    with pytest.raises(ValueError):
        fair.least_disparity(summary, "cv")


def test_zero_error_has_zero_cv(spark):
    df = spark.createDataFrame([("p", 1.0, 1.0), ("q", 2.0, 2.0)], "g string, y double, yhat double")
    assert fair.parity(df, "y", "yhat", groupings=["g"]).first().mae_cv == 0.0


def test_pluggable_metric(pairs):
    rows = ev.metric_by_group(pairs, "y", "yhat", "model", lambda y, p: F.max(F.abs(F.col(y) - F.col(p)))).collect()
    assert {r.model: r.metric for r in rows} == {"a": 2.0, "b": 1.0}
    assert rows[0].inter_group_variance == 0.25 and rows[0].max_group_difference == 1.0


def test_published_scores_compare(spark):
    published = {  # four models of a re-evaluation on 16,070 rows
        "gradient_boosting_quantile": (3027.59, 4156.64, 0.6319, 6.604), "lightgbm": (3746.91, 4570.67, 0.5550, 8.126),
        "linear": (2870.49, 3907.18, 0.6748, 6.275), "random_forest": (3416.38, 4495.95, 0.5694, 7.390)}
    long = spark.createDataFrame([(m, n, v) for m, vs in published.items()
                                  for n, v in zip(("mae", "rmse", "r2", "mape"), vs)], "model string, metric string, value double")
    table = ev.compare(long, ["mae", "rmse", "r2", "mape"])
    assert ev.best_model(table).first().model == "linear"
    assert ev.best_model(table, "r2", ascending=False).first().model == "linear"
    assert table.count() == 4


def test_validate_and_profile(spark, pairs):
    assert profile.validate(pairs, ["y"], 7).first().is_valid
    bad = profile.validate(pairs, ["load"], 8).first()
    assert not bad.is_valid and bad.reasons == ["fewer than 8 rows", "missing columns: load"]
    assert profile.validate(pairs.where("y > 99")).first().reasons == ["empty"]
    done = {r.column: (r.missing, r.completeness) for r in profile.completeness(pairs).collect()}
    assert done["y"][0] == 1 and done["y"][1] == pytest.approx((1 - 2 / 21) * 100)


def test_content_key_matches_md5(spark):
    import hashlib
    df = spark.createDataFrame([(1, "a", None)], "x int, y string, z string")
    got = df.select(project.content_key("x", "y", "z", b="y", a="x")).first()[0]
    assert got == hashlib.md5(b"1|a|None|a:1|b:a").hexdigest()


def test_projection_edges(spark):
    df = spark.createDataFrame([(None,), (1.0,), (5e5,)], "c double")
    assert [r[0] for r in df.select(project.clip("c")).collect()] == [None, 20000.0, 100000.0]
    row = spark.createDataFrame([(-10.0,)], "c double").select(*[e.alias(n) for n, e in project.fixed_interval("c").items()]).first()
    assert row.yhat_lower == pytest.approx(-11) and row.yhat_upper == pytest.approx(-9)
    nan = spark.createDataFrame([(float("nan"),), (2.0,)], "c double")
    assert [r.c for r in project.nan_to_null(nan, ["c"]).collect()] == [None, 2.0]
    with pytest.raises(ValueError):
        project.resolve_target(df)
    both = spark.createDataFrame([(1.0, 2.0)], "y double, consommation double")
    assert project.resolve_target(both).first().asDict() == {"y": 2.0}
    with pytest.raises(ValueError):
        project.format_timestamp("c", "%Q")
    assert SeriesSpec().with_(step="1 day").step == "1 day"
