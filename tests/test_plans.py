"""The physical plans are the ones meant: few shuffles, filters in the scan, no Python."""

import re

import pytest
from pyspark.sql import functions as F

from loadcast import catalogue as cat
from loadcast.ml import create_model
from loadcast.operators import project, resample, windows
from loadcast.plans import features
from loadcast.series import SeriesSpec
from loadcast.session import keep_table
from loadcast.sources import records


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange (?:hash|range|Single)", plan(df)))


@pytest.fixture(scope="module")
def grid(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("grid") / "hourly")
    cat.hourly(spark, folder, "sum").write.parquet(path)
    return spark.read.parquet(path)


def test_one_shuffle_and_sort_for_all_windows(grid):
    for df in (windows.with_lags(grid, cat.HOURLY), windows.with_rolling(grid, cat.HOURLY),
               windows.with_rolling_quartiles(grid, cat.HOURLY)):
        text = plan(df)
        assert exchanges(df) == 1 and text.count("Sort [") == 1
        assert "hashpartitioning(event_type" in text and "_chunk" in text


def test_no_window_without_a_chunk(grid):
    """A window over a whole series is only ever taken over chunk summaries."""
    for df in (features.basic(grid, cat.HOURLY), features.comprehensive(grid, cat.HOURLY)):
        for node in re.findall(r"Window \[.*", plan(df)):
            partition = re.search(r"windowspecdefinition\((.*?) ASC", node).group(1)
            assert "_chunk" in partition or "_carry" in node or "_head" in node


def test_resample_combines_before_its_shuffle(spark, folder):
    df = resample.resample(cat.table(spark, folder, "events"), cat.EVENTS, "1 hour", "mean")
    text = plan(df)
    assert "Join" not in text and "partial_avg" in text
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in text


def test_filters_reach_the_scan(spark, folder):
    df = records.newest(cat.table(spark, folder, "events"), cat.EVENTS.with_(keys=()), 50, F.col("event_type") == "view")
    text = plan(df)
    assert "TakeOrderedAndProject" in text and "EqualTo(event_type,view)" in text and "IsNotNull(value)" in text


def test_group_limit_before_the_shuffle(spark, folder):
    df = project.tail(cat.table(spark, folder, "events"), cat.EVENTS, 100)
    assert plan(df).count("WindowGroupLimit") == 2


def test_last_row_is_an_aggregate(spark, folder):
    text = plan(project.last_row(cat.table(spark, folder, "events"), cat.EVENTS))
    assert "Window" not in text and "partial_max_by" in text


def test_metrics_are_one_aggregate(spark, folder):
    p = cat.by_model(cat.predictions(spark, folder))
    from loadcast.plans.audit import leaderboard
    text = plan(leaderboard(p))
    assert text.count("HashAggregate(keys=[model") == 2 and "Python" not in text


@pytest.mark.parametrize("name", cat.QUERIES)
def test_no_python_and_no_cross_join(spark, folder, name):
    if name in ("random_forest", "gradient_boosting", "quantile_boosting", "feature_selection", "ensemble_forecast",
                "ensemble_round_trip", "ingest_stream", "ingest_corrected", "deep_tree", "forest_grid", "boosting_grid",
                "ensemble_default"):
        pytest.skip("long fits or a stream while the query is built; test_model_plans looks at the models")
    check_nodes(plan(cat.QUERIES[name](spark, folder)))


@pytest.mark.parametrize("name,params", [
    ("linear", {}), ("random_forest", {"n_estimators": 3, "maxDepth": 3}), ("lightgbm", {"n_estimators": 2}),
    ("gradient_boosting_quantile", {"n_estimators": 2, "max_depth": 2})])
def test_model_plans(spark, folder, name, params):
    """Predicting neither shuffles nor leaves the JVM, and the table it reads is the one that was given."""
    rows, names = cat.daily_model_table(spark, folder)
    stored = keep_table(rows)
    text = plan(create_model(name, **params).fit(stored, names).transform(stored))
    check_nodes(text)
    assert "Exchange" not in text and text.count("Scan parquet") == 1


def check_nodes(text):
    for node in ("PythonUDF", "EvalPython", "MapInPandas", "FlatMapGroups", "CartesianProduct", "NestedLoopJoin"):
        assert node not in text


def test_single_series_is_not_one_task(spark):
    """One series without keys still spreads over partitions."""
    df = spark.range(200_000).selectExpr("timestampadd(HOUR, CAST(id AS INT), TIMESTAMP_NTZ'2000-01-01 00:00:00') AS ts",
                                         "rand(1) AS y")
    out = windows.with_rolling(df, SeriesSpec(step="1 hour"), [24], rows_per_chunk=2000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 8 and max(sizes) < 60_000
