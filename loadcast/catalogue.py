"""Every operator as a query over the given tables.

Two base series are derived from the tables: hourly event values per event type on a
gap-free grid, and daily order totals as one series without keys.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import calendar as cal
from .functions import metrics as M
from .ml import create_model, load_model
from .ml import ensemble, scale, select
from .ml.linear import ElasticNet, Ridge
from .ml.quantile import quantile_name
from .ml.search import enhanced_linear
from .operators import evaluate as ev
from .operators import ewma, fairness as fair, fill, profile, project, resample, splits, windows
from .operators.chunks import Chunks, beside, with_position
from .operators.quantiles import exact_quantiles
from .plans import audit, features, forecast
from .series import SeriesSpec, add, q
from .session import shared_folder
from .sources import records, store
from .sources.merge import read_merged
from .streaming.ingest import ingest, ingest_merged

Query = Callable[[SparkSession, str], DataFrame]

EVENTS = SeriesSpec(("event_type",), "ts", "value", tie=("event_id",))
HOURLY = SeriesSpec(("event_type",), "ts", "y", step="1 hour")
ORDERS = SeriesSpec((), "o_orderdate", "o_totalprice", tie=("o_orderkey",))
DAILY = SeriesSpec((), "ts", "y", step="1 day")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def hourly(spark: SparkSession, folder: str, how: str) -> DataFrame:
    grid = resample.resample(table(spark, folder, "events"), EVENTS, "1 hour", how)
    return grid.withColumnRenamed("value", "y")


def daily(spark: SparkSession, folder: str, how: str = "sum") -> DataFrame:
    grid = resample.resample(table(spark, folder, "orders"), ORDERS, "1 day", how)
    return grid.withColumnsRenamed({"o_orderdate": "ts", "o_totalprice": "y"})


def presented(df: DataFrame, places: int = 6) -> DataFrame:
    """Integers as bigint and fractions rounded, so that two engines can be compared.

    The value is moved a hair off the tie first, because engines break ties differently.
    """
    out = []
    for f in df.schema.fields:
        c = q(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = f"round(CAST({c} AS DOUBLE) + {0.00037 * 10 ** -places!r}D, {places}) + 0D"
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = f"CAST({c} AS BIGINT)"
        out.append(f"{c} AS {q(f.name)}")
    return df.selectExpr(*out)


def _resampled(how: str) -> Query:
    return lambda spark, d: presented(hourly(spark, d, how))


def _features(add: Callable[..., DataFrame], how: str = "sum", **options) -> Query:
    return lambda spark, d: presented(add(hourly(spark, d, how), HOURLY, **options))


# -- sources, projections ---------------------------------------------------------------

def newest_n(spark, d):
    rows = records.newest(table(spark, d, "events"), EVENTS, 100, F.col("event_type") != "error")
    return presented(rows.select("event_type", "event_id", "ts", "value"))


def newest_overall(spark, d):
    spec = EVENTS.with_(keys=())
    rows = records.newest(table(spark, d, "events"), spec, 1000, F.col("event_type") == "view")
    return presented(rows.select("event_type", "event_id", "ts", "value"))


def fallback_source(spark, d):
    events = table(spark, d, "events")
    chosen = records.first_non_empty(events.where(F.col("event_type") == "outage"), events)
    return presented(chosen.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 2)


def record_lines(spark: SparkSession, d: str) -> DataFrame:
    """Each event as a JSON record: fields absent, null or unreadable by turns."""
    e = table(spark, d, "events")
    value = F.col("value").cast("string")
    turn = F.col("event_id") % 4
    entries = F.concat(
        F.lit('{"id": "'), F.col("event_id").cast("string"), F.lit('"'),
        F.when(F.col("event_id") % 10 == 9, ', "date_heure": "not a time"').otherwise(
            F.concat(F.lit(', "date_heure": "'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('+00:00"'))),
        F.lit(', "consommation": '), value,
        F.when(turn == 0, "").when(turn == 1, ', "gaz": null').when(turn == 2, ', "gaz": "n/a"')
        .otherwise(F.concat(F.lit(', "gaz": '), value)),
        F.when(turn == 0, "").otherwise(F.concat(F.lit(', "taux_co2": '), value)),
        F.lit("}"))
    return e.select("event_id", entries.alias("value"))


def _record_columns(parsed: DataFrame, keep: list[str]) -> DataFrame:
    stamp = F.col("date_heure").cast("timestamp_ntz")
    return presented(parsed.select(*keep, stamp.alias("date_heure"), "y", "consommation", "gaz",
                                   "fioul", "taux_co2", "prevision_j1", "ech_comm_italie"))


def ingest_records(spark, d):
    return _record_columns(records.parse_records(record_lines(spark, d), keep=["event_id"]), ["event_id"])


def ingest_stream(spark, d):
    """The same records landed as files and taken in by a stream."""
    folder = shared_folder(spark, "stream")
    record_lines(spark, d).select("value").write.text(f"{folder}/landed")
    ingest(spark, f"{folder}/landed", f"{folder}/table", f"{folder}/state").awaitTermination()
    return _record_columns(spark.read.parquet(f"{folder}/table"), [])


def ingest_corrected(spark, d):
    """Records landed, landed again, and some corrected later: one row each, as corrected."""
    folder = shared_folder(spark, "corrected")
    lines = record_lines(spark, d)
    new = lines.where("event_id % 50 = 0").select(
        F.regexp_replace("value", '"consommation": [^,}]*', '"consommation": 1.5').alias("value"))
    for some in (lines.select("value"), lines.select("value"), new):
        some.write.mode("append").text(f"{folder}/landed")
        ingest_merged(spark, f"{folder}/landed", f"{folder}/table", f"{folder}/state").awaitTermination()
    return _record_columns(read_merged(spark, f"{folder}/table"), [])


def report_round_trip(spark, d):
    path = shared_folder(spark, "report")
    board = audit.leaderboard(by_model(predictions(spark, d)))
    store.write_report(board, path)
    return presented(store.read_report(spark, path, board.schema.simpleString()[7:-1].replace(":", " ")))


def forecast_round_trip(spark, d):
    path = shared_folder(spark, "forecasts")
    made = forecast.naive_last(hourly(spark, d, "mean"), HOURLY, 24, with_intervals=True)
    store.write_forecasts(made, path, ["event_type"])
    return presented(spark.read.schema(made.schema).parquet(path))


def model_round_trip(spark, d):
    path = shared_folder(spark, "model")
    rows, _ = daily_model_table(spark, d)
    create_model("linear").fit(rows, ["y_lag_1"], "y").save(path)
    return presented(load_model(spark, path).transform(rows).select("ts", "yhat"))


def resolve_target(spark, d):
    rows = table(spark, d, "events").select(
        "event_id", F.col("value").alias("consommation"), F.lit(0.0).alias("y"))
    return presented(project.resolve_target(rows))


def content_key(spark, d):
    o = table(spark, d, "orders")
    key = project.content_key("o_orderkey", "o_orderstatus", priority="o_orderpriority")
    return o.select("o_orderkey", key.alias("content_key"))


def format_timestamp(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", project.format_timestamp("ts").alias("stamp"),
                    project.format_timestamp("ts", "%Y-%m-%dT%H:%M:%S").alias("iso"))


def clip(spark, d):
    o = table(spark, d, "orders")
    return presented(o.select("o_orderkey", project.clip("o_totalprice").alias("clipped")), 2)


def round_display(spark, d):
    l = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 7).alias("share"))
    return presented(project.rounded(l, ["share"], 2), 2)


def drop_missing_target(spark, d):
    return presented(project.drop_missing(hourly(spark, d, "mean"), "y"))


def select_features(spark, d):
    return presented(project.select_features(
        table(spark, d, "lineitem"), "l_extendedprice", ["l_shipdate", "l_returnflag", "l_linestatus"]))


def fill_zero(spark, d):
    return presented(project.fill_constant(hourly(spark, d, "mean"), 0.0, ["y"]))


def fixed_interval(spark, d):
    c = table(spark, d, "customer")
    return presented(c.select("c_custkey", *[e.alias(n) for n, e in project.fixed_interval("c_acctbal").items()]), 4)


# -- time grid --------------------------------------------------------------------------

def resample_odd_bins(spark, d):
    """A bin size that does not divide a day: bins start at each series' first midnight."""
    return presented(resample.resample(table(spark, d, "events"), EVENTS, "100 minutes", "sum"))


def spine(spark, d):
    return resample.spine(table(spark, d, "events"), EVENTS, "1 hour")


def on_spine(spark, d):
    sparse = project.drop_missing(hourly(spark, d, "mean"), "y")
    return presented(resample.on_spine(sparse, HOURLY, "1 hour"))


def resample_nan(spark, d):
    """Values that arrive as NaN are missing, not the largest."""
    holes = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    grid = resample.resample(table(spark, d, "events").withColumn("value", holes), EVENTS, "1 hour", "max")
    return presented(grid)


def by_time(spark, d):
    return presented(project.by_time(hourly(spark, d, "mean"), HOURLY))


def on_spine_odd(spark, d):
    """Bins of 100 minutes and their spine start at the same midnight."""
    binned = resample.resample(table(spark, d, "events"), EVENTS, "100 minutes", "sum")
    return presented(resample.on_spine(binned, EVENTS, "100 minutes"))


def daily_rollup(spark, d):
    h = hourly(spark, d, "mean").withColumns(project.fixed_interval("y"))
    return presented(resample.rollup(h, HOURLY, "daily", ["y", "yhat_lower", "yhat_upper"]))


def detect_frequency(spark, d):
    raw = resample.detect_frequency(table(spark, d, "events"), EVENTS).withColumn("series", F.lit("events"))
    grid = resample.detect_frequency(hourly(spark, d, "sum"), HOURLY.with_(step=None)).withColumn(
        "series", F.lit("hourly"))
    return presented(raw.unionByName(grid))


def tail_n(spark, d):
    return presented(project.tail(hourly(spark, d, "mean"), HOURLY, 200))


def tail_raw(spark, d):
    rows = project.tail(table(spark, d, "events"), EVENTS, 250)
    return presented(rows.select("event_type", "event_id", "ts", "value"))


def row_position(spark, d):
    return presented(with_position(table(spark, d, "events"), EVENTS, "position").select(
        "event_type", "event_id", "position"))


# -- calendar ---------------------------------------------------------------------------

def calendar(spark, d):
    e = table(spark, d, "events")
    return presented(e.select("event_id", *[c.alias(n) for n, c in cal.temporal("ts").items()]))


def calendar_orders(spark, d):
    o = table(spark, d, "orders")
    return presented(o.select("o_orderkey", *[c.alias(n) for n, c in cal.temporal("o_orderdate").items()]))


def calendar_advanced(spark, d):
    o = table(spark, d, "orders")
    return presented(o.select("o_orderkey", *[c.alias(n) for n, c in cal.advanced("o_orderdate").items()]))


def interactions(spark, d):
    h = windows.with_lags(hourly(spark, d, "sum"), HOURLY, [1, 24]).withColumns(cal.temporal("ts"))
    joint = cal.interactions(h.columns)
    return presented(h.select("event_type", "ts", *[c.alias(n) for n, c in joint.items()]))


def fourier(spark, d):
    placed = with_position(daily(spark, d), DAILY, "i")
    return presented(placed.select("ts", *[c.alias(n) for n, c in cal.fourier(F.col("i")).items()]))


def group_labels(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", *[c.alias(n) for n, c in cal.group_labels("o_orderdate").items()])


# -- windows ----------------------------------------------------------------------------

def ffill(spark, d):
    return presented(fill.fill(hourly(spark, d, "mean"), HOURLY, ["y"], backward=False))


def bfill(spark, d):
    return presented(fill.fill(hourly(spark, d, "mean"), HOURLY, ["y"], forward=False))


def handle_missing(spark, d):
    return presented(fill.handle_missing(hourly(spark, d, "mean"), HOURLY))


def fill_median(spark, d):
    return presented(fill.fill_median(hourly(spark, d, "mean"), HOURLY, ["y"]))


# -- complete feature sets --------------------------------------------------------------

def features_basic(spark, d):
    return presented(features.basic(hourly(spark, d, "mean"), HOURLY), 4)


def features_basic_daily(spark, d):
    return presented(features.basic(daily(spark, d), DAILY), 2)


def features_compact(spark, d):
    return presented(features.compact(hourly(spark, d, "mean"), HOURLY), 4)


def features_comprehensive(spark, d):
    return presented(features.comprehensive(daily(spark, d), DAILY), 2)


def features_advanced(spark, d):
    return presented(features.advanced_windows(hourly(spark, d, "sum"), HOURLY), 4)


# -- splits -----------------------------------------------------------------------------

def split_temporal(spark, d):
    return presented(splits.temporal(table(spark, d, "events"), EVENTS).select("event_type", "event_id", "split"))


def split_gap(spark, d):
    return presented(splits.with_gap(hourly(spark, d, "sum"), HOURLY))


def split_random(spark, d):
    drawn = splits.random(table(spark, d, "events"), EVENTS)
    return drawn.where(F.col("split") == "test").select("event_type", "event_id")


def folds(spark, d):
    return presented(splits.expanding_folds(hourly(spark, d, "sum"), HOURLY))


def validation_tail(spark, d):
    return presented(splits.validation_tail(daily(spark, d), DAILY), 2)


# -- metrics ----------------------------------------------------------------------------

def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Simple predictions of the hourly means, with a deviation and three quantiles."""
    h = hourly(spark, d, "mean")
    c = Chunks(h, HOURLY, 24)
    day = c.last_rows(24)
    out = add(c.frame, {
        "lag_1": c.lag("y", 1), "lag_24": c.lag("y", 24), "mean_24": f"avg(y) {day}",
        "sigma": f"stddev_samp(y) {day}", "_q": f"percentile(y, array(0.1D, 0.5D, 0.9D)) {day}"})
    out = c.settle(out)
    return out.withColumns({n: F.col("_q")[i] for i, n in enumerate(("q10", "q50", "q90"))}).drop("_q")


def by_model(p: DataFrame) -> DataFrame:
    models = [F.struct(F.lit(m).alias("model"), F.col(m).alias("yhat")) for m in ("lag_1", "lag_24", "mean_24")]
    return (p.withColumn("_m", F.explode(F.array(*models)))
            .select("event_type", "ts", "y", "sigma", "q10", "q50", "q90", "_m.model", "_m.yhat"))


def metrics_point(spark, d):
    return presented(ev.score(by_model(predictions(spark, d)), "y", "yhat", ["model", "event_type"]))


def metrics_aligned(spark, d):
    """Truth and predictions as two tables, matched on series and time."""
    p = predictions(spark, d)
    pairs = ev.align(hourly(spark, d, "mean"), p.select("event_type", "ts", "lag_24"), HOURLY)
    return presented(ev.score(pairs, "y", "lag_24", ["event_type"]))


def mape_plain(spark, d):
    h = windows.with_lags(hourly(spark, d, "sum"), HOURLY, [1])
    return presented(h.groupBy("event_type").agg(
        M.mape("y", "y_lag_1", 0.0).alias("mape"), M.zero_truth("y").alias("zero_truth")))


def metrics_quantile(spark, d):
    return presented(ev.score_quantiles(predictions(spark, d), "y", ["q10", "q50", "q90"], ["event_type"]))


def quantile_leaderboard(spark, d):
    return presented(audit.quantile_leaderboard(predictions(spark, d), ["q10", "q50", "q90"], by="event_type"))


def metrics_interval(spark, d):
    return presented(ev.score_interval(predictions(spark, d), "y", "q10", "q90"))


def crps(spark, d):
    p = by_model(predictions(spark, d))
    return presented(p.groupBy("model").agg(M.crps_gaussian("y", "yhat", "sigma").alias("crps")))


def labelled(spark, d):
    return fair.with_groups(by_model(predictions(spark, d)), "ts",
                            {"kind": F.when(F.col("event_type") == "purchase", "sale").otherwise("other")})


def group_metrics(spark, d):
    return presented(fair.group_metrics(labelled(spark, d), "y", "yhat", ["model"], [*cal.GROUPINGS, "kind"]))


def metric_by_group(spark, d):
    return presented(ev.metric_by_group(labelled(spark, d), "y", "yhat", "event_type", M.rmse, ["model"]))


def fairness_parity(spark, d):
    return presented(fair.parity(labelled(spark, d), "y", "yhat", ["model"], [*cal.GROUPINGS, "kind"]))


def coverage_by_group(spark, d):
    return presented(fair.group_coverage(fair.with_groups(predictions(spark, d), "ts"), "y", "q10", "q90"))


def coverage_parity(spark, d):
    return presented(fair.coverage_parity(fair.with_groups(predictions(spark, d), "ts"), "y", "q10", "q90"))


def fairness_summary(spark, d):
    return presented(audit.fairness_report(by_model(predictions(spark, d)), "ts", lower="q10", upper="q90"))


def compare_fairness(spark, d):
    return presented(fair.compare_fairness(audit.fairness_report(by_model(predictions(spark, d)), "ts")))


def least_disparity(spark, d):
    summary = audit.fairness_report(by_model(predictions(spark, d)), "ts")
    return presented(fair.least_disparity(summary, "variance").withColumn("criterion", F.lit("variance")).unionByName(
        fair.least_disparity(summary, "range").withColumn("criterion", F.lit("range"))))


def leaderboard(spark, d):
    board = audit.leaderboard(by_model(predictions(spark, d)))
    return presented(ev.compare(ev.to_long(board, ["model"]), ["mae", "mse", "rmse", "mape", "r2"]))


def best_model(spark, d):
    return presented(ev.best_model(audit.leaderboard(by_model(predictions(spark, d))), "rmse"))


def plausibility(spark, d):
    out = ev.plausibility(by_model(predictions(spark, d)), "y", "yhat", ["model"])
    return presented(out.withColumn("warnings", F.array_join("warnings", "; ")))


def kpis(spark, d):
    return presented(profile.kpis(predictions(spark, d), "mean_24", ["event_type"]))


# -- profiles ---------------------------------------------------------------------------

def completeness(spark, d):
    return presented(profile.completeness(predictions(spark, d)))


def describe(spark, d):
    return presented(profile.describe(table(spark, d, "lineitem"), [
        "l_quantity", "l_extendedprice", "l_discount", "l_tax"]), 4)


def range_stats(spark, d):
    return presented(profile.range_stats(table(spark, d, "events"), EVENTS), 4)


def overview(spark, d):
    return presented(profile.overview(table(spark, d, "events"), EVENTS))


def validate(spark, d):
    o = table(spark, d, "orders")
    good = profile.validate(o, ["o_orderkey"], 100).withColumn("case", F.lit("complete"))
    bad = profile.validate(o, ["o_orderkey", "load"], 100).withColumn("case", F.lit("missing column"))
    both = good.unionByName(bad)
    return both.withColumn("reasons", F.array_join("reasons", "; "))


def exact_quantile_table(spark, d):
    """Exact quantiles of whole columns by repeated narrowing, without sorting them."""
    return presented(exact_quantiles(table(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"],
                                     {"p05": 0.05, "p50": 0.5, "p99": 0.99}, ["l_returnflag"],
                                     sort_limit=2000), 4)


# -- scaling, selection, models ---------------------------------------------------------

def scale_robust(spark, d):
    o = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax")
    return presented(scale.Scaler("robust").fit(o, ["l_quantity", "l_extendedprice", "l_tax"]).transform(o))


def scale_standard(spark, d):
    h = hourly(spark, d, "sum")
    return presented(scale.Scaler("standard").fit(h, ["y"], ["event_type"]).transform(h))


def daily_model_table(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    rows = windows.with_lags(daily(spark, d), DAILY, [1, 7]).withColumns(
        {n: c for n, c in cal.temporal("ts").items() if n in ("dow_sin", "dow_cos", "month_sin", "month_cos")})
    rows = rows.withColumns({"y": F.col("y") / 1e6, "y_lag_1": F.coalesce("y_lag_1", F.lit(0.0)) / 1e6,
                             "y_lag_7": F.coalesce("y_lag_7", F.lit(0.0)) / 1e6})
    return rows, ["y_lag_1", "y_lag_7", "dow_sin", "dow_cos", "month_sin", "month_cos"]


def f_scores(spark, d):
    rows, names = daily_model_table(spark, d)
    return presented(select.f_scores(rows, names))


def feature_selection(spark, d):
    """The features of the forest and the F scores; the names depend on the trees, their number does not."""
    rows, names = daily_model_table(spark, d)
    chosen = select.select(rows, names, max_features=3)
    counted = rows.select("ts", "y", *chosen).agg(F.count("*").alias("n_rows"))
    return counted.withColumns({"n_chosen": F.lit(len(chosen)).cast("bigint"),
                                "all_given": F.lit(set(chosen) <= set(names))})


def simple_ols(spark, d):
    rows, _ = daily_model_table(spark, d)
    fitted = create_model("linear").fit(rows, ["y_lag_1"], "y")
    return presented(fitted.transform(rows).select("ts", "yhat"))


def model_scores(spark, d):
    rows, _ = daily_model_table(spark, d)
    return presented(create_model("linear").fit(rows, ["y_lag_7"], "y").evaluate(rows), 3)


def _wave(spark, d):
    _, cosine = cal.cycle(F.hour("ts"), 24)
    return hourly(spark, d, "sum").withColumn("hour_cos", cosine)


def ridge(spark, d):
    rows = _wave(spark, d)
    return presented(Ridge(100.0).fit(rows, ["hour_cos"]).transform(rows).select("event_type", "ts", "yhat"))


def elastic_net(spark, d):
    rows = _wave(spark, d)
    return presented(ElasticNet(0.1, 0.5).fit(rows, ["hour_cos"]).transform(rows).select(
        "event_type", "ts", "yhat"))


def _searched(spark, d, regularization: str, columns: str) -> DataFrame:
    search = enhanced_linear(HOURLY, regularization)
    search.fit(_wave(spark, d), ["hour_cos"])
    rows = [(*map(float, r["params"].values()), r["mean_mse"], r["params"] == search.best_params) for r in search.results]
    return presented(spark.createDataFrame(rows, f"{columns}, mean_mse double, best boolean"))


def grid_search(spark, d):
    return _searched(spark, d, "ridge", "alpha double")


def elastic_grid(spark, d):
    return _searched(spark, d, "elastic", "alpha double, l1_ratio double")


def ridge_grid(spark, d):
    """The search on all basic features: the chosen setting has the least error, and its error beats the mean's."""
    rows = features.basic(hourly(spark, d, "sum"), HOURLY)
    names = features.feature_names(rows, HOURLY)
    search = enhanced_linear(HOURLY)
    model = search.fit(features.model_table(rows, HOURLY, names), names)
    errors = {r["params"]["alpha"]: r["mean_mse"] for r in search.results}
    plain = rows.agg(F.var_pop("y")).first()[0]
    made = [(a, e == min(errors.values()), search.best_params["alpha"] == a, bool(e < plain), len(model.coefficients))
            for a, e in errors.items()]
    return presented(spark.createDataFrame(made, "alpha double, least boolean, best boolean, better boolean, n_features int")
                     .select("alpha", (F.col("least") == F.col("best")).alias("best_is_least"), "better", "n_features"))


def ensemble_weights(spark, d):
    return presented(ensemble.weights(predictions(spark, d), "y", ["lag_1", "mean_24", "q50"], ["event_type"]))


def contributions(spark, d):
    p = predictions(spark, d).select("event_type", "ts", "y", "lag_1", "mean_24", "q50")
    names = ["lag_1", "mean_24", "q50"]
    w = ensemble.weights(p, "y", names)
    return presented(ensemble.contributions(p, w, names))


def random_forest(spark, d):
    """Means of means: no prediction leaves the range of the target."""
    rows, names = daily_model_table(spark, d)
    predicted = create_model("random_forest").fit(rows, names).transform(rows)
    ends = rows.agg(F.min("y").alias("_lo"), F.max("y").alias("_hi"))
    return presented(beside(predicted, ends, ()).select("ts", "y", F.col("yhat").between(
        F.col("_lo") - 1e-9, F.col("_hi") + 1e-9).alias("in_range")))


def deep_tree(spark, d):
    """One tree over all rows, grown until it cannot split, predicts the mean of each day of the week."""
    rows = daily(spark, d).withColumn("dow", F.dayofweek("ts").cast("double"))
    fitted = create_model("random_forest", n_estimators=1, bootstrap=False).fit(rows, ["dow"])
    return presented(fitted.transform(rows).select("ts", "yhat"), 2)


def _tree_grid(spark, d, kind: str, columns: str) -> DataFrame:
    """All settings of a search; the chosen one has the least error."""
    rows, names = daily_model_table(spark, d)
    search = create_model(kind, spec=DAILY)
    search.fit(rows, names)
    least = min(r["mean_mse"] for r in search.results)
    made = [(*r["params"].values(), (r["mean_mse"] == least) == (r["params"] == search.best_params)) for r in search.results]
    return presented(spark.createDataFrame(made, f"{columns}, best_is_least boolean"))


def forest_grid(spark, d):
    return _tree_grid(spark, d, "enhanced_random_forest", "trees int, depth int, least_split int, least_leaf int")


def boosting_grid(spark, d):
    return _tree_grid(spark, d, "enhanced_lightgbm", "rounds int, rate double, depth int")


def ensemble_default(spark, d):
    """The three searched members of the default ensemble, each with a share of the forecast."""
    rows, names = daily_model_table(spark, d)
    fitted = create_model("ensemble", spec=DAILY).fit(rows, names)
    whole = abs(sum(fitted.member_weights) - 1) < 1e-9
    made = [(m.name, len(m.details["results"]), whole and 0 <= w <= 1) for m, w in
            zip(fitted.members, fitted.member_weights, strict=True)]
    return presented(spark.createDataFrame(made, "member string, settings int, is_share boolean"))


def gradient_boosting(spark, d):
    """Boosted trees explain more of the target than its mean does."""
    rows, names = daily_model_table(spark, d)
    scores = create_model("lightgbm").fit(rows, names).evaluate(rows)
    return scores.select(F.col("n_scored").alias("n_rows"), (F.col("r2") > 0).alias("better_than_mean"))


def boosted_stump(spark, d):
    """One tree of one split on a yes-or-no feature predicts the means of the two groups."""
    rows = daily(spark, d).withColumn("weekend", cal.is_weekend(F.col("ts")).cast("int"))
    fitted = create_model("gradient_boosting", maxIter=1, maxDepth=1).fit(rows, ["weekend"])
    return presented(fitted.transform(rows).select("ts", "yhat"), 2)


def _weekends(spark: SparkSession, d: str) -> DataFrame:
    return daily(spark, d).withColumn("weekend", cal.is_weekend(F.col("ts")).cast("int"))


def leaf_boosting_stumps(spark, d):
    """Two rounds of two leaves on a yes-or-no feature go half the way to the means of the two groups each time."""
    rows = _weekends(spark, d)
    fitted = create_model("lightgbm", n_estimators=2, learning_rate=0.5, num_leaves=2, feature_fraction=1.0,
                          bagging_fraction=1.0).fit(rows, ["weekend"])
    return presented(fitted.transform(rows).select("ts", "yhat"), 2)


def quantile_boosting_stumps(spark, d):
    """The same with quantiles: half the way from those of all rows to those of the two groups, twice."""
    rows = _weekends(spark, d)
    fitted = create_model("gradient_boosting_quantile", n_estimators=2, learning_rate=0.5, max_depth=1).fit(rows, ["weekend"])
    return presented(fitted.transform(rows).select("ts", *[quantile_name(p) for p in fitted.quantiles]), 2)


def quantile_boosting(spark, d):
    """Each boosted quantile loses less than the plain quantile of the target."""
    rows, names = daily_model_table(spark, d)
    model = create_model("gradient_boosting_quantile").fit(rows, names)
    quantiles = {quantile_name(p): p for p in model.quantiles}
    plain = rows.agg(*[F.percentile("y", p).alias(f"_{n}") for n, p in quantiles.items()])
    both = beside(model.transform(rows).select("y", *quantiles), plain, ())
    losses = both.agg(*[e for n, p in quantiles.items() for e in (
        M.pinball("y", n, p).alias(n), M.pinball("y", f"_{n}", p).alias(f"_{n}"))])
    return losses.select(F.explode(F.array(*[F.struct(F.lit(n).alias("quantile"), (
        F.col(n) < F.col(f"_{n}")).alias("better")) for n in quantiles])).alias("r")).select("r.*")


def _ensemble(rows: DataFrame, names: list[str]):
    return create_model("ensemble", spec=DAILY, members=[create_model("linear"), create_model("random_forest")]).fit(
        rows, names)


def ensemble_forecast(spark, d):
    """The members' shares add up to the forecast, and the weights to one."""
    rows, names = daily_model_table(spark, d)
    fitted = _ensemble(rows, names)
    shares = sum((F.col(f"`{m.name}`") for m in fitted.members[1:]), F.col(f"`{fitted.members[0].name}`"))
    one = F.lit(abs(sum(fitted.member_weights) - 1) < 1e-9 and min(fitted.member_weights) >= 0)
    return fitted.contributions(rows).select("ts", (F.abs(shares - F.col("yhat")) < 1e-9).alias("adds_up"),
                                             one.alias("weights_are_shares"))


def ensemble_round_trip(spark, d):
    rows, names = daily_model_table(spark, d)
    fitted = _ensemble(rows, names)
    path = shared_folder(spark, "ensemble")
    fitted.save(path)
    again = load_model(spark, path).transform(rows.select("ts", *names)).select("ts", F.col("yhat").alias("again"))
    return fitted.transform(rows).join(again, "ts").select(
        "ts", (F.abs(F.col("yhat") - F.col("again")) < 1e-9).alias("same"))


# -- forecasts --------------------------------------------------------------------------

def forecast_naive(spark, d):
    return presented(forecast.naive_last(hourly(spark, d, "mean"), HOURLY, 24, with_intervals=True))


def forecast_rows(spark, d):
    """The rows a model is asked about: last features, refreshed calendar."""
    basic = features.basic(hourly(spark, d, "mean"), HOURLY)
    rows = forecast.future_rows(basic, HOURLY, resample.horizon_steps(2, "days"))
    return presented(rows, 4)


def forecast_linear(spark, d):
    return presented(forecast.train_and_forecast(
        hourly(spark, d, "sum"), HOURLY, "linear", 24, with_intervals=True))


TWO = ["y_lag_24", "hour_cos"]


def _two_features(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    h = hourly(spark, d, "sum")
    return h, features.model_table(features.basic(h, HOURLY), HOURLY, TWO)


def forecast_two_features(spark, d):
    """A day ahead from a least-squares fit on two features, which SQL can solve too."""
    h, rows = _two_features(spark, d)
    fitted = create_model("linear").fit(rows, TWO)
    return presented(forecast.forecast(features.basic(h, HOURLY), HOURLY, fitted.transform, 24,
                                       model_name=fitted.name, inputs=TWO))


def forecast_per_series(spark, d):
    """Each series by its own line through the value of a day before."""
    h = hourly(spark, d, "sum")
    rows = features.basic(h, HOURLY)
    fitted = create_model("linear_per_series", spec=HOURLY).fit(features.model_table(rows, HOURLY, TWO[:1]), TWO[:1])
    return presented(forecast.forecast(rows, HOURLY, fitted.transform, 24, model_name=fitted.name, inputs=TWO[:1]))


def per_series_search(spark, d):
    """The penalty of each series, chosen over its own time folds, and its line."""
    fitted = create_model("enhanced_per_series", spec=HOURLY).fit(_wave(spark, d), ["hour_cos"])
    return presented(fitted.table.select("event_type", F.col("_n").alias("n_rows"), F.col("_alpha").alias("alpha"),
                                         F.col("_intercept").alias("intercept"), F.col("_w0").alias("weight")))


def forecast_saved(spark, d):
    """The same from the newest saved model of the type; an older one lies beside it."""
    h, rows = _two_features(spark, d)
    registry = shared_folder(spark, "registry")
    for day, names in ((1, ["y_lag_24"]), (2, TWO)):
        path = shared_folder(spark, "model")
        create_model("linear").fit(rows, names).save(path)
        store.register_model(spark, registry, "linear", "Linear Regression", path, dt.datetime(2024, 1, day))
    return presented(forecast.forecast_latest(h, HOURLY, store.read_registry(spark, registry), "linear", 24))


def latest_model(spark, d):
    """Orders stand in for training runs: the newest run per kind."""
    o = table(spark, d, "orders")
    runs = o.select(F.col("o_orderpriority").alias("model_type"), F.lit("run").alias("name"),
                    F.concat(F.lit("models/"), F.col("o_orderkey").cast("string")).alias("path"),
                    F.col("o_orderdate").alias("trained_at"))
    return store.latest_model(runs, "URGENT").unionByName(store.latest_model(runs))


def flagship(spark, d):
    """Hourly grid, calendar, lags and rolling means, a temporal split, and two naive
    models scored on the test rows of every series."""
    h = hourly(spark, d, "sum")
    c = Chunks(h.withColumns(cal.temporal("ts")), HOURLY, 167)
    frame = add(c.frame, windows.lag_columns(c, "y", windows.BASIC_LAGS))
    rows = splits.temporal(c.settle(windows.add_moments(frame, c, "y", windows.BASIC_WINDOWS)), HOURLY)
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("yhat"))
                                 for m in ("y_lag_1", "y_lag_24", "y_rolling_mean_24")])).alias("m")
    test = rows.where(F.col("split") == "test").select(
        "event_type", "is_peak_hour", "y", models).select("event_type", "is_peak_hour", "y", "m.*")
    scores = test.groupBy("event_type", "model", "is_peak_hour").agg(
        M.mae("y", "yhat").alias("mae"), M.rmse("y", "yhat").alias("rmse"), M.r2("y", "yhat").alias("r2"),
        M.scored("y", "yhat").alias("n_scored"))
    return presented(scores)


QUERIES: dict[str, Query] = {
    "flagship": flagship,
    "newest_n": newest_n,
    "newest_overall": newest_overall,
    "fallback_source": fallback_source,
    "ingest_records": ingest_records,
    "ingest_stream": ingest_stream,
    "ingest_corrected": ingest_corrected,
    "report_round_trip": report_round_trip,
    "forecast_round_trip": forecast_round_trip,
    "model_round_trip": model_round_trip,
    "resolve_target": resolve_target,
    "content_key": content_key,
    "format_timestamp": format_timestamp,
    "clip": clip,
    "round_display": round_display,
    "drop_missing_target": drop_missing_target,
    "select_features": select_features,
    "fill_zero": fill_zero,
    "fixed_interval": fixed_interval,
    **{f"resample_{how}": _resampled(how) for how in resample.AGGREGATES},
    "resample_odd_bins": resample_odd_bins,
    "spine": spine,
    "on_spine": on_spine,
    "on_spine_odd": on_spine_odd,
    "resample_nan": resample_nan,
    "by_time": by_time,
    "daily_rollup": daily_rollup,
    "detect_frequency": detect_frequency,
    "tail_n": tail_n,
    "tail_raw": tail_raw,
    "row_position": row_position,
    "calendar": calendar,
    "calendar_orders": calendar_orders,
    "calendar_advanced": calendar_advanced,
    "interactions": interactions,
    "fourier": fourier,
    "group_labels": group_labels,
    "lags": _features(windows.with_lags, lags=windows.ADVANCED_LAGS),
    "rolling_mean_std": _features(windows.with_rolling, windows=windows.ADVANCED_WINDOWS),
    "rolling_range": _features(windows.with_rolling_range),
    "rolling_median": _features(windows.with_rolling_median),
    "rolling_quartiles": _features(windows.with_rolling_quartiles),
    "zscores": _features(windows.with_zscores),
    "ewma": _features(ewma.with_ewma, how="mean", alphas=ewma.ADVANCED_ALPHAS),
    "differences": _features(windows.with_differences),
    "percent_change": _features(windows.with_changes, how="mean"),
    "ffill": ffill,
    "bfill": bfill,
    "handle_missing": handle_missing,
    "fill_median": fill_median,
    "features_basic": features_basic,
    "features_basic_daily": features_basic_daily,
    "features_compact": features_compact,
    "features_advanced": features_advanced,
    "features_comprehensive": features_comprehensive,
    "split_temporal": split_temporal,
    "split_gap": split_gap,
    "split_random": split_random,
    "folds": folds,
    "validation_tail": validation_tail,
    "metrics_point": metrics_point,
    "metrics_aligned": metrics_aligned,
    "mape_plain": mape_plain,
    "metrics_quantile": metrics_quantile,
    "quantile_leaderboard": quantile_leaderboard,
    "metrics_interval": metrics_interval,
    "crps": crps,
    "group_metrics": group_metrics,
    "metric_by_group": metric_by_group,
    "fairness_parity": fairness_parity,
    "coverage_by_group": coverage_by_group,
    "coverage_parity": coverage_parity,
    "fairness_summary": fairness_summary,
    "compare_fairness": compare_fairness,
    "least_disparity": least_disparity,
    "leaderboard": leaderboard,
    "best_model": best_model,
    "plausibility": plausibility,
    "kpis": kpis,
    "completeness": completeness,
    "describe": describe,
    "range_stats": range_stats,
    "overview": overview,
    "validate": validate,
    "exact_quantiles": exact_quantile_table,
    "scale_robust": scale_robust,
    "scale_standard": scale_standard,
    "f_scores": f_scores,
    "feature_selection": feature_selection,
    "simple_ols": simple_ols,
    "model_scores": model_scores,
    "ridge": ridge,
    "elastic_net": elastic_net,
    "grid_search": grid_search,
    "elastic_grid": elastic_grid,
    "ridge_grid": ridge_grid,
    "ensemble_weights": ensemble_weights,
    "contributions": contributions,
    "random_forest": random_forest,
    "deep_tree": deep_tree,
    "forest_grid": forest_grid,
    "boosting_grid": boosting_grid,
    "ensemble_default": ensemble_default,
    "gradient_boosting": gradient_boosting,
    "boosted_stump": boosted_stump,
    "leaf_boosting_stumps": leaf_boosting_stumps,
    "quantile_boosting_stumps": quantile_boosting_stumps,
    "quantile_boosting": quantile_boosting,
    "ensemble_forecast": ensemble_forecast,
    "ensemble_round_trip": ensemble_round_trip,
    "forecast_naive": forecast_naive,
    "forecast_rows": forecast_rows,
    "forecast_linear": forecast_linear,
    "forecast_two_features": forecast_two_features,
    "forecast_per_series": forecast_per_series,
    "per_series_search": per_series_search,
    "forecast_saved": forecast_saved,
    "latest_model": latest_model,
}
