import datetime as dt

import numpy as np
import pandas as pd
import pytest
from frames import hourly, to_spark
from pyspark.sql import functions as F

from loadcast.operators import project, resample, splits
from loadcast.operators.chunks import bucket_us, with_position
from loadcast.operators.quantiles import exact_quantiles, value_at_rank
from loadcast.series import SeriesSpec

GRID = SeriesSpec(step="1 hour")
RAW = SeriesSpec()


def irregular(n=500, seed=5):
    rng = np.random.default_rng(seed)
    t = pd.Timestamp("2024-03-01 05:17") + pd.to_timedelta(np.cumsum(rng.integers(1, 40000, n)), unit="s")
    y = rng.normal(0, 10, n)
    y[::7] = np.nan
    return pd.DataFrame({"ts": t, "y": y})


@pytest.mark.parametrize("step,freq", [("1 hour", "1h"), ("15 minutes", "15min"), ("1 day", "1D"), ("100 minutes", "100min")])
@pytest.mark.parametrize("how", ["mean", "sum", "first", "last", "min", "max"])
def test_resample_equals_pandas(spark, step, freq, how):
    pdf = irregular(120)
    got = resample.resample(to_spark(spark, pdf), RAW, step, how).orderBy("ts").toPandas()
    want = pdf.set_index("ts").y.resample(freq).agg(how)
    assert list(got.ts) == list(want.index)
    np.testing.assert_allclose(got.y.astype(float), want.to_numpy(), rtol=1e-12, equal_nan=True)


def test_unknown_aggregate_raises(spark):
    with pytest.raises(ValueError):
        resample.resample(to_spark(spark, irregular(10)), RAW, "1 hour", "mode")


def test_spine_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(resample, "BINS_PER_BLOCK", 16)
    pdf = irregular(60)
    got = resample.spine(to_spark(spark, pdf), RAW, "1 hour").orderBy("ts").toPandas()
    want = pdf.set_index("ts").y.resample("1h").mean().index
    assert list(got.ts) == list(want)


def test_horizon_limits():
    assert resample.horizon_steps(3, "days") == 72 and resample.horizon_steps(168) == 168
    assert resample.horizon_steps(40, "days") == 960
    for bad in ((0, "hours"), (1, "weeks"), (169, "hours", {"hours": 168}), (15, "days", {"days": 14})):
        with pytest.raises(ValueError):
            resample.horizon_steps(*bad)


def test_frequency_names(spark):
    for freq, name in (("15min", "15min"), ("h", "1h"), ("D", "1d"), ("90s", "custom_90s")):
        pdf = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=30, freq=freq), "y": 1.0})
        assert resample.detect_frequency(to_spark(spark, pdf), RAW).first().frequency == name
    one = to_spark(spark, irregular(1))
    assert resample.detect_frequency(one, RAW).first().frequency == "unknown"


@pytest.mark.parametrize("rows", [3, 50, 10**6])
def test_positions_over_buckets(spark, rows):
    pdf = irregular(300)
    burst = pd.DataFrame({"ts": pd.Timestamp("2024-03-02") + pd.to_timedelta(np.arange(200), unit="us"), "y": 0.0})
    pdf = pd.concat([pdf, burst], ignore_index=True)
    got = with_position(to_spark(spark, pdf), RAW, "p", rows).orderBy("ts").toPandas()
    assert list(got.p) == list(range(500))


def test_one_busy_stamp_spreads_over_tasks(spark):
    """Date-only stamps: a whole day shares one, and its ties tell the order."""
    spec = SeriesSpec((), "ts", "y", tie=("id",))
    df = spark.range(20_000).select(F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"),
                                    F.col("id").cast("double").alias("y"), (F.col("id") * 7919 % 20_011).alias("id"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # would put the few rows together again
    try:
        placed = with_position(df, spec, "p", 1000).withColumn("task", F.spark_partition_id()).toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert (placed.sort_values("id").p.to_numpy() == np.arange(20_000)).all()
    assert placed.groupby("task").size().max() < 12_000 and placed.task.nunique() > 2


def test_buckets_shrink_for_bursts(spark):
    times = [pd.Timestamp("2024-01-01") + pd.Timedelta(microseconds=i) for i in range(1000)]
    times += [pd.Timestamp("2024-06-01")]
    df = to_spark(spark, pd.DataFrame({"ts": times, "y": 1.0}))
    assert bucket_us(df, RAW, 10) <= 40


@pytest.mark.parametrize("rows", [3, 10, 10**6])
def test_gaps_across_ranges(spark, rows):
    pdf = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=48, freq="h"), "y": 1.0})
    gaps = resample.successive_gaps(to_spark(spark, pdf), RAW, rows).collect()
    assert [(g.gap_us, g.n) for g in gaps] == [(3_600_000_000, 47)]


@pytest.mark.parametrize("rows", [7, 10**6])
def test_gaps_of_series_with_bursts(spark, rows):
    """A stamp that holds most rows, other series beside it, stamps that are not known."""
    rng = np.random.default_rng(8)
    stamps = [pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=int(m)) for m in rng.integers(0, 400, 90)]
    stamps += [pd.Timestamp("2024-01-02")] * 300 + [pd.NaT] * 3
    pdf = pd.DataFrame({"ts": stamps, "y": 1.0, "k": [None, "a", "b"] * 131})
    spec = SeriesSpec(("k",), "ts", "y")
    df = spark.createDataFrame([(None if pd.isna(t) else t.to_pydatetime(), y, k)
                                for t, y, k in pdf.itertuples(index=False)], "ts timestamp_ntz, y double, k string")
    got = {(r.k, r.gap_us): r.n for r in resample.successive_gaps(df, spec, rows).collect()}
    want = {}
    for k, part in pdf.groupby("k", dropna=False):
        for gap in part.ts.dropna().sort_values().diff().dropna():
            key = (k if isinstance(k, str) else None, int(gap.total_seconds() * 1e6))
            want[key] = want.get(key, 0) + 1
    assert got == want
    found = {r.k: (r.n_rows, r.gap_us) for r in resample.detect_frequency(df, spec, rows).collect() if r.k}
    assert found == {k: (131, 0) for k in "ab"}


def test_newest_rows_beyond_the_group_limit(spark):
    pdf = irregular(3000)
    pdf["k"] = np.where(np.arange(3000) % 3 == 0, "a", "b")
    df = to_spark(spark, pdf)
    spec = SeriesSpec(("k",))
    got = project.newest_rows(df, spec, 1500).toPandas()
    want = pdf.sort_values("ts").groupby("k").tail(1500)
    assert sorted(got.ts) == sorted(want.ts)


def test_temporal_split_counts(spark):
    df = to_spark(spark, hourly(101, nulls=0, leading=0))
    for spec in (GRID, RAW):
        rows = splits.temporal(df, spec).groupBy("split").count().collect()
        assert {r.split: r["count"] for r in rows} == {"train": 80, "test": 21}


def test_gap_split(spark):
    df = to_spark(spark, hourly(1000, nulls=0, leading=0))
    rows = splits.with_gap(df, GRID).groupBy("split").agg({"ts": "max", "*": "count"}).collect()
    assert {r.split: r["count(1)"] for r in rows} == {"train": 632, "gap": 168, "test": 200}
    with pytest.raises(Exception, match="shorter than test and gap"):
        splits.with_gap(to_spark(spark, hourly(100)), GRID).collect()


def test_random_split_is_exact_and_repeatable(spark):
    df = to_spark(spark, irregular(333))
    runs = [sorted(r.ts for r in splits.random(df, RAW).where("split = 'test'").collect()) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 67
    other = sorted(r.ts for r in splits.random(df, RAW, seed=7).where("split = 'test'").collect())
    assert other != runs[0]


def test_folds_never_train_on_the_future(spark):
    df = to_spark(spark, hourly(103, nulls=0, leading=0))
    got = splits.expanding_folds(df, GRID).toPandas()
    for fold, part in got.groupby("fold"):
        train, test = part[part.role == "train"], part[part.role == "test"]
        assert train.ts.max() < test.ts.min() and len(test) == 25
        assert len(train) == 103 - 25 * (3 - fold)


@pytest.mark.parametrize("limit", [5, 60, 10**6])
def test_exact_quantiles_by_narrowing(spark, limit):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 4000, p=[0.9, 0.1]), "u": rng.lognormal(0, 3, 4000),
                        "v": np.where(rng.random(4000) < 0.4, 0.0, rng.normal(size=4000))})
    df = to_spark(spark, pdf)
    levels = {"low": 0.01, "q1": 0.25, "mid": 0.5, "high": 0.993}
    for keys in ((), ("k",)):
        got = exact_quantiles(df, ["u", "v"], levels, keys, limit).toPandas()
        for row in got.itertuples():
            part = pdf if not keys else pdf[pdf.k == row.k]
            for name, p in levels.items():
                assert getattr(row, name) == pytest.approx(part[row.column].quantile(p), rel=1e-12, abs=1e-15)


def test_value_at_rank(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1000 AS v")
    rank = spark.createDataFrame([(123,)], "rank long")
    assert value_at_rank(df, "v", rank, (), 10).first().value == 123.0


def test_last_row_and_tail(spark):
    df = to_spark(spark, hourly(50, leading=0))
    assert project.last_row(df, GRID).first().ts == dt.datetime(2024, 12, 22, 1)
    assert project.tail(df, GRID, 7).count() == project.tail(df, RAW, 7).count() == 7
