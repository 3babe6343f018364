import numpy as np
import pandas as pd
import pytest
from frames import basic_twin, comprehensive_twin, compact_twin, hourly, same, to_spark

from loadcast.functions import calendar as cal
from loadcast.operators.ewma import with_ewma
from loadcast.operators.fill import fill
from loadcast.operators.windows import with_lags, with_rolling, with_rolling_median
from loadcast.plans import features
from loadcast.series import SeriesSpec, epoch_us, step_us

GRID = SeriesSpec(step="1 hour")
COUNTED = SeriesSpec()


def sorted_frame(df):
    return df.orderBy(*[c for c in ("k", "ts") if c in df.columns]).toPandas().reset_index(drop=True)


def test_calendar_columns_present(spark):
    pdf = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=24, freq="h"), "value": np.arange(24.0)})
    out = to_spark(spark, pdf).withColumns(cal.temporal("ts"))
    assert len(cal.temporal("ts")) == 17
    for c in ("hour", "day_of_week", "month", "hour_sin", "hour_cos", "is_weekend", "is_business_hour"):
        assert c in out.columns
    assert [r.hour for r in out.orderBy("ts").select("hour").collect()] == list(range(24))


def test_features_rename_the_target(spark):
    pdf = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=50, freq="h"),
                        "consommation_mw": 100 + 10 * np.sin(2 * np.pi * np.arange(50) / 24)})
    out = features.basic(to_spark(spark, pdf), GRID)
    assert "y" in out.columns and "consommation_mw" not in out.columns
    assert {"hour", "y_lag_1", "y_rolling_mean_3"} <= set(out.columns)
    assert out.where("y IS NULL").count() == 0
    assert len(out.columns) == 1 + 1 + 35


@pytest.mark.parametrize("spec", [GRID, COUNTED], ids=["grid", "counted"])
def test_basic_equals_pandas(spark, spec):
    pdf = hourly()
    got = sorted_frame(features.basic(to_spark(spark, pdf), spec))
    want = basic_twin(pdf)
    same(got, want, want.columns)
    assert len(want.columns) == 36


def test_comprehensive_equals_pandas(spark):
    pdf = hourly()
    got = sorted_frame(features.comprehensive(to_spark(spark, pdf), GRID))
    want = comprehensive_twin(pdf)
    assert sorted(got.columns) == sorted(["ts", *want.columns])
    assert len(want.columns) == 115
    ratios = [c for c in want.columns if "_zscore_" in c or "_percentile_" in c]
    same(got, want, [c for c in want.columns if c not in ratios], 1e-7)
    for c in ratios:  # where a window is constant, pandas leaves rounding noise for a deviation
        spread = want[f"y_rolling_std_{c.rsplit('_', 1)[1]}"] > 1e-6
        same(got[spread], want[spread], [c], 1e-7)


def test_compact_equals_pandas(spark):
    pdf = hourly()
    got = sorted_frame(features.compact(to_spark(spark, pdf), GRID))
    want = compact_twin(pdf)
    assert len(got.columns) == 2 + 14
    same(got, want, [c for c in got.columns if c != "ts"])
    few = features.compact(to_spark(spark, pdf), GRID, max_features=3)
    assert few.columns == ["ts", "y", "hour", "day_of_week", "month"]


def two_series(spark):
    a, b = hourly(900, seed=3, nulls=0.3), hourly(70, seed=4, start="2025-02-01")
    pdf = pd.concat([a.assign(k="a"), b.assign(k="b")])[["k", "ts", "y"]]
    return pdf, to_spark(spark, pdf)


def test_chunked_equals_unbroken(spark):
    _, df = two_series(spark)
    for spec in (SeriesSpec(("k",), step="1 hour"), SeriesSpec(("k",))):
        whole = sorted_frame(features.basic(df, spec))
        cut = sorted_frame(features.basic(df, spec, rows_per_chunk=400))
        same(cut, whole, [c for c in whole.columns if c not in ("k", "ts")], 1e-12)
    whole = sorted_frame(features.comprehensive(df, SeriesSpec(("k",), step="1 hour")))
    cut = sorted_frame(features.comprehensive(df, SeriesSpec(("k",), step="1 hour"), rows_per_chunk=400))
    same(cut, whole, [c for c in whole.columns if c not in ("k", "ts")], 1e-9)


def test_series_are_independent(spark):
    pdf, df = two_series(spark)
    got = sorted_frame(features.basic(df, SeriesSpec(("k",), step="1 hour")))
    for k, part in pdf.groupby("k"):
        want = basic_twin(part.reset_index(drop=True))
        same(got[got.k == k].reset_index(drop=True), want, want.columns)


def test_ewma_over_long_null_runs(spark):
    pdf = hourly(3000, nulls=0.2)
    pdf.loc[500:2200, "y"] = np.nan
    alphas = [0.01, 0.1, 0.3, 0.7, 0.95]
    got = sorted_frame(with_ewma(to_spark(spark, pdf), GRID, alphas, rows_per_chunk=700))
    want = pd.DataFrame({f"y_ewma_{str(a).replace('.', '_')}": pdf.y.ewm(alpha=a).mean() for a in alphas})
    same(got, want, want.columns, 1e-12)


@pytest.mark.parametrize("rows", [None, 7, 60])
def test_fill_crosses_chunks(spark, rows):
    pdf = hourly(300, nulls=0.5, leading=20)
    pdf.loc[100:180, "y"] = np.nan
    df = to_spark(spark, pdf)
    for forward, backward, twin in ((True, False, pdf.y.ffill()), (False, True, pdf.y.bfill()),
                                    (True, True, pdf.y.ffill().bfill())):
        got = sorted_frame(fill(df, GRID, ["y"], forward, backward, rows_per_chunk=rows))
        same(got, pd.DataFrame({"y": twin}), ["y"], 1e-15)


def test_one_row_and_empty_series(spark):
    one = to_spark(spark, pd.DataFrame({"ts": [pd.Timestamp("2024-01-01")], "y": [5.0]}))
    row = with_rolling(one, GRID).first()
    assert row.y_rolling_mean_24 == 5.0 and row.y_rolling_std_24 is None
    none = one.where("y > 9")
    for spec in (GRID, COUNTED):
        assert with_lags(none, spec).count() == 0
    lost = to_spark(spark, hourly(30, nulls=0, leading=30))
    assert features.basic(lost, GRID).count() == 0


def test_frames_must_fit_the_halo(spark):
    df = to_spark(spark, hourly(50))
    from loadcast.operators.chunks import Chunks
    c = Chunks(df, GRID, 10)
    with pytest.raises(ValueError):
        c.last_rows(12)
    with pytest.raises(ValueError):
        c.lag("y", 11)


def test_wall_clock_survives_daylight_saving(spark):
    pdf = pd.DataFrame({"ts": [pd.Timestamp("2024-03-31 02:30:00"), pd.Timestamp("2024-07-01 12:00:00.000007")], "y": [1.0, 2.0]})
    df = to_spark(spark, pdf)
    expected = [int(t.value // 1000) for t in pdf.ts]
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
        got = [r[0] for r in df.select(epoch_us(df, "ts").alias("u")).orderBy("u").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == expected


def test_local_time_calendar(spark):
    df = spark.sql("SELECT TIMESTAMP'2024-07-01 06:30:00' AS ts")
    row = df.withColumns(cal.temporal("ts", "Europe/Paris")).first()
    assert row.hour == 8 and row.is_peak_hour == 1


def test_iso_weeks(spark):
    df = spark.sql("SELECT explode(array(DATE'2024-12-30', DATE'2021-01-03', DATE'2024-02-29')) AS ts")
    weeks = {str(r.ts): (r.week_of_year, r.is_month_end) for r in
             df.withColumns({**cal.temporal("ts"), **cal.advanced("ts")}).collect()}
    assert weeks == {"2024-12-30": (1, 0), "2021-01-03": (53, 0), "2024-02-29": (9, 1)}


def test_steps():
    assert step_us("15 minutes") == 900_000_000
    for bad in ("1 month", "0 hours", "hour", "1.5 hours"):
        with pytest.raises(ValueError):
            step_us(bad)


def test_median_in_every_chunk(spark):
    pdf = hourly(500, nulls=0.2)
    got = sorted_frame(with_rolling_median(to_spark(spark, pdf), GRID, [5, 48], rows_per_chunk=50))
    want = pd.DataFrame({f"y_rolling_median_{w}": pdf.y.rolling(w, min_periods=1).median() for w in (5, 48)})
    same(got, want, want.columns)
