"""Small seeded series and what pandas makes of them."""

import numpy as np
import pandas as pd


def hourly(n=400, seed=1, nulls=0.15, leading=4, start="2024-12-20"):
    rng = np.random.default_rng(seed)
    t = pd.date_range(start, periods=n, freq="h")
    y = 100 + 10 * np.sin(2 * np.pi * np.arange(n) / 24) + rng.normal(0, 5, n)
    y[rng.random(n) < nulls] = np.nan
    y[:leading] = np.nan
    return pd.DataFrame({"ts": t, "y": y})


def to_spark(spark, pdf, key=None):
    rows = []
    for r in pdf.itertuples(index=False):
        values = [None if isinstance(v, float) and np.isnan(v) else
                  v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in r]
        rows.append(tuple(values))
    kinds = {"ts": "timestamp_ntz", "k": "string"}
    schema = ", ".join(f"{c} {kinds.get(c, 'double')}" for c in pdf.columns)
    return spark.createDataFrame(rows, schema)


def same(got, want, columns, tolerance=1e-9):
    assert len(got) == len(want)
    for c in columns:
        a, b = got[c].astype(float).to_numpy(), want[c].astype(float).to_numpy()
        assert (np.isnan(a) == np.isnan(b)).all(), c
        scale = np.maximum(1.0, np.abs(b))
        assert np.nanmax(np.abs(a - b) / scale, initial=0.0) < tolerance, c


def calendar_twin(t):
    out = pd.DataFrame({"hour": t.hour, "day_of_week": t.dayofweek, "day_of_month": t.day,
                        "day_of_year": t.dayofyear, "week_of_year": np.asarray(t.isocalendar().week, int),
                        "month": t.month, "quarter": t.quarter})
    for name, period in (("hour", 24), ("day_of_week", 7), ("month", 12)):
        short = "dow" if name == "day_of_week" else name
        out[f"{short}_sin"] = np.sin(2 * np.pi * out[name] / period)
        out[f"{short}_cos"] = np.cos(2 * np.pi * out[name] / period)
    out["is_weekend"] = (out.day_of_week > 4).astype(int)
    out["is_business_hour"] = out.hour.between(8, 18).astype(int)
    out["is_peak_hour"] = out.hour.isin([8, 9, 10, 18, 19, 20]).astype(int)
    out["is_night"] = (~out.hour.between(7, 21)).astype(int)
    return out


def basic_twin(pdf):
    out = calendar_twin(pd.DatetimeIndex(pdf.ts))
    y = pdf.y
    out["y"] = y
    for k in (1, 2, 3, 6, 12, 24):
        out[f"y_lag_{k}"] = y.shift(k)
    for w in (3, 6, 12, 24, 168):
        out[f"y_rolling_mean_{w}"] = y.rolling(w, min_periods=1).mean()
        out[f"y_rolling_std_{w}"] = y.rolling(w, min_periods=1).std()
    for a in (0.1, 0.3):
        out[f"y_ewma_0_{int(a * 10)}"] = y.ewm(alpha=a).mean()
    return out.ffill().bfill()


def comprehensive_twin(pdf):
    out = basic_twin(pdf)[[*calendar_twin(pd.DatetimeIndex(pdf.ts)).columns, "y"]].copy()
    t, y, i = pd.DatetimeIndex(pdf.ts), out["y"], np.arange(len(pdf))
    hour, dow = out.hour, out.day_of_week
    out["is_business_day"] = 1 - out.is_weekend
    for edge in ("month_start", "month_end", "quarter_start", "quarter_end"):
        out[f"is_{edge}"] = getattr(t, f"is_{edge}").astype(int)
    out["week_of_year_norm"] = (out.week_of_year - 1) / 51
    out["is_holiday_period"] = (t.month.isin([7, 8]) | ((t.month == 12) & (t.day > 19))
                                | ((t.month == 1) & (t.day < 11))).astype(int)
    out["hour_weekday_interaction"] = hour * (dow + 1)
    out["month_hour_interaction"] = out.month * hour
    cols = {}
    for k in (1, 2, 3, 6, 12, 24, 48, 168):
        cols[f"y_lag_{k}"] = y.shift(k)
    for w in (3, 6, 12, 24, 48, 168):
        roll = y.rolling(w, min_periods=1)
        mean, std = roll.mean(), roll.std()
        cols |= {f"y_rolling_mean_{w}": mean, f"y_rolling_std_{w}": std, f"y_rolling_min_{w}": roll.min(),
                 f"y_rolling_max_{w}": roll.max(), f"y_rolling_median_{w}": roll.median(),
                 f"y_rolling_range_{w}": roll.max() - roll.min(), f"y_zscore_{w}": (y - mean) / (std + 1e-8)}
        if w in (24, 168):
            low, high = roll.quantile(0.25), roll.quantile(0.75)
            cols |= {f"y_q25_{w}": low, f"y_q75_{w}": high, f"y_iqr_{w}": high - low,
                     f"y_percentile_{w}": (y - mean) / (std + 1e-8)}
    for a in (0.1, 0.3, 0.5, 0.7):
        cols[f"y_ewma_0_{int(a * 10)}"] = y.ewm(alpha=a).mean()
    for k in (1, 24):
        cols[f"y_diff_{k}"] = y.diff(k)
        cols[f"y_pct_change_{k}"] = y.pct_change(k)
    cols["hour_dow_peak"] = ((hour.between(8, 10) | hour.between(18, 20)) & (dow < 5)).astype(int)
    cols["weekend_hour_low"] = ((dow > 4) & hour.between(2, 6)).astype(int)
    cols["lag1_hour_interaction"] = cols["y_lag_1"] * hour
    cols["lag24_dow_interaction"] = cols["y_lag_24"] * dow
    for p in (24, 168, 8760):
        for k in (1, 2, 3):
            cols[f"fourier_cos_{p}_{k}"] = np.cos(2 * np.pi * k * i / p)
            cols[f"fourier_sin_{p}_{k}"] = np.sin(2 * np.pi * k * i / p)
    return pd.concat([out, pd.DataFrame(cols)], axis=1).ffill().bfill().fillna(0)


def compact_twin(pdf):
    out = calendar_twin(pd.DatetimeIndex(pdf.ts))
    y = pdf.y
    for k in (1, 24, 168):
        out[f"y_lag_{k}"] = y.shift(k)
    for w in (24, 168):
        out[f"y_rolling_mean_{w}"] = y.rolling(w, min_periods=1).mean()
    out["y_rolling_std_24"] = y.rolling(24, min_periods=1).std()
    out["is_peak_hour"] = out.hour.isin([8, 9, 18, 19, 20]).astype(int)
    out["weekend_evening"] = ((out.day_of_week > 4) & (out.hour > 18)).astype(int)
    out["y"] = y
    return out.ffill().fillna(0)
