"""Calendar features of a time column, each one expression without a shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The hours and dates the flags are defined by.
BUSINESS_HOURS = (8, 18)
PEAK_HOURS = [8, 9, 10, 18, 19, 20]
COMPACT_PEAK_HOURS = [8, 9, 18, 19, 20]
NIGHT_FROM, NIGHT_UNTIL = 22, 6
MORNING_PEAK, EVENING_PEAK = (8, 10), (18, 20)
LOW_HOURS = (2, 6)
HOLIDAY_MONTHS = [7, 8]
YEAR_END_FROM_DAY, NEW_YEAR_UNTIL_DAY = 20, 10
WINTER, SPRING, SUMMER = [12, 1, 2], [3, 4, 5], [6, 7, 8]
FOURIER_PERIODS = [24, 168, 8760]
FOURIER_HARMONICS = 3


def _flag(condition: Column) -> Column:
    return condition.cast("int")


def cycle(value: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of ``value`` on a circle of ``period``."""
    angle = value * F.lit(2 * math.pi) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def is_weekend(t: Column) -> Column:
    return F.weekday(t) >= 5


def temporal(ts: Column | str, tz: str | None = None) -> dict[str, Column]:
    """The 17 basic calendar columns. ``tz`` shifts UTC instants to local wall time first."""
    t = F.col(ts) if isinstance(ts, str) else ts
    if tz:
        t = F.from_utc_timestamp(t, tz)
    hour, dow, month = F.hour(t), F.weekday(t), F.month(t)
    columns = {
        "hour": hour,
        "day_of_week": dow,
        "day_of_month": F.dayofmonth(t),
        "day_of_year": F.dayofyear(t),
        "week_of_year": F.weekofyear(t),
        "month": month,
        "quarter": F.quarter(t),
    }
    for name, value, period in (("hour", hour, 24), ("dow", dow, 7), ("month", month, 12)):
        columns[f"{name}_sin"], columns[f"{name}_cos"] = cycle(value, period)
    columns["is_weekend"] = _flag(is_weekend(t))
    columns["is_business_hour"] = _flag(hour.between(*BUSINESS_HOURS))
    columns["is_peak_hour"] = _flag(hour.isin(PEAK_HOURS))
    columns["is_night"] = _flag((hour >= NIGHT_FROM) | (hour <= NIGHT_UNTIL))
    return columns


# A forecast keeps these two from the last known row; the other 15 follow the future hour.
NOT_REFRESHED = ["day_of_year", "week_of_year"]


def advanced(ts: Column | str) -> dict[str, Column]:
    """The nine further calendar columns."""
    t = F.col(ts) if isinstance(ts, str) else ts
    hour, dow, day, month = F.hour(t), F.weekday(t), F.dayofmonth(t), F.month(t)
    first_day = day == 1
    last_day = F.to_date(t) == F.last_day(t)
    return {
        "is_business_day": _flag(dow < 5),
        "is_month_start": _flag(first_day),
        "is_month_end": _flag(last_day),
        "is_quarter_start": _flag(first_day & (month % 3 == 1)),
        "is_quarter_end": _flag(last_day & (month % 3 == 0)),
        "week_of_year_norm": (F.weekofyear(t) - 1) / F.lit(51.0),
        "is_holiday_period": _flag(
            month.isin(HOLIDAY_MONTHS)
            | ((month == 12) & (day >= YEAR_END_FROM_DAY))
            | ((month == 1) & (day <= NEW_YEAR_UNTIL_DAY))),
        "hour_weekday_interaction": hour * (dow + 1),
        "month_hour_interaction": month * hour,
    }


def interactions(available: list[str]) -> dict[str, Column]:
    """Products and joint flags, each only when the columns it needs are present."""
    hour, dow, weekend = F.col("hour"), F.col("day_of_week"), F.col("is_weekend")
    candidates = {
        "hour_dow_peak": (
            ["hour", "day_of_week"],
            _flag((hour.between(*MORNING_PEAK) | hour.between(*EVENING_PEAK)) & (dow < 5))),
        "weekend_hour_low": (
            ["is_weekend", "hour"], _flag((weekend == 1) & hour.between(*LOW_HOURS))),
        "lag1_hour_interaction": (["y_lag_1", "hour"], F.col("y_lag_1") * hour),
        "lag24_dow_interaction": (["y_lag_24", "day_of_week"], F.col("y_lag_24") * dow),
    }
    return {name: expr for name, (needs, expr) in candidates.items()
            if set(needs) <= set(available)}


def fourier(position: Column, periods: list[int] | None = None,
            harmonics: int = FOURIER_HARMONICS) -> dict[str, Column]:
    """Cosine and sine of each harmonic of each period at a row position."""
    columns = {}
    for period in periods or FOURIER_PERIODS:
        for k in range(1, harmonics + 1):
            sine, cosine = cycle(position * k, period)
            columns[f"fourier_cos_{period}_{k}"] = cosine
            columns[f"fourier_sin_{period}_{k}"] = sine
    return columns


def group_labels(ts: Column | str) -> dict[str, Column]:
    """The five label columns that error parity is audited over."""
    t = F.col(ts) if isinstance(ts, str) else ts
    hour, month = F.hour(t), F.month(t)
    return {
        "time_of_day": F.when(hour.between(*BUSINESS_HOURS), "business_hours").otherwise("off_hours"),
        "peak_hours": F.when(hour.isin(PEAK_HOURS), "peak").otherwise("off_peak"),
        "season": (F.when(month.isin(WINTER), "winter").when(month.isin(SPRING), "spring")
                   .when(month.isin(SUMMER), "summer").otherwise("autumn")),
        "is_winter": F.when(month.isin(WINTER), "winter").otherwise("non_winter"),
        "weekend": F.when(is_weekend(t), "weekend").otherwise("weekday"),
    }


GROUPINGS = ["time_of_day", "peak_hours", "season", "is_winter", "weekend"]
