"""What a set of time series looks like: keys, time column, target column and step."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNIT_US = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
    "week": 604_800_000_000,
}
DAY_US = _UNIT_US["day"]
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def q(name: str) -> str:
    """A column name quoted for a SQL expression."""
    return "`" + name.replace("`", "``") + "`"


def add(df: DataFrame, named: dict[str, str]) -> DataFrame:
    """Add or replace columns given as SQL expressions, in one projection."""
    kept = [q(c) for c in df.columns if c not in named]
    return df.selectExpr(*kept, *[f"{e} AS {q(n)}" for n, e in named.items()])


def step_us(step: str) -> int:
    """Microseconds in a fixed step such as ``"15 minutes"`` or ``"1 hour"``."""
    match = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", step.lower())
    if not match or match.group(2) not in _UNIT_US or int(match.group(1)) == 0:
        raise ValueError(f"not a fixed time step: {step!r}")
    return int(match.group(1)) * _UNIT_US[match.group(2)]


@dataclass(frozen=True)
class SeriesSpec:
    """Columns that identify and order the rows of many independent series.

    keys    series identity, never null; empty for a single series
    ts      time column, TIMESTAMP or TIMESTAMP_NTZ, unique within a series
    target  numeric column to forecast
    step    set it when the series lies gap-free on a fixed grid (what ``resample``
            returns): row positions then follow from the time stamp by arithmetic.
            Left out, positions are counted.
    tie     extra ordering columns when time stamps repeat within a series
    """

    keys: tuple[str, ...] = ()
    ts: str = "ts"
    target: str = "y"
    step: str | None = None
    tie: tuple[str, ...] = ()

    def with_(self, **changes) -> SeriesSpec:
        return replace(self, **changes)

    @property
    def order(self) -> list[str]:
        return [self.ts, *self.tie]

    @property
    def order_value(self) -> Column:
        """One comparable value for ``min_by`` / ``max_by``."""
        return F.struct(*self.order) if self.tie else F.col(self.ts)


def epoch_us(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970: wall clock for TIMESTAMP_NTZ, instant for TIMESTAMP."""
    if not isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return F.unix_micros(F.col(ts))
    if df.sparkSession.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "GMT", "Z"):
        return F.unix_micros(F.col(ts).cast("timestamp"))
    # elsewhere that cast would bend around daylight saving; the clock fields do not
    seconds = F.unix_date(F.to_date(ts)).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), F.col(ts)) * 1_000_000).cast("long")


def from_epoch_us(df: DataFrame, ts: str, us: Column) -> Column:
    """Inverse of :func:`epoch_us`, in the type that ``ts`` has in ``df``."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return F.timestamp_add("MICROSECOND", us, F.expr(_EPOCH))
    return F.timestamp_micros(us)


def floor_div(a: Column, b: int) -> Column:
    """Integer floor division, exact for negative ``a`` too."""
    width = F.lit(b).cast("long")
    return F.call_function("div", a - F.pmod(a, width), width)


def without_nan(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN means missing; inside the library missing is always null."""
    real = [c for c in columns if c in df.columns and isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(q(c))), F.col(q(c))) for c in real}) if real else df


def known_us(df: DataFrame, spec: SeriesSpec) -> Column:
    """``epoch_us`` of the time column; a row without a time stamp has no place in its series and is an error."""
    return F.coalesce(epoch_us(df, spec.ts), F.raise_error(F.lit(f"null in time column {spec.ts}")).cast("long"))
