"""Forecast error metrics as aggregate columns.

Each function returns an expression for ``agg``, so one pass scores a whole table, each
model, each series or each group. All of them combine partial results before a shuffle,
so no group is ever gathered in one place. Rows with a missing truth or prediction are
not scored; :func:`scored` and :func:`skipped` count them.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .special import normal_cdf, normal_pdf

EPSILON = 1e-8
EXPECTED_COVERAGE = 0.8


def _col(c: Column | str) -> Column:
    """A column whose NaN counts as missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def _error(y, p) -> Column:
    return _col(y) - _col(p)


def scored(y, p) -> Column:
    return F.count(_error(y, p))


def skipped(y, p) -> Column:
    return F.count_if(_error(y, p).isNull())


def mae(y, p) -> Column:
    return F.avg(F.abs(_error(y, p)))


def mse(y, p) -> Column:
    return F.avg(_error(y, p) * _error(y, p))


def rmse(y, p) -> Column:
    return F.sqrt(mse(y, p))


def mape(y, p, epsilon: float = EPSILON) -> Column:
    """Mean absolute percentage error; rows whose shifted truth is 0 are left out."""
    return F.avg(F.abs(F.try_divide(_error(y, p), _col(y) + F.lit(epsilon)))) * 100


def zero_truth(y) -> Column:
    return F.count_if(_col(y) == 0)


def r2(y, p) -> Column:
    """1 - SSres/SStot, and 0 for a constant truth."""
    paired = F.when(_error(y, p).isNotNull(), _col(y))
    spread = F.var_pop(paired)
    return F.when(spread == 0, F.lit(0.0)).otherwise(1 - F.try_divide(mse(y, p), spread))


def pinball(y, p, quantile: float) -> Column:
    e = _error(y, p)
    # greatest() ignores nulls, which is harmless here: both sides are null together
    return F.avg(F.greatest(e * quantile, e * (quantile - 1)))


def covered(y, lower, upper, count_missing: bool = True) -> Column:
    """1 inside the interval, 0 outside; a row with a missing value counts as outside."""
    inside = (_col(y) >= _col(lower)) & (_col(y) <= _col(upper))
    if count_missing:
        inside = F.coalesce(inside, F.lit(False))
    return inside.cast("double")


def coverage(y, lower, upper, count_missing: bool = True) -> Column:
    return F.avg(covered(y, lower, upper, count_missing))


def width(lower, upper) -> Column:
    return F.avg(_col(upper) - _col(lower))


def crps_gaussian(y, p, sigma) -> Column:
    """Mean continuous ranked probability score of a normal forecast; sigma <= 0 is skipped."""
    s = F.when(_col(sigma) > 0, _col(sigma))
    z = _error(y, p) / s
    score = s * (z * (2 * normal_cdf(z) - 1) + 2 * normal_pdf(z) - 1 / math.sqrt(math.pi))
    return F.avg(score)


def point_bundle(y, p) -> dict[str, Column]:
    return {"mae": mae(y, p), "mse": mse(y, p), "rmse": rmse(y, p),
            "mape": mape(y, p), "r2": r2(y, p)}


def quantile_of(name: str) -> float | None:
    """Quantile level meant by a column name such as ``q10`` or ``q2.5``."""
    match = re.fullmatch(r"q(\d+(?:\.\d+)?)", name)
    return float(match.group(1)) / 100 if match else None


def quantile_bundle(y, columns: list[str]) -> dict[str, Column]:
    levels = {c: quantile_of(c) for c in columns}
    return {f"pinball_loss_{c}": pinball(y, c, q) for c, q in levels.items() if q is not None}


def interval_bundle(y, lower, upper, expected: float = EXPECTED_COVERAGE) -> dict[str, Column]:
    found = coverage(y, lower, upper)
    return {
        "coverage_probability": found,
        "average_interval_width": width(lower, upper),
        "expected_coverage": F.lit(expected),
        "coverage_deviation": F.abs(found - F.lit(expected)),
    }
