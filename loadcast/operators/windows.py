"""Lag, difference and rolling features as window expressions over chunks.

The ``*_columns`` functions return named SQL expressions, so a caller can put any number
of them into one projection: same partitioning and order, hence one shuffle and one sort.
The ``with_*`` functions are the DataFrame forms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..series import SeriesSpec, add, q
from .chunks import Chunks
from .fill import fill

# The default lags and window lengths, in rows.
BASIC_LAGS = [1, 2, 3, 6, 12, 24]
ADVANCED_LAGS = [1, 2, 3, 6, 12, 24, 48, 168]
COMPACT_LAGS = [1, 24, 168]
BASIC_WINDOWS = [3, 6, 12, 24, 168]
ADVANCED_WINDOWS = [3, 6, 12, 24, 48, 168]
STATISTIC_WINDOWS = [24, 168]
DIFFERENCES = [1, 24]
STD_EPSILON = 1e-8


def lag_columns(c: Chunks, y: str, lags: list[int]) -> dict[str, str]:
    return {f"{y}_lag_{k}": c.lag(y, k) for k in lags}


def add_moments(frame: DataFrame, c: Chunks, y: str, windows: list[int],
                mean_std: bool = True, extremes: bool = False) -> DataFrame:
    """Add rolling mean and sample deviation, and rolling min, max and range when asked.

    A sliding frame is recomputed for every row, which costs its length each time. Here
    blocks of 1, 4, 16, 64, ... rows are built from each other by lags, and a window is put
    together from a few blocks: the work per row grows with the logarithm of the window.
    Means and squared deviations are merged around the blocks' own means, so nothing
    cancels. A mean of no value and a deviation of one value are null.
    """
    if max(windows) - 1 > c.halo:
        raise ValueError(f"a window of {max(windows)} rows needs a halo of {max(windows) - 1}, have {c.halo}")
    before = frame.columns
    v = q(y)
    parts = {}
    if mean_std:
        parts |= {"_n1": f"CASE WHEN {v} IS NULL THEN 0D ELSE 1D END", "_m1": f"coalesce({v}, 0D)", "_s1": "0D"}
    if extremes:
        parts |= {"_lo1": v, "_hi1": v}
    frame = add(frame, parts)
    sizes = [1]
    while sizes[-1] * 4 <= max(windows):
        size = sizes[-1]
        frame = _merge(frame, c, {str(4 * size): [(size, k * size) for k in range(4)]}, mean_std, extremes)
        sizes.append(4 * size)
    plan: dict[str, list[tuple[int, int]]] = {}
    for w in windows:
        blocks, reach = [], 0
        for size in reversed(sizes):
            while reach + size <= w:
                blocks.append((size, reach))
                reach += size
        plan[f"w{w}"] = blocks
    frame = _merge(frame, c, plan, mean_std, extremes)
    out = {}
    for w in windows:
        n, m, s, lo, hi = (f"_{x}w{w}" for x in ("n", "m", "s", "lo", "hi"))
        if mean_std:
            out[f"{y}_rolling_mean_{w}"] = f"CASE WHEN {n} > 0 THEN {m} END"
            out[f"{y}_rolling_std_{w}"] = f"CASE WHEN {n} > 1 THEN sqrt({s} / ({n} - 1)) END"
        if extremes:
            out |= {f"{y}_rolling_min_{w}": lo, f"{y}_rolling_max_{w}": hi, f"{y}_rolling_range_{w}": f"{hi} - {lo}"}
    kept = [q(x) for x in before if x not in out]
    return frame.selectExpr(*kept, *[f"{e} AS {q(n)}" for n, e in out.items()])


def _merge(frame: DataFrame, c: Chunks, plan: dict[str, list[tuple[int, int]]],
           mean_std: bool, extremes: bool) -> DataFrame:
    """Unite blocks, given as (size, rows back), under each name of ``plan``."""
    kinds = (["n", "m", "s"] if mean_std else []) + (["lo", "hi"] if extremes else [])
    default = {"n": "0D", "m": "0D", "s": "0D", "lo": "NULL", "hi": "NULL"}
    wanted = {(size, back) for blocks in plan.values() for size, back in blocks if back}

    def at(kind: str, block: tuple[int, int]) -> str:
        size, back = block
        return f"_{kind}{size}_{back}" if back else f"_{kind}{size}"

    lags = {at(k, b): f"lag(_{k}{b[0]}, {b[1]}, {default[k]}) {c.over()}" for b in sorted(wanted) for k in kinds}
    frame = add(frame, lags)
    first, second = {}, {}
    for name, blocks in plan.items():
        if mean_std:
            n = " + ".join(at("n", b) for b in blocks)
            anchor = at("m", blocks[0])
            drift = " + ".join(f"{at('n', b)} * ({at('m', b)} - {anchor})" for b in blocks[1:]) or "0D"
            first[f"_n{name}"] = n
            first[f"_m{name}"] = f"{anchor} + ({drift}) / greatest({n}, 1D)"
            within = " + ".join(at("s", b) for b in blocks)
            between = " + ".join(f"{at('n', b)} * pow({at('m', b)} - _m{name}, 2)" for b in blocks)
            second[f"_s{name}"] = f"{within} + {between}"
        if extremes:
            for kind, pick in (("lo", "least"), ("hi", "greatest")):
                values = [at(kind, b) for b in blocks]
                first[f"_{kind}{name}"] = f"{pick}({', '.join(values)})" if len(values) > 1 else values[0]
    return add(add(frame, first), second).drop(*lags)


def moment_names(y: str, windows: list[int]) -> list[str]:
    return [f"{y}_rolling_{kind}_{w}" for w in windows for kind in ("mean", "std")]


def extreme_names(y: str, windows: list[int]) -> list[str]:
    return [f"{y}_rolling_{kind}_{w}" for w in windows for kind in ("min", "max", "range")]


def quantile_columns(c: Chunks, y: str, windows: list[int]) -> dict[str, str]:
    """Exact quartiles of the last rows as one array column per window, ``_q_<w>``."""
    return {f"_q_{w}": f"percentile({q(y)}, array(0.25D, 0.5D, 0.75D)) {c.last_rows(w)}" for w in windows}


def median_columns(y: str, windows: list[int]) -> dict[str, str]:
    return {f"{y}_rolling_median_{w}": f"_q_{w}[1]" for w in windows}


def quartile_columns(y: str, windows: list[int]) -> dict[str, str]:
    columns = {}
    for w in windows:
        columns[f"{y}_q25_{w}"] = f"_q_{w}[0]"
        columns[f"{y}_q75_{w}"] = f"_q_{w}[2]"
        columns[f"{y}_iqr_{w}"] = f"_q_{w}[2] - _q_{w}[0]"
    return columns


def zscore(y: str, w: int) -> str:
    """Distance from the rolling mean in rolling deviations."""
    return f"({q(y)} - {q(f'{y}_rolling_mean_{w}')}) / ({q(f'{y}_rolling_std_{w}')} + {STD_EPSILON}D)"


def zscore_columns(y: str, windows: list[int]) -> dict[str, str]:
    return {f"{y}_zscore_{w}": zscore(y, w) for w in windows}


def percentile_columns(y: str, windows: list[int]) -> dict[str, str]:
    """Called percentile for compatibility; the value is the z-score, not a rank."""
    return {f"{y}_percentile_{w}": zscore(y, w) for w in windows}


def difference_columns(c: Chunks, y: str, steps: list[int]) -> dict[str, str]:
    return {f"{y}_diff_{k}": f"{q(y)} - {c.lag(y, k)}" for k in steps}


def change_columns(c: Chunks, y: str, steps: list[int], filled: str | None = None) -> dict[str, str]:
    """Relative change against ``k`` rows before, null where that row is 0.

    ``filled`` names a forward-filled copy of the target to compare instead.
    """
    source = filled or y
    return {f"{y}_pct_change_{k}": f"try_divide({q(source)}, {c.lag(source, k)}) - 1" for k in steps}


def _finish(df: DataFrame, c: Chunks, out: DataFrame, extra: list[str]) -> DataFrame:
    return c.settle(out).select(*df.columns, *extra)


def with_lags(df: DataFrame, spec: SeriesSpec, lags: list[int] | None = None,
              rows_per_chunk: int | None = None) -> DataFrame:
    lags = lags or BASIC_LAGS
    c = Chunks(df, spec, max(lags), rows_per_chunk)
    new = lag_columns(c, spec.target, lags)
    return _finish(df, c, add(c.frame, new), list(new))


def with_rolling(df: DataFrame, spec: SeriesSpec, windows: list[int] | None = None,
                 rows_per_chunk: int | None = None) -> DataFrame:
    windows = windows or BASIC_WINDOWS
    c = Chunks(df, spec, max(windows) - 1, rows_per_chunk)
    return _finish(df, c, add_moments(c.frame, c, spec.target, windows), moment_names(spec.target, windows))


def with_rolling_range(df: DataFrame, spec: SeriesSpec, windows: list[int] | None = None,
                       rows_per_chunk: int | None = None) -> DataFrame:
    windows = windows or ADVANCED_WINDOWS
    c = Chunks(df, spec, max(windows) - 1, rows_per_chunk)
    out = add_moments(c.frame, c, spec.target, windows, mean_std=False, extremes=True)
    return _finish(df, c, out, extreme_names(spec.target, windows))


def with_rolling_median(df: DataFrame, spec: SeriesSpec, windows: list[int] | None = None,
                        rows_per_chunk: int | None = None) -> DataFrame:
    windows = windows or ADVANCED_WINDOWS
    c = Chunks(df, spec, max(windows) - 1, rows_per_chunk)
    out = add(c.frame, quantile_columns(c, spec.target, windows))
    new = median_columns(spec.target, windows)
    return _finish(df, c, add(out, new), list(new))


def with_rolling_quartiles(df: DataFrame, spec: SeriesSpec, windows: list[int] | None = None,
                           rows_per_chunk: int | None = None) -> DataFrame:
    windows = windows or STATISTIC_WINDOWS
    c = Chunks(df, spec, max(windows) - 1, rows_per_chunk)
    out = add(c.frame, quantile_columns(c, spec.target, windows))
    new = quartile_columns(spec.target, windows)
    return _finish(df, c, add(out, new), list(new))


def with_zscores(df: DataFrame, spec: SeriesSpec, windows: list[int] | None = None,
                 percentile_windows: list[int] | None = None,
                 rows_per_chunk: int | None = None) -> DataFrame:
    windows = windows or ADVANCED_WINDOWS
    percentile_windows = STATISTIC_WINDOWS if percentile_windows is None else percentile_windows
    both = list(dict.fromkeys([*windows, *percentile_windows]))
    c = Chunks(df, spec, max(both) - 1, rows_per_chunk)
    out = add_moments(c.frame, c, spec.target, both)
    new = {**zscore_columns(spec.target, windows),
           **percentile_columns(spec.target, percentile_windows)}
    return _finish(df, c, add(out, new), list(new))


def with_differences(df: DataFrame, spec: SeriesSpec, steps: list[int] | None = None,
                     rows_per_chunk: int | None = None) -> DataFrame:
    steps = steps or DIFFERENCES
    c = Chunks(df, spec, max(steps), rows_per_chunk)
    new = difference_columns(c, spec.target, steps)
    return _finish(df, c, add(c.frame, new), list(new))


def with_changes(df: DataFrame, spec: SeriesSpec, steps: list[int] | None = None,
                 rows_per_chunk: int | None = None) -> DataFrame:
    """Percent change; gaps in the target are forward-filled before comparing."""
    steps = steps or DIFFERENCES
    filled = fill(df.withColumn("_filled", F.col(spec.target)), spec, ["_filled"],
                  backward=False, rows_per_chunk=rows_per_chunk)
    c = Chunks(filled, spec, max(steps), rows_per_chunk)
    new = change_columns(c, spec.target, steps, "_filled")
    return _finish(df, c, add(c.frame, new), list(new))


