"""The same results in plain SQL, for checking against another engine.

Written straight from the definitions: one window over a whole series, joins to a
generated grid, double sums for weighted means. None of it is used by the library.
"""

from __future__ import annotations

PI = "pi()"


def r(expression: str, places: int = 6) -> str:
    """Rounded a hair off the tie, where engines differ; mirrors the catalogue's output."""
    return f"round({expression} + 0.00037 * 1e-{places}, {places}) + 0.0"


def grid(how: str, name: str = "h") -> str:
    """CTEs: hourly event values per type on a gap-free grid, as ``name(event_type, ts, y)``."""
    value = {
        "mean": "avg(value)", "sum": "sum(value)", "min": "min(value)", "max": "max(value)",
        "count": "count(value)", "first": "arg_min(value, (ts, event_id))",
        "last": "arg_max(value, (ts, event_id))"}[how]
    y = {"sum": "coalesce(b.y, 0.0)", "count": "coalesce(b.y, 0)"}.get(how, "b.y")
    return f"""
    {name}_b AS (SELECT event_type, date_trunc('hour', ts) AS ts, {value} AS y FROM events GROUP BY 1, 2),
    {name}_e AS (SELECT event_type, min(ts) AS lo, max(ts) AS hi FROM {name}_b GROUP BY 1),
    {name}_s AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM {name}_e),
    {name} AS (SELECT s.event_type, s.ts, {y} AS y FROM {name}_s s
               LEFT JOIN {name}_b b ON s.event_type = b.event_type AND s.ts = b.ts)"""


def days(name: str = "d") -> str:
    """CTEs: daily order totals on a gap-free grid, as ``name(ts, y)``."""
    return f"""
    {name}_b AS (SELECT date_trunc('day', o_orderdate) AS ts, sum(o_totalprice) AS y FROM orders GROUP BY 1),
    {name}_s AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM {name}_b),
    {name} AS (SELECT s.ts::TIMESTAMP AS ts, coalesce(b.y, 0.0) AS y FROM {name}_s s LEFT JOIN {name}_b b ON s.ts = b.ts)"""


def calendar(t: str) -> dict[str, str]:
    hour, dow, month = f"hour({t})", f"(isodow({t}) - 1)", f"month({t})"
    return {
        "hour": hour, "day_of_week": dow, "day_of_month": f"day({t})", "day_of_year": f"dayofyear({t})",
        "week_of_year": f"weekofyear({t})", "month": month, "quarter": f"quarter({t})",
        "hour_sin": f"sin(2 * {PI} * {hour} / 24)", "hour_cos": f"cos(2 * {PI} * {hour} / 24)",
        "dow_sin": f"sin(2 * {PI} * {dow} / 7)", "dow_cos": f"cos(2 * {PI} * {dow} / 7)",
        "month_sin": f"sin(2 * {PI} * {month} / 12)", "month_cos": f"cos(2 * {PI} * {month} / 12)",
        "is_weekend": f"({dow} >= 5)::BIGINT",
        "is_business_hour": f"({hour} BETWEEN 8 AND 18)::BIGINT",
        "is_peak_hour": f"({hour} IN (8, 9, 10, 18, 19, 20))::BIGINT",
        "is_night": f"({hour} >= 22 OR {hour} <= 6)::BIGINT",
    }


def advanced_calendar(t: str) -> dict[str, str]:
    hour, dow, month, day = f"hour({t})", f"(isodow({t}) - 1)", f"month({t})", f"day({t})"
    last = f"({t}::DATE = last_day({t}))"
    return {
        "is_business_day": f"({dow} < 5)::BIGINT",
        "is_month_start": f"({day} = 1)::BIGINT",
        "is_month_end": f"{last}::BIGINT",
        "is_quarter_start": f"({day} = 1 AND {month} IN (1, 4, 7, 10))::BIGINT",
        "is_quarter_end": f"({last} AND {month} IN (3, 6, 9, 12))::BIGINT",
        "week_of_year_norm": f"(weekofyear({t}) - 1) / 51.0",
        "is_holiday_period": f"({month} IN (7, 8) OR ({month} = 12 AND {day} >= 20) OR ({month} = 1 AND {day} <= 10))::BIGINT",
        "hour_weekday_interaction": f"{hour} * ({dow} + 1)",
        "month_hour_interaction": f"{month} * {hour}",
    }


def labels(t: str) -> dict[str, str]:
    return {
        "time_of_day": f"CASE WHEN hour({t}) BETWEEN 8 AND 18 THEN 'business_hours' ELSE 'off_hours' END",
        "peak_hours": f"CASE WHEN hour({t}) IN (8, 9, 10, 18, 19, 20) THEN 'peak' ELSE 'off_peak' END",
        "season": f"CASE WHEN month({t}) IN (12, 1, 2) THEN 'winter' WHEN month({t}) IN (3, 4, 5) THEN 'spring' "
                  f"WHEN month({t}) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END",
        "is_winter": f"CASE WHEN month({t}) IN (12, 1, 2) THEN 'winter' ELSE 'non_winter' END",
        "weekend": f"CASE WHEN isodow({t}) >= 6 THEN 'weekend' ELSE 'weekday' END",
    }


_FRACTIONS = {"hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos", "week_of_year_norm"}


def columns(named: dict[str, str], places: int = 6, whole: set[str] | None = None) -> str:
    """A select list; integer columns are cast, the others rounded."""
    out = []
    for name, e in named.items():
        integer = name in whole if whole is not None else False
        out.append(f"({e})::BIGINT AS {name}" if integer else f"{r(e, places)} AS {name}")
    return ", ".join(out)


def calendar_columns(named: dict[str, str], places: int = 6) -> str:
    return columns(named, places, set(named) - _FRACTIONS)


def over(part: str, rows: int | None = None) -> str:
    frame = f" ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW" if rows else ""
    return f"OVER ({part} ORDER BY ts{frame})"


BY_TYPE = "PARTITION BY event_type"


def lags(part: str, ks: list[int]) -> dict[str, str]:
    return {f"y_lag_{k}": f"lag(y, {k}) {over(part)}" for k in ks}


def mean_std(part: str, ws: list[int]) -> dict[str, str]:
    out = {}
    for w in ws:
        out[f"y_rolling_mean_{w}"] = f"avg(y) {over(part, w)}"
        out[f"y_rolling_std_{w}"] = f"stddev_samp(y) {over(part, w)}"
    return out


def min_max(part: str, ws: list[int]) -> dict[str, str]:
    out = {}
    for w in ws:
        out[f"y_rolling_min_{w}"] = f"min(y) {over(part, w)}"
        out[f"y_rolling_max_{w}"] = f"max(y) {over(part, w)}"
        out[f"y_rolling_range_{w}"] = f"max(y) {over(part, w)} - min(y) {over(part, w)}"
    return out


def medians(part: str, ws: list[int]) -> dict[str, str]:
    return {f"y_rolling_median_{w}": f"quantile_cont(y, 0.5) {over(part, w)}" for w in ws}


def quartiles(part: str, ws: list[int]) -> dict[str, str]:
    out = {}
    for w in ws:
        low, high = (f"quantile_cont(y, {q}) {over(part, w)}" for q in (0.25, 0.75))
        out |= {f"y_q25_{w}": low, f"y_q75_{w}": high, f"y_iqr_{w}": f"{high} - {low}"}
    return out


def zscores(part: str, ws: list[int], name: str = "zscore") -> dict[str, str]:
    return {f"y_{name}_{w}": f"(y - avg(y) {over(part, w)}) / (stddev_samp(y) {over(part, w)} + 1e-8)" for w in ws}


def differences(part: str) -> dict[str, str]:
    return {f"y_diff_{k}": f"y - lag(y, {k}) {over(part)}" for k in (1, 24)}


def changes(part: str, y: str = "y") -> dict[str, str]:
    return {f"y_pct_change_{k}": f"{y} / nullif(lag({y}, {k}) {over(part)}, 0) - 1" for k in (1, 24)}


def ewma_ctes(source: str, key: str | None, alphas: list[float], name: str = "ew") -> str:
    """Weighted means as double sums over all earlier rows."""
    part = f"PARTITION BY {key} " if key else ""
    same = f"a.{key} = b.{key} AND" if key else ""
    means = ", ".join(
        f"sum(b.y * pow(1 - {a}, a.rn - b.rn)) / nullif(sum(CASE WHEN b.y IS NOT NULL "
        f"THEN pow(1 - {a}, a.rn - b.rn) END), 0) AS y_ewma_{str(a).replace('.', '_')}" for a in alphas)
    keys = f"a.{key}, " if key else ""
    return f"""
    {name}_n AS (SELECT *, row_number() OVER ({part}ORDER BY ts) AS rn FROM {source}),
    {name} AS (SELECT {keys}a.ts, {means} FROM {name}_n a JOIN {name}_n b
               ON {same} b.rn <= a.rn GROUP BY {keys}a.ts)"""


def filled(column: str, part: str, back: bool = True) -> str:
    ahead = f"last_value({column} IGNORE NULLS) OVER ({part} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    if not back:
        return ahead
    behind = f"first_value({column} IGNORE NULLS) OVER ({part} ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"coalesce({ahead}, {behind})"


BASIC_LAGS, ADVANCED_LAGS = [1, 2, 3, 6, 12, 24], [1, 2, 3, 6, 12, 24, 48, 168]
BASIC_WINDOWS, ADVANCED_WINDOWS, STATISTICS = [3, 6, 12, 24, 168], [3, 6, 12, 24, 48, 168], [24, 168]
ALPHAS = [0.1, 0.3, 0.5, 0.7]


def windowed(named: dict[str, str], how: str = "sum", places: int = 6) -> str:
    return (f"WITH {grid(how)} SELECT event_type, ts, {r('y', places)} AS y, {columns(named, places)} FROM h")


def basic_sql(source: str, part: str, key: str | None, places: int) -> str:
    keys = f"{key}, " if key else ""
    using = f"{key}, ts" if key else "ts"
    look = {**lags(part, BASIC_LAGS), **mean_std(part, BASIC_WINDOWS)}
    names = [*look, "y_ewma_0_1", "y_ewma_0_3"]
    fills = ", ".join(f"{filled(n, part)} AS {n}" for n in ["y", *names])
    raw = ", ".join(f"{e} AS {n}" for n, e in look.items())
    return f"""
    {ewma_ctes(source, key, [0.1, 0.3])},
    raw AS (SELECT {keys}ts, y, {raw} FROM {source}),
    wide AS (SELECT raw.*, y_ewma_0_1, y_ewma_0_3 FROM raw JOIN ew USING ({using})),
    fl AS (SELECT {keys}ts, {fills} FROM wide)"""


def basic_select(key: str | None, places: int) -> str:
    keys = f"{key}, " if key else ""
    names = [*lags("", BASIC_LAGS), *mean_std("", BASIC_WINDOWS), "y_ewma_0_1", "y_ewma_0_3"]
    return (f"SELECT {keys}ts, {r('y', places)} AS y, {calendar_columns(calendar('ts'), places)}, "
            + ", ".join(f"{r(n, places)} AS {n}" for n in names) + " FROM fl WHERE y IS NOT NULL")


def compact_sql() -> str:
    look = {**lags(BY_TYPE, [1, 24, 168]),
            "y_rolling_mean_24": f"avg(y) {over(BY_TYPE, 24)}", "y_rolling_mean_168": f"avg(y) {over(BY_TYPE, 168)}",
            "y_rolling_std_24": f"stddev_samp(y) {over(BY_TYPE, 24)}"}
    raw = ", ".join(f"{e} AS {n}" for n, e in look.items())
    fills = ", ".join(f"coalesce({filled(n, BY_TYPE, False)}, 0.0) AS {n}" for n in ["y", *look])
    c = calendar("ts")
    simple = {n: c[n] for n in ("hour", "day_of_week", "month", "is_weekend", "hour_sin", "hour_cos")}
    simple["is_peak_hour"] = "(hour(ts) IN (8, 9, 18, 19, 20))::BIGINT"
    simple["weekend_evening"] = "(isodow(ts) >= 6 AND hour(ts) > 18)::BIGINT"
    return (f"WITH {grid('mean')}, raw AS (SELECT event_type, ts, y, {raw} FROM h), "
            f"fl AS (SELECT event_type, ts, {fills} FROM raw) "
            f"SELECT event_type, ts, {r('y', 4)} AS y, {calendar_columns(simple, 4)}, "
            + ", ".join(f"{r(n, 4)} AS {n}" for n in look) + " FROM fl")


def comprehensive_sql() -> str:
    part = ""
    look = {**lags(part, ADVANCED_LAGS), **mean_std(part, ADVANCED_WINDOWS), **min_max(part, ADVANCED_WINDOWS),
            **differences(part), **changes(part), **medians(part, ADVANCED_WINDOWS),
            **zscores(part, ADVANCED_WINDOWS), **quartiles(part, STATISTICS),
            **zscores(part, STATISTICS, "percentile")}
    raw = ", ".join(f"{e} AS {n}" for n, e in look.items())
    hour, dow = "hour(ts)", "(isodow(ts) - 1)"
    joint = {
        "hour_dow_peak": f"(({hour} BETWEEN 8 AND 10 OR {hour} BETWEEN 18 AND 20) AND {dow} < 5)::BIGINT",
        "weekend_hour_low": f"({dow} >= 5 AND {hour} BETWEEN 2 AND 6)::BIGINT"}
    products = {"lag1_hour_interaction": f"y_lag_1 * {hour}", "lag24_dow_interaction": f"y_lag_24 * {dow}"}
    wide = ", ".join(f"{e} AS {n}" for n, e in products.items())
    filled_names = [*look, *products]
    fills = ", ".join(f"coalesce({filled(n, part)}, 0.0) AS {n}" for n in filled_names)
    means = [f"y_ewma_{str(a).replace('.', '_')}" for a in ALPHAS]
    return (f"WITH {days()}, {ewma_ctes('d', None, ALPHAS)}, "
            f"raw AS (SELECT ts, y, row_number() OVER (ORDER BY ts) - 1 AS i, {raw} FROM d), "
            f"wide AS (SELECT *, {wide} FROM raw), "
            f"fl AS (SELECT ts, y, i, {fills} FROM wide) "
            f"SELECT fl.ts, {r('y', 2)} AS y, {calendar_columns({**calendar('fl.ts'), **advanced_calendar('fl.ts')}, 2)}, "
            + calendar_columns({n: e.replace("(ts)", "(fl.ts)") for n, e in joint.items()}, 2) + ", "
            + ", ".join(f"{r(n, 2)} AS {n}" for n in [*filled_names, *means]) + ", "
            + columns(fourier_terms("i"), 2) + " FROM fl JOIN ew ON fl.ts = ew.ts")


def fourier_terms(i: str) -> dict[str, str]:
    return {f"fourier_{f}_{p}_{k}": f"{f}(2 * {PI} * {k} * {i} / {p})"
            for p in (24, 168, 8760) for k in (1, 2, 3) for f in ("cos", "sin")}


def advanced_sql() -> str:
    look = {**lags(BY_TYPE, ADVANCED_LAGS), **mean_std(BY_TYPE, ADVANCED_WINDOWS),
            **min_max(BY_TYPE, ADVANCED_WINDOWS), **differences(BY_TYPE), **changes(BY_TYPE),
            **medians(BY_TYPE, ADVANCED_WINDOWS), **zscores(BY_TYPE, ADVANCED_WINDOWS)}
    means = [f"y_ewma_{str(a).replace('.', '_')}" for a in ALPHAS]
    raw = ", ".join(f"{e} AS {n}" for n, e in look.items())
    return (f"WITH {grid('sum')}, {ewma_ctes('h', 'event_type', ALPHAS)}, "
            f"raw AS (SELECT event_type, ts, y, {raw} FROM h) "
            f"SELECT event_type, ts, {r('y', 4)} AS y, " + ", ".join(f"{r(n, 4)} AS {n}" for n in [*look, *means])
            + " FROM raw JOIN ew USING (event_type, ts)")


# -- predictions and metrics ------------------------------------------------------------

def p_ctes() -> str:
    return f"""{grid('mean')},
    p AS (SELECT event_type, ts, y, lag(y, 1) {over(BY_TYPE)} AS lag_1, lag(y, 24) {over(BY_TYPE)} AS lag_24,
          avg(y) {over(BY_TYPE, 24)} AS mean_24, stddev_samp(y) {over(BY_TYPE, 24)} AS sigma,
          quantile_cont(y, 0.1) {over(BY_TYPE, 24)} AS q10, quantile_cont(y, 0.5) {over(BY_TYPE, 24)} AS q50,
          quantile_cont(y, 0.9) {over(BY_TYPE, 24)} AS q90 FROM h),
    m AS (SELECT event_type, ts, y, sigma, q10, q50, q90, 'lag_1' AS model, lag_1 AS yhat FROM p
          UNION ALL SELECT event_type, ts, y, sigma, q10, q50, q90, 'lag_24', lag_24 FROM p
          UNION ALL SELECT event_type, ts, y, sigma, q10, q50, q90, 'mean_24', mean_24 FROM p)"""


def point(y: str, p: str) -> dict[str, str]:
    e = f"({y} - {p})"
    pair = f"CASE WHEN {p} IS NOT NULL THEN {y} END"
    return {
        "mae": f"avg(abs{e})", "mse": f"avg({e} * {e})", "rmse": f"sqrt(avg({e} * {e}))",
        "mape": f"avg(abs({e} / nullif({y} + 1e-8, 0))) * 100",
        "r2": f"CASE WHEN var_pop({pair}) = 0 THEN 0.0 ELSE 1 - avg({e} * {e}) / var_pop({pair}) END"}


def counts(y: str, p: str) -> str:
    return f"count({y} - {p}) AS n_scored, sum((({y} - {p}) IS NULL)::BIGINT)::BIGINT AS n_skipped"


def pinball(y: str, p: str, q: float) -> str:
    return f"avg(greatest({q} * ({y} - {p}), ({q} - 1) * ({y} - {p})))"


COVERED = "coalesce(y >= q10 AND y <= q90, false)::INT::DOUBLE"
INTERVAL = {
    "coverage_probability": f"avg({COVERED})", "average_interval_width": "avg(q90 - q10)",
    "expected_coverage": "0.8", "coverage_deviation": f"abs(avg({COVERED}) - 0.8)"}
PINBALLS = {f"pinball_loss_q{n}": pinball("y", f"q{n}", n / 100) for n in (10, 50, 90)}

def crps_sql() -> str:
    """erf by its all-positive power series, term by term through logarithms."""
    return f"""WITH {p_ctes()},
    z AS (SELECT model, sigma, (y - yhat) / sigma AS z FROM m WHERE sigma > 0 AND y - yhat IS NOT NULL),
    x AS (SELECT *, row_number() OVER () AS id, abs(z / sqrt(2)) AS x FROM z),
    terms AS (SELECT id, x, unnest(range(0, 160)) AS k FROM x),
    e AS (SELECT id, CASE WHEN any_value(x) > 5.5 THEN 1.0 ELSE 2 / sqrt(pi()) *
          sum(CASE WHEN x = 0 THEN 0 ELSE exp((2 * k + 1) * ln(x) + 2 * k * ln(2) - x * x
              - lgamma(2 * k + 2) + lgamma(k + 1)) END) END AS e FROM terms GROUP BY id)
    SELECT model, {r("avg(sigma * (z * sign(z) * e + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi())))")} AS crps
    FROM x JOIN e USING (id) GROUP BY model"""


GROUPINGS = ["time_of_day", "peak_hours", "season", "is_winter", "weekend"]


def labelled_ctes(groupings: list[str], source: str = "m", value: str = "yhat") -> str:
    extra = {"kind": "CASE WHEN event_type = 'purchase' THEN 'sale' ELSE 'other' END"}
    named = {**labels("ts"), **extra}
    cols = "model, " if source == "m" else ""
    union = " UNION ALL ".join(
        f"SELECT {cols}y, {value} AS v, q10, q90, '{g}' AS grouping_name, {named[g]} AS label FROM {source}"
        for g in groupings)
    return f"l AS ({union})"


def group_ctes(groupings: list[str]) -> str:
    return (f"{labelled_ctes(groupings)}, g AS (SELECT model, grouping_name, label, avg(abs(y - v)) AS mae, "
            f"sqrt(avg((y - v) * (y - v))) AS rmse, count(y - v) AS n, avg({COVERED}) AS coverage "
            f"FROM l GROUP BY 1, 2, 3)")


def spread(c: str) -> dict[str, str]:
    return {f"{c}_variance": f"CASE WHEN count(*) > 1 THEN var_pop({c}) END",
            f"{c}_range": f"CASE WHEN count(*) > 1 THEN max({c}) - min({c}) END",
            f"{c}_cv": f"CASE WHEN count(*) > 1 THEN CASE WHEN avg({c}) > 0 THEN stddev_pop({c}) / avg({c}) ELSE 0 END END"}


def summary_ctes(with_coverage: bool) -> str:
    parts = []
    for c in ("mae", "rmse", *(("coverage",) if with_coverage else ())):
        s = spread(c)
        cv = s[f"{c}_cv"] if c != "coverage" else "NULL::DOUBLE"
        parts.append(f"SELECT model, grouping_name, '{c}' AS metric, {s[f'{c}_variance']} AS variance, "
                     f"{s[f'{c}_range']} AS \"range\", {cv} AS coefficient_variation "
                     f"FROM g GROUP BY 1, 2 HAVING count(*) > 1")
    return f"{group_ctes(GROUPINGS)}, su AS ({' UNION ALL '.join(parts)})"


def compare_fairness_sql() -> str:
    cols = []
    for g in GROUPINGS:
        for m in ("mae", "rmse"):
            for s, short in (("variance", "variance"), ('"range"', "range"), ("coefficient_variation", "cv")):
                where = f"grouping_name = '{g}' AND metric = '{m}'"
                cols.append(f"{r(f'max(CASE WHEN {where} THEN {s} END)')} AS {g}_{m}_{short}")
    return f"WITH {p_ctes()}, {summary_ctes(False)} SELECT model, {', '.join(cols)} FROM su GROUP BY 1"


# -- daily model table ------------------------------------------------------------------

def model_ctes() -> str:
    c = calendar("ts")
    return f"""{days()},
    t AS (SELECT ts, y / 1e6 AS y, coalesce(lag(y, 1) OVER (ORDER BY ts), 0.0) / 1e6 AS y_lag_1,
          coalesce(lag(y, 7) OVER (ORDER BY ts), 0.0) / 1e6 AS y_lag_7, {c['dow_sin']} AS dow_sin,
          {c['dow_cos']} AS dow_cos, {c['month_sin']} AS month_sin, {c['month_cos']} AS month_cos FROM d)"""


MODEL_FEATURES = ["y_lag_1", "y_lag_7", "dow_sin", "dow_cos", "month_sin", "month_cos"]


def f_scores_sql() -> str:
    parts = [f"SELECT '{c}' AS feature, corr({c}, y) AS r, count(*) AS n FROM t" for c in MODEL_FEATURES]
    return (f"WITH {model_ctes()}, c AS ({' UNION ALL '.join(parts)}) "
            f"SELECT feature, {r('r')} AS r, {r('r * r / (1 - r * r) * (n - 2)')} AS f_score FROM c")


WAVE = f"{grid('sum')}, x AS (SELECT *, {calendar('ts')['hour_cos']} AS x FROM h)"


def penalised_sql(weight: str) -> str:
    return (f"WITH {WAVE}, s AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, "
            f"covar_pop(x, y) AS cxy, var_pop(x) AS vx FROM x), w AS (SELECT *, {weight} AS w FROM s) "
            f"SELECT event_type, ts, {r('my + w * (x - mx)')} AS yhat FROM x, w")


def grid_search_sql() -> str:
    return f"""WITH {WAVE},
    n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS i,
          count(*) OVER (PARTITION BY event_type) AS n FROM x),
    b AS (SELECT *, CASE WHEN i < n - 3 * (n // 4) THEN 0 ELSE (i - (n - 3 * (n // 4))) // (n // 4) + 1 END AS block FROM n),
    k AS (SELECT unnest([1, 2, 3]) AS fold), a AS (SELECT unnest([0.1, 1.0, 10.0, 100.0]) AS alpha),
    s AS (SELECT fold, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS cxy, var_pop(x) AS vx
          FROM b, k WHERE block < fold GROUP BY fold),
    w AS (SELECT fold, alpha, mx, my, n * cxy / (n * vx + alpha) AS w FROM s, a),
    e AS (SELECT alpha, fold, avg(pow(y - (my + w * (x - mx)), 2)) AS mse
          FROM b JOIN w ON b.block = w.fold GROUP BY 1, 2),
    t AS (SELECT alpha, avg(mse) AS mean_mse FROM e GROUP BY 1)
    SELECT alpha::DOUBLE AS alpha, {r('mean_mse')} AS mean_mse, mean_mse = (SELECT min(mean_mse) FROM t) AS best FROM t"""


def elastic_grid_sql() -> str:
    """The same folds; with one feature the elastic net is a soft threshold."""
    return (grid_search_sql()
            .replace("a AS (SELECT unnest([0.1, 1.0, 10.0, 100.0]) AS alpha)",
                     "a AS (SELECT * FROM (SELECT unnest([0.1, 1.0, 10.0]) AS alpha), (SELECT unnest([0.1, 0.5, 0.9]) AS l1_ratio))")
            .replace("SELECT fold, alpha, mx, my, n * cxy / (n * vx + alpha) AS w",
                     "SELECT fold, alpha, l1_ratio, mx, my, sign(cxy) * greatest(abs(cxy) - alpha * l1_ratio, 0) "
                     "/ (vx + alpha * (1 - l1_ratio)) AS w")
            .replace("SELECT alpha, fold, avg(pow", "SELECT alpha, l1_ratio, fold, avg(pow")
            .replace("GROUP BY 1, 2),\n    t AS (SELECT alpha, avg(mse) AS mean_mse FROM e GROUP BY 1)",
                     "GROUP BY 1, 2, 3),\n    t AS (SELECT alpha, l1_ratio, avg(mse) AS mean_mse FROM e GROUP BY 1, 2)")
            .replace("SELECT alpha::DOUBLE AS alpha,", "SELECT alpha::DOUBLE AS alpha, l1_ratio::DOUBLE AS l1_ratio,"))


def per_series_search_sql() -> str:
    """Ridge per event type: the same folds inside each series, its best penalty, and the line for all its rows."""
    return f"""WITH {WAVE},
    n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS i,
          count(*) OVER (PARTITION BY event_type) AS n FROM x),
    b AS (SELECT *, CASE WHEN i < n - 3 * (n // 4) THEN 0 ELSE (i - (n - 3 * (n // 4))) // (n // 4) + 1 END AS block FROM n),
    k AS (SELECT unnest([1, 2, 3]) AS fold), a AS (SELECT unnest([0.1, 1.0, 10.0, 100.0]) AS alpha),
    s AS (SELECT event_type, fold, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS cxy, var_pop(x) AS vx
          FROM b, k WHERE block < fold GROUP BY 1, 2),
    w AS (SELECT event_type, fold, alpha, mx, my, n * cxy / (n * vx + alpha) AS w FROM s, a),
    e AS (SELECT event_type, alpha, fold, avg(pow(y - (my + w * (x - mx)), 2)) AS mse
          FROM b JOIN w USING (event_type) WHERE b.block = w.fold GROUP BY 1, 2, 3),
    t AS (SELECT event_type, arg_min(alpha, mean_mse) AS alpha FROM (SELECT event_type, alpha, avg(mse) AS mean_mse FROM e
          GROUP BY 1, 2) GROUP BY 1),
    f AS (SELECT event_type, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS cxy, var_pop(x) AS vx FROM x GROUP BY 1),
    g AS (SELECT event_type, n, alpha, mx, my, n * cxy / (n * vx + alpha) AS w FROM f JOIN t USING (event_type))
    SELECT event_type, n AS n_rows, alpha::DOUBLE AS alpha, {r('my - w * mx')} AS intercept, {r('w')} AS weight FROM g"""


def weights_ctes(names: list[str], by: str) -> str:
    scores = ", ".join(f"greatest(coalesce({point('y', c)['r2']}, 0.0), 0.0) AS {c}" for c in names)
    total = " + ".join(names)
    share = ", ".join(f"CASE WHEN {total} > 0 THEN {c} / ({total}) ELSE 1.0 / {len(names)} END AS weight_{c}"
                      for c in names)
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"sc AS (SELECT {lead}{scores} FROM p {group}), wt AS (SELECT {lead}{share} FROM sc)"


ENSEMBLE = ["lag_1", "mean_24", "q50"]


def contributions_sql() -> str:
    parts = ", ".join(f"{r(f'{c} * weight_{c}')} AS contribution_{c}" for c in ENSEMBLE)
    total = " + ".join(f"{c} * weight_{c}" for c in ENSEMBLE)
    shown = ", ".join(f"{r(c)} AS {c}" for c in ["y", *ENSEMBLE])
    return (f"WITH {p_ctes()}, {weights_ctes(ENSEMBLE, '')} "
            f"SELECT event_type, ts, {shown}, {parts}, {r(total)} AS yhat FROM p, wt")


def forecast_rows_sql() -> str:
    c = calendar("f.ts")
    stale = {n: calendar("l.ts")[n] for n in ("day_of_year", "week_of_year")}
    fresh = {n: e for n, e in c.items() if n not in stale}
    names = ["y", *lags("", BASIC_LAGS), *mean_std("", BASIC_WINDOWS), "y_ewma_0_1", "y_ewma_0_3"]
    return f"""WITH {grid('mean')}, {basic_sql('h', BY_TYPE, 'event_type', 4)},
    l AS (SELECT * FROM fl QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) = 1),
    f AS (SELECT event_type, s AS horizon_step, ts + s * INTERVAL 1 HOUR AS ts
          FROM (SELECT event_type, ts, unnest(range(1, 49)) AS s FROM l))
    SELECT l.event_type, f.ts, f.horizon_step, {calendar_columns({**fresh, **stale}, 4)},
    {', '.join(f'{r(f"l.{n}", 4)} AS {n}' for n in names)} FROM l JOIN f USING (event_type)"""


def describe_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, {r(f'avg({c})', 4)} AS mean, "
        f"{r(f'stddev_samp({c})', 4)} AS std, {r(f'min({c})', 4)} AS min, {r(f'max({c})', 4)} AS max, "
        + ", ".join(f"{r(f'quantile_cont({c}, {q})', 4)} AS p{int(q * 100)}" for q in (0.25, 0.5, 0.75))
        + " FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))


def completeness_sql() -> str:
    names = ["event_type", "ts", "y", "lag_1", "lag_24", "mean_24", "sigma", "q10", "q50", "q90"]
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", sum(({c} IS NULL)::INT)::BIGINT AS missing, count(*) AS n_rows FROM p" for c in names)
    return (f"WITH {p_ctes()}, c AS ({parts}) SELECT \"column\", missing, n_rows, "
            f"{r('(1 - (SELECT sum(missing) FROM c) / (n_rows * 10.0)) * 100')} AS completeness FROM c")


def robust_sql() -> str:
    names = ["l_quantity", "l_extendedprice", "l_tax"]
    stats = ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS s_{c}"
                      for c in names)
    out = ", ".join(f"{r(f'({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END')} AS {c}" for c in names)
    return (f"WITH s AS (SELECT {stats} FROM lineitem) SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, "
            f"{out} FROM lineitem, s")


def frequency_sql() -> str:
    return f"""WITH {grid('sum')},
    src AS (SELECT 'events' AS series, event_type, ts FROM events UNION ALL SELECT 'hourly', event_type, ts FROM h),
    g AS (SELECT series, event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY series, event_type ORDER BY ts) AS gap FROM src),
    c AS (SELECT series, event_type, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1, 2, 3),
    t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY series, event_type ORDER BY n DESC, gap) = 1),
    k AS (SELECT series, event_type, count(*) AS n_rows FROM src GROUP BY 1, 2)
    SELECT series, event_type, n_rows, gap AS gap_us,
    CASE gap WHEN 900000000 THEN '15min' WHEN 3600000000 THEN '1h' WHEN 86400000000 THEN '1d'
    ELSE 'custom_' || CASE WHEN gap % 1000000 = 0 THEN (gap // 1000000)::VARCHAR ELSE printf('%.6f', gap / 1e6) END || 's' END AS frequency
    FROM k JOIN t USING (series, event_type)"""


def odd_bins_sql() -> str:
    return f"""WITH o AS (SELECT event_type, date_trunc('day', min(ts)) AS o FROM events GROUP BY 1),
    b AS (SELECT event_type, o, (epoch_us(ts) - epoch_us(o)) // 6000000000 AS bin, sum(value) AS v
          FROM events JOIN o USING (event_type) GROUP BY 1, 2, 3),
    s AS (SELECT event_type, o, unnest(range(min(bin), max(bin) + 1)) AS bin FROM b GROUP BY event_type, o)
    SELECT event_type, s.o + s.bin * INTERVAL 100 MINUTE AS ts, {r('coalesce(v, 0.0)')} AS value
    FROM s LEFT JOIN b USING (event_type, bin)"""


ORACLES: dict[str, str] = {
    "flagship": f"""WITH {grid('sum')},
        w AS (SELECT *, lag(y, 1) {over(BY_TYPE)} AS y_lag_1, lag(y, 24) {over(BY_TYPE)} AS y_lag_24,
              avg(y) {over(BY_TYPE, 24)} AS y_rolling_mean_24,
              row_number() {over(BY_TYPE)} - 1 AS i, count(*) OVER ({BY_TYPE}) AS n FROM h),
        t AS (SELECT event_type, {calendar('ts')['is_peak_hour']} AS is_peak_hour, y, 'y_lag_1' AS model, y_lag_1 AS yhat FROM w WHERE i >= floor(n * 0.8)
              UNION ALL SELECT event_type, {calendar('ts')['is_peak_hour']}, y, 'y_lag_24', y_lag_24 FROM w WHERE i >= floor(n * 0.8)
              UNION ALL SELECT event_type, {calendar('ts')['is_peak_hour']}, y, 'y_rolling_mean_24', y_rolling_mean_24 FROM w WHERE i >= floor(n * 0.8))
        SELECT event_type, model, is_peak_hour, {columns({k: point('y', 'yhat')[k] for k in ('mae', 'rmse', 'r2')})},
        count(y - yhat) AS n_scored FROM t GROUP BY 1, 2, 3""",
    "newest_n": f"""SELECT event_type, event_id, ts, {r('value')} AS value FROM events WHERE event_type <> 'error' AND value IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100""",
    "newest_overall": f"""SELECT event_type, event_id, ts, {r('value')} AS value FROM events WHERE event_type = 'view'
        AND value IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 1000""",
    "fallback_source": f"SELECT event_type, count(*) AS n, {r('sum(value)', 2)} AS total FROM events GROUP BY 1",
    "ingest_records": f"""SELECT event_id, ts AS date_heure, {r('value')} AS y, {r('value')} AS consommation,
        CASE event_id % 4 WHEN 0 THEN 0.0 WHEN 3 THEN {r('value')} END AS gaz, 0.0::DOUBLE AS fioul,
        CASE WHEN event_id % 4 <> 0 THEN {r('value')} END AS taux_co2, NULL::DOUBLE AS prevision_j1,
        0.0::DOUBLE AS ech_comm_italie FROM events WHERE event_id % 10 <> 9""",
    "resolve_target": f"SELECT event_id, {r('value')} AS y FROM events",
    "content_key": """SELECT o_orderkey, md5(concat_ws('|', o_orderkey::VARCHAR, coalesce(o_orderstatus, 'None'),
        'priority:' || coalesce(o_orderpriority, 'None'))) AS content_key FROM orders""",
    "format_timestamp": """SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp,
        strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events""",
    "clip": f"SELECT o_orderkey, {r('least(greatest(o_totalprice, 20000.0), 100000.0)', 2)} AS clipped FROM orders",
    "round_display": f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {r('round(l_extendedprice / 7, 2)', 2)} AS share FROM lineitem",
    "drop_missing_target": f"WITH {grid('mean')} SELECT event_type, ts, {r('y')} AS y FROM h WHERE y IS NOT NULL",
    "select_features": f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT AS l_linenumber,
        {r('l_quantity')} AS l_quantity, {r('l_discount')} AS l_discount, {r('l_tax')} AS l_tax FROM lineitem""",
    "fill_zero": f"WITH {grid('mean')} SELECT event_type, ts, {r('coalesce(y, 0.0)')} AS y FROM h",
    "fixed_interval": f"""SELECT c_custkey, {r('least(c_acctbal * 0.9, c_acctbal * 1.1)', 4)} AS yhat_lower,
        {r('greatest(c_acctbal * 0.9, c_acctbal * 1.1)', 4)} AS yhat_upper FROM customer""",
    **{f"resample_{how}": f"WITH {grid(how)} SELECT event_type, ts, {'y' if how == 'count' else r('y')} AS y FROM h"
       for how in ("mean", "sum", "first", "last", "min", "max", "count")},
    "resample_odd_bins": odd_bins_sql(),
    "spine": f"WITH {grid('sum')} SELECT event_type, ts FROM h",
    "on_spine": f"WITH {grid('mean')} SELECT event_type, ts, {r('y')} AS y FROM h",
    "daily_rollup": f"""WITH {grid('mean')} SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS ts, {r('avg(y)')} AS y,
        {r('avg(least(y * 0.9, y * 1.1))')} AS yhat_lower, {r('avg(greatest(y * 0.9, y * 1.1))')} AS yhat_upper
        FROM h GROUP BY 1, 2""",
    "detect_frequency": frequency_sql(),
    "tail_n": f"""WITH {grid('mean')} SELECT event_type, ts, {r('y')} AS y FROM h
        QUALIFY row_number() OVER ({BY_TYPE} ORDER BY ts DESC) <= 200""",
    "tail_raw": f"""SELECT event_type, event_id, ts, {r('value')} AS value FROM events
        QUALIFY row_number() OVER ({BY_TYPE} ORDER BY ts DESC, event_id DESC) <= 250""",
    "row_position": f"SELECT event_type, event_id, row_number() OVER ({BY_TYPE} ORDER BY ts, event_id) - 1 AS position FROM events",
    "calendar": f"SELECT event_id, {calendar_columns(calendar('ts'))} FROM events",
    "calendar_orders": f"SELECT o_orderkey, {calendar_columns(calendar('o_orderdate'))} FROM orders",
    "calendar_advanced": f"SELECT o_orderkey, {calendar_columns(advanced_calendar('o_orderdate'))} FROM orders",
    "interactions": f"""WITH {grid('sum')}, w AS (SELECT *, lag(y, 1) {over(BY_TYPE)} AS l1, lag(y, 24) {over(BY_TYPE)} AS l24 FROM h)
        SELECT event_type, ts, ((hour(ts) BETWEEN 8 AND 10 OR hour(ts) BETWEEN 18 AND 20) AND isodow(ts) <= 5)::BIGINT AS hour_dow_peak,
        (isodow(ts) >= 6 AND hour(ts) BETWEEN 2 AND 6)::BIGINT AS weekend_hour_low,
        {r('l1 * hour(ts)')} AS lag1_hour_interaction, {r('l24 * (isodow(ts) - 1)')} AS lag24_dow_interaction FROM w""",
    "fourier": f"WITH {days()}, n AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i FROM d) SELECT ts, {columns(fourier_terms('i'))} FROM n",
    "group_labels": "SELECT o_orderkey, " + ", ".join(f"{e} AS {n}" for n, e in labels("o_orderdate").items()) + " FROM orders",
    "lags": windowed(lags(BY_TYPE, ADVANCED_LAGS)),
    "rolling_mean_std": windowed(mean_std(BY_TYPE, ADVANCED_WINDOWS)),
    "rolling_range": windowed(min_max(BY_TYPE, ADVANCED_WINDOWS)),
    "rolling_median": windowed(medians(BY_TYPE, ADVANCED_WINDOWS)),
    "rolling_quartiles": windowed(quartiles(BY_TYPE, STATISTICS)),
    "zscores": windowed({**zscores(BY_TYPE, ADVANCED_WINDOWS), **zscores(BY_TYPE, STATISTICS, "percentile")}),
    "ewma": f"""WITH {grid('mean')}, {ewma_ctes('h', 'event_type', ALPHAS)}
        SELECT event_type, ts, {r('y')} AS y, {', '.join(f"{r(f'y_ewma_0_{n}')} AS y_ewma_0_{n}" for n in (1, 3, 5, 7))}
        FROM h JOIN ew USING (event_type, ts)""",
    "differences": windowed(differences(BY_TYPE)),
    "percent_change": f"""WITH {grid('mean')}, f AS (SELECT event_type, ts, y, {filled('y', BY_TYPE, False)} AS fy FROM h)
        SELECT event_type, ts, {r('y')} AS y, {columns(changes(BY_TYPE, 'fy'))} FROM f""",
    "ffill": f"WITH {grid('mean')} SELECT event_type, ts, {r(filled('y', BY_TYPE, False))} AS y FROM h",
    "bfill": f"""WITH {grid('mean')} SELECT event_type, ts, {r('first_value(y IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts '
        'ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)')} AS y FROM h""",
    "handle_missing": f"WITH {grid('mean')} SELECT event_type, ts, {r(filled('y', BY_TYPE))} AS y FROM h",
    "fill_median": f"""WITH {grid('mean')}, m AS (SELECT event_type, quantile_cont(y, 0.5) AS m FROM h GROUP BY 1)
        SELECT event_type, ts, {r('coalesce(y, m)')} AS y FROM h JOIN m USING (event_type)""",
    "features_basic": f"WITH {grid('mean')}, {basic_sql('h', BY_TYPE, 'event_type', 4)} {basic_select('event_type', 4)}",
    "features_basic_daily": f"WITH {days()}, {basic_sql('d', '', None, 2)} {basic_select(None, 2)}",
    "features_compact": compact_sql(),
    "features_advanced": advanced_sql(),
    "features_comprehensive": comprehensive_sql(),
    "split_temporal": f"""SELECT event_type, event_id, CASE WHEN row_number() OVER ({BY_TYPE} ORDER BY ts, event_id) - 1 <
        floor(count(*) OVER ({BY_TYPE}) * 0.8) THEN 'train' ELSE 'test' END AS split FROM events""",
    "split_gap": f"""WITH {grid('sum')}, n AS (SELECT *, row_number() {over(BY_TYPE)} - 1 AS i, count(*) OVER ({BY_TYPE}) AS n FROM h)
        SELECT event_type, ts, {r('y')} AS y, CASE WHEN i < n - floor(n * 0.2) - 168 THEN 'train'
        WHEN i < n - floor(n * 0.2) THEN 'gap' ELSE 'test' END AS split FROM n""",
    "split_random": """WITH n AS (SELECT event_type, event_id, round_even(count(*) OVER t * 0.2, 0) AS wanted,
        row_number() OVER (PARTITION BY event_type ORDER BY ('0x' || substr(md5(concat_ws('|', event_type,
        epoch_us(ts)::VARCHAR, event_id::VARCHAR, '42')), 1, 13))::BIGINT) AS place FROM events WINDOW t AS (PARTITION BY event_type))
        SELECT event_type, event_id FROM n WHERE place <= wanted""",
    "folds": f"""WITH {grid('sum')}, n AS (SELECT *, row_number() {over(BY_TYPE)} - 1 AS i, count(*) OVER ({BY_TYPE}) AS n FROM h),
        f AS (SELECT *, unnest([0, 1, 2]) AS fold FROM n),
        s AS (SELECT *, n - (n // 4) * (3 - fold) AS start FROM f)
        SELECT event_type, ts, {r('y')} AS y, fold::BIGINT AS fold, CASE WHEN i < start THEN 'train' ELSE 'test' END AS role
        FROM s WHERE i < start + n // 4""",
    "validation_tail": f"""WITH {days()}, n AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM d)
        SELECT ts, {r('y', 2)} AS y FROM n WHERE i >= floor(n * 0.8)""",
    "metrics_point": f"WITH {p_ctes()} SELECT model, event_type, {columns(point('y', 'yhat'))}, {counts('y', 'yhat')} FROM m GROUP BY 1, 2",
    "metrics_aligned": f"WITH {p_ctes()} SELECT event_type, {columns(point('y', 'lag_24'))}, {counts('y', 'lag_24')} FROM p GROUP BY 1",
    "mape_plain": f"""WITH {grid('sum')}, w AS (SELECT *, lag(y, 1) {over(BY_TYPE)} AS l FROM h)
        SELECT event_type, {r('avg(abs((y - l) / nullif(y, 0))) * 100')} AS mape,
        sum((y = 0)::INT)::BIGINT AS zero_truth FROM w GROUP BY 1""",
    "metrics_quantile": f"WITH {p_ctes()} SELECT event_type, {columns({**PINBALLS, **INTERVAL})} FROM p GROUP BY 1",
    "metrics_interval": f"WITH {p_ctes()} SELECT {columns(INTERVAL)} FROM p",
    "crps": crps_sql(),
    "group_metrics": f"""WITH {p_ctes()}, {group_ctes([*GROUPINGS, 'kind'])}
        SELECT model, grouping_name AS grouping, label, {r('mae')} AS mae, {r('rmse')} AS rmse, n AS count FROM g""",
    "metric_by_group": f"""WITH {p_ctes()}, g AS (SELECT model, event_type, sqrt(avg((y - yhat) * (y - yhat))) AS v FROM m GROUP BY 1, 2)
        SELECT model, event_type, {r('v')} AS metric, {r('var_pop(v) OVER (PARTITION BY model)')} AS inter_group_variance,
        {r('max(v) OVER (PARTITION BY model) - min(v) OVER (PARTITION BY model)')} AS max_group_difference FROM g""",
    "fairness_parity": f"""WITH {p_ctes()}, {group_ctes([*GROUPINGS, 'kind'])}
        SELECT model, grouping_name AS grouping, {columns({**spread('mae'), **spread('rmse')})}, count(*) AS n_groups FROM g GROUP BY 1, 2""",
    "coverage_by_group": f"""WITH {p_ctes()}, {labelled_ctes(GROUPINGS, 'p', 'q50')}
        SELECT grouping_name AS grouping, label, {r(f'avg({COVERED})')} AS coverage, count(*) AS count FROM l GROUP BY 1, 2""",
    "coverage_parity": f"""WITH {p_ctes()}, {labelled_ctes(GROUPINGS, 'p', 'q50')},
        g AS (SELECT grouping_name, label, avg({COVERED}) AS coverage FROM l GROUP BY 1, 2)
        SELECT grouping_name AS grouping, {r(spread('coverage')['coverage_variance'])} AS coverage_variance,
        {r(spread('coverage')['coverage_range'])} AS coverage_range, count(*) AS n_groups FROM g GROUP BY 1""",
    "fairness_summary": f"""WITH {p_ctes()}, {summary_ctes(True)} SELECT model, grouping_name AS grouping, metric,
        {r('variance')} AS variance, {r('"range"')} AS "range", {r('coefficient_variation')} AS coefficient_variation FROM su""",
    "compare_fairness": compare_fairness_sql(),
    "least_disparity": f"""WITH {p_ctes()}, {summary_ctes(False)},
        t AS (SELECT 'variance' AS criterion, model, sum(variance) AS disparity FROM su GROUP BY 2
              UNION ALL SELECT 'range', model, sum("range") FROM su GROUP BY 2)
        SELECT criterion, model, {r('disparity')} AS disparity FROM t
        QUALIFY row_number() OVER (PARTITION BY criterion ORDER BY disparity, model) = 1""",
    "leaderboard": f"WITH {p_ctes()} SELECT model, {columns(point('y', 'yhat'))} FROM m GROUP BY 1",
    "best_model": f"""WITH {p_ctes()}, b AS (SELECT model, {point('y', 'yhat')['rmse']} AS rmse FROM m GROUP BY 1)
        SELECT model, {r('rmse')} AS rmse FROM b ORDER BY rmse, model LIMIT 1""",
    "plausibility": f"""WITH {p_ctes()}, s AS (SELECT model, {point('y', 'yhat')['mae']} AS mae, {point('y', 'yhat')['rmse']} AS rmse,
        {point('y', 'yhat')['r2']} AS r2, avg(abs((y - yhat) / nullif(y, 0))) * 100 AS mape FROM m GROUP BY 1)
        SELECT model, {r('mae')} AS mae, {r('rmse')} AS rmse, {r('r2')} AS r2, {r('mape')} AS mape,
        concat_ws('; ', CASE WHEN r2 > 0.9 THEN 'r2 too high, overfitting likely' END,
        CASE WHEN mape < 3 THEN 'mape too low, overfitting likely' END, CASE WHEN r2 < 0.5 THEN 'r2 low, weak model' END,
        CASE WHEN mape > 20 THEN 'mape high, imprecise model' END) AS warnings,
        NOT (r2 > 0.9 OR mape < 3 OR r2 < 0.5 OR mape > 20) AS is_realistic FROM s""",
    "kpis": f"""WITH {p_ctes()} SELECT event_type, {r('avg(mean_24)')} AS mean, {r('max(mean_24)')} AS max,
        {r('min(mean_24)')} AS min, {r('stddev_samp(mean_24)')} AS volatility FROM p GROUP BY 1""",
    "completeness": completeness_sql(),
    "describe": describe_sql(),
    "range_stats": f"""SELECT event_type, count(*) AS n_rows, min(ts) AS start, max(ts) AS "end",
        {r('(epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9', 4)} AS duration_hours, {r('min(value)', 4)} AS min_value,
        {r('max(value)', 4)} AS max_value, {r('avg(value)', 4)} AS mean_value, {r('stddev_samp(value)', 4)} AS std_value
        FROM events GROUP BY 1""",
    "overview": f"""WITH g AS (SELECT event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER ({BY_TYPE} ORDER BY ts) AS gap FROM events),
        c AS (SELECT event_type, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1, 2),
        t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, gap) = 1)
        SELECT event_type, count(*) AS rows, min(ts) AS start, max(ts) AS "end",
        (epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000 AS duration_days, 6::BIGINT AS columns,
        'event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string' AS data_types,
        CASE any_value(gap) WHEN 3600000000 THEN '1h' ELSE 'custom_' || printf('%.6f', any_value(gap) / 1e6) || 's' END AS frequency
        FROM events JOIN t USING (event_type) GROUP BY 1""",
    "validate": """SELECT (count(*) >= 100) AS is_valid, CASE WHEN count(*) >= 100 THEN '' ELSE 'fewer than 100 rows' END AS reasons,
        'complete' AS "case" FROM orders UNION ALL SELECT false, 'missing columns: load', 'missing column'""",
    "exact_quantiles": " UNION ALL ".join(
        f"SELECT l_returnflag, '{c}' AS \"column\", {r(f'quantile_cont({c}, 0.05)', 4)} AS p05, "
        f"{r(f'quantile_cont({c}, 0.5)', 4)} AS p50, {r(f'quantile_cont({c}, 0.99)', 4)} AS p99 FROM lineitem GROUP BY 1"
        for c in ("l_extendedprice", "l_quantity")),
    "scale_robust": robust_sql(),
    "scale_standard": f"""WITH {grid('sum')}, s AS (SELECT event_type, avg(y) AS m, stddev_pop(y) AS s FROM h GROUP BY 1)
        SELECT event_type, ts, {r('(y - m) / CASE WHEN s = 0 THEN 1 ELSE s END')} AS y FROM h JOIN s USING (event_type)""",
    "f_scores": f_scores_sql(),
    "simple_ols": f"""WITH {model_ctes()}, f AS (SELECT regr_slope(y, y_lag_1) AS a, regr_intercept(y, y_lag_1) AS b FROM t)
        SELECT ts, {r('a * y_lag_1 + b')} AS yhat FROM t, f""",
    "model_scores": f"""WITH {model_ctes()}, f AS (SELECT regr_slope(y, y_lag_7) AS a, regr_intercept(y, y_lag_7) AS b FROM t),
        q AS (SELECT y, a * y_lag_7 + b AS yhat FROM t, f)
        SELECT {columns(point('y', 'yhat'), 3)}, {counts('y', 'yhat')} FROM q""",
    "ridge": penalised_sql("n * cxy / (n * vx + 100.0)"),
    "elastic_net": penalised_sql("sign(cxy) * greatest(abs(cxy) - 0.05, 0) / (vx + 0.05)"),
    "grid_search": grid_search_sql(),
    "ensemble_weights": f"""WITH {p_ctes()}, {weights_ctes(ENSEMBLE, 'event_type')}
        SELECT event_type, {columns({f'weight_{c}': f'weight_{c}' for c in ENSEMBLE})} FROM wt""",
    "contributions": contributions_sql(),
    "forecast_naive": f"""WITH {grid('mean')}, l AS (SELECT event_type, max(ts) AS ts, arg_max(y, ts) FILTER (WHERE y IS NOT NULL) AS v FROM h GROUP BY 1),
        f AS (SELECT event_type, ts, v, unnest(range(1, 25)) AS s FROM l)
        SELECT event_type, ts + s * INTERVAL 1 HOUR AS ts, s AS horizon_step, {r('v')} AS yhat, 'Naive Last' AS model_name,
        '1.0' AS model_version, {r('least(v * 0.9, v * 1.1)')} AS yhat_lower, {r('greatest(v * 0.9, v * 1.1)')} AS yhat_upper FROM f""",
    "forecast_rows": forecast_rows_sql(),
    "latest_model": """SELECT 'models/' || arg_max(o_orderkey, (o_orderdate, 'models/' || o_orderkey)) AS path, max(o_orderdate) AS trained_at,
        arg_max(o_orderpriority, (o_orderdate, 'models/' || o_orderkey)) AS model_type FROM orders WHERE contains(o_orderpriority, 'URGENT')
        UNION ALL SELECT 'models/' || arg_max(o_orderkey, (o_orderdate, 'models/' || o_orderkey)), max(o_orderdate),
        arg_max(o_orderpriority, (o_orderdate, 'models/' || o_orderkey)) FROM orders""",
}


def per_series_sql() -> str:
    """A line per event type through the value of a day before, applied to that type's last row."""
    return f"""WITH {grid('sum')},
    x AS (SELECT event_type, ts, y, coalesce(lag(y, 24) {over(BY_TYPE)}, first_value(y) {over(BY_TYPE)}) AS a FROM h),
    w AS (SELECT event_type, regr_slope(y, a) AS w, regr_intercept(y, a) AS c, max(ts) AS last, arg_max(a, ts) AS a
          FROM x GROUP BY 1),
    f AS (SELECT *, unnest(range(1, 25)) AS step FROM w)
    SELECT event_type, last + step * INTERVAL 1 HOUR AS ts, step AS horizon_step, {r("c + w * a")} AS yhat,
    'Linear Regression per Series' AS model_name, '1.0' AS model_version FROM f"""


def stumps_sql(names: list[str], whole: str, group: str) -> str:
    """From a statistic of all rows half the way to that of the row's group, twice."""
    cells = ", ".join(f"{whole.format(q=n)} AS s{i}" for i, n in enumerate(names))
    parts = ", ".join(f"{group.format(q=n)} AS g{i}" for i, n in enumerate(names))
    out = ", ".join(f"{r(f's{i} + 0.75 * (g{i} - s{i})', 2)} AS {'yhat' if len(names) == 1 else f'q{round(float(n) * 100)}'}"
                    for i, n in enumerate(names))
    return f"""WITH {days()}, w AS (SELECT ts, y, isodow(ts) >= 6 AS g, row_number() OVER (ORDER BY y) AS k, count(*) OVER () AS n,
          row_number() OVER (PARTITION BY isodow(ts) >= 6 ORDER BY y) AS kg, count(*) OVER (PARTITION BY isodow(ts) >= 6) AS ng FROM d),
    a AS (SELECT {cells} FROM w), b AS (SELECT g, {parts} FROM w GROUP BY g)
    SELECT ts, {out} FROM w JOIN b USING (g), a"""


def two_features_sql() -> str:
    """Least squares with two features by the rule for two unknowns, applied to each series' next day."""
    return f"""WITH {grid('sum')},
    x AS (SELECT event_type, ts, y, {calendar('ts')['hour_cos']} AS b,
          coalesce(lag(y, 24) {over(BY_TYPE)}, first_value(y) {over(BY_TYPE)}) AS a FROM h),
    s AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS ab,
          covar_pop(a, y) AS ay, covar_pop(b, y) AS byy FROM x),
    w AS (SELECT *, (ay * vb - byy * ab) / (va * vb - ab * ab) AS wa, (byy * va - ay * ab) / (va * vb - ab * ab) AS wb FROM s),
    l AS (SELECT event_type, max(ts) AS last, arg_max(a, ts) AS a FROM x GROUP BY 1),
    f AS (SELECT event_type, a, unnest(range(1, 25)) AS step, last FROM l),
    t AS (SELECT event_type, a, step, last + step * INTERVAL 1 HOUR AS ts FROM f)
    SELECT event_type, ts, step AS horizon_step, {r("my + wa * (a - ma) + wb * (" + calendar('ts')['hour_cos'] + " - mb)")} AS yhat,
    'Linear Regression' AS model_name, '1.0' AS model_version FROM t, w"""


ORACLES |= {
    "on_spine_odd": odd_bins_sql(),
    "resample_nan": f"""WITH {grid('max').replace('FROM events', 'FROM (SELECT event_type, ts, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)')}
        SELECT event_type, ts, {r('y')} AS value FROM h""",
    "by_time": f"WITH {grid('mean')} SELECT event_type, ts, {r('y')} AS y FROM h",
    "quantile_leaderboard": ORACLES["metrics_quantile"],
    "feature_selection": f"WITH {days()} SELECT count(*) AS n_rows, 3::BIGINT AS n_chosen, true AS all_given FROM d",
    "random_forest": f"WITH {days()} SELECT ts, {r('y / 1e6')} AS y, true AS in_range FROM d",
    "deep_tree": f"""WITH {days()} SELECT ts, {r("avg(y) OVER (PARTITION BY dayofweek(ts))", 2)} AS yhat FROM d""",
    "forest_grid": """SELECT t::BIGINT AS trees, d::BIGINT AS depth, s::BIGINT AS least_split, l::BIGINT AS least_leaf,
                      true AS best_is_least
                      FROM (SELECT unnest([50, 100, 200]) AS t), (SELECT unnest([10, 20, NULL]) AS d),
                      (SELECT unnest([2, 5, 10]) AS s), (SELECT unnest([1, 2, 4]) AS l)""",
    "boosting_grid": f"""SELECT i::BIGINT AS rounds, {r("s::DOUBLE")} AS rate, d::BIGINT AS depth, true AS best_is_least
                      FROM (SELECT unnest([100, 200]) AS i), (SELECT unnest([0.05, 0.1, 0.2]) AS s),
                      (SELECT unnest([3, 5, 7]) AS d)""",
    "ensemble_default": """SELECT * FROM (VALUES ('Enhanced Ridge', 4::BIGINT, true),
                      ('Enhanced Random Forest', 81::BIGINT, true), ('Enhanced Gradient Boosting', 18::BIGINT, true))
                      AS m(member, settings, is_share)""",
    "gradient_boosting": f"WITH {days()} SELECT count(*) AS n_rows, true AS better_than_mean FROM d",
    "boosted_stump": f"""WITH {days()} SELECT ts, {r("avg(y) OVER (PARTITION BY isodow(ts) >= 6)", 2)} AS yhat FROM d""",
    "leaf_boosting_stumps": stumps_sql(["0"], "avg(y)", "avg(y)"),
    "quantile_boosting_stumps": stumps_sql(["0.1", "0.5", "0.9"], "min(y) FILTER (k >= {q} * n)", "min(y) FILTER (kg >= {q} * ng)"),
    "quantile_boosting": "SELECT unnest(['q10', 'q50', 'q90']) AS quantile, true AS better",
    "ensemble_forecast": f"WITH {days()} SELECT ts, true AS adds_up, true AS weights_are_shares FROM d",
    "ensemble_round_trip": f"WITH {days()} SELECT ts, true AS same FROM d",
    "forecast_two_features": two_features_sql(),
    "forecast_saved": two_features_sql(),
    "forecast_per_series": per_series_sql(),
    "per_series_search": per_series_search_sql(),
    "elastic_grid": elastic_grid_sql(),
    "ridge_grid": "SELECT unnest([0.1, 1.0, 10.0, 100.0])::DOUBLE AS alpha, true AS best_is_least, true AS better, "
                  "35::BIGINT AS n_features",
}
ORACLES["ingest_stream"] = ORACLES["ingest_records"].replace("SELECT event_id, ", "SELECT ", 1)
ORACLES["ingest_corrected"] = (
    ORACLES["ingest_stream"].replace(f"{r('value')} AS y, {r('value')} AS consommation",
                                     f"{r('seen')} AS y, {r('seen')} AS consommation")
    .replace("FROM events", "FROM (SELECT *, CASE WHEN event_id % 50 = 0 THEN 1.5 ELSE value END AS seen FROM events)"))
ORACLES["report_round_trip"] = (
    f"WITH {p_ctes()} SELECT model, {columns(point('y', 'yhat'))}, {counts('y', 'yhat')} FROM m GROUP BY 1")
ORACLES["forecast_round_trip"] = ORACLES["forecast_naive"]
ORACLES["model_round_trip"] = ORACLES["simple_ols"]
