"""Exact quantiles and order statistics without gathering a group.

A mergeable sketch of the values between two known bounds gives tighter bounds for the next
pass; how many values lie below and between them is then counted. Values are only compared,
never subtracted, so infinite ones and any range do no harm. Every pass combines before it
shuffles, and a few passes leave a range small enough to sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..series import without_nan
from ..session import cut_lineage, keep_table
from .chunks import BROADCAST_ROWS, attach, beside

#: Parts into which a sketch divides a range, and its accuracy in ranks.
PARTS, ACCURACY = 256, 4096
SORT_LIMIT = 1_000_000


def _select_ranks(values: DataFrame, ids: list[str], ranks: DataFrame, sort_limit: int) -> DataFrame:
    """Value at each 0-based rank. ``values``: ids + value; ``ranks``: ids + rank, lo, hi, below, inside.

    ``values`` holds at least what lies between ``lo`` and ``hi``; ``below`` counts all smaller ones.
    """
    state = ranks
    # the values stay in place while the bounds are few, which is known by counting them
    few = state.count() <= BROADCAST_ROWS

    def beside(bounds: DataFrame) -> DataFrame:
        found = values.join(F.broadcast(bounds) if few else bounds, ids)
        return found.where(F.col("value").between(F.col("lo"), F.col("hi")))

    def bounds() -> DataFrame:
        return state.select(*ids, "lo", "hi").distinct()

    points = F.array(*[F.lit(i / PARTS) for i in range(PARTS + 1)])
    left = None
    while True:
        widest = state.where(F.col("lo") < F.col("hi")).agg(F.max("inside")).first()[0]
        # a range that does not narrow is one of equal values
        if widest is None or widest <= sort_limit or widest == left:
            break
        left = widest
        sketch = (beside(bounds()).groupBy(*ids, "lo", "hi")
                  .agg(F.percentile_approx("value", points, ACCURACY).alias("at")))
        part = F.floor((F.col("rank") - F.col("below")) / F.col("inside") * PARTS).cast("int")
        # one part more to each side covers the error of the sketch
        narrowed = cut_lineage(state.join(sketch, [*ids, "lo", "hi"]).select(
            *ids, "rank", "lo", "hi", "below", "inside", F.get("at", F.greatest(part - 1, F.lit(0))).alias("from"),
            F.get("at", F.least(part + 2, F.lit(PARTS))).alias("to")))
        counted = beside(narrowed.select(*ids, "lo", "hi", "from", "to").distinct()).groupBy(
            *ids, "lo", "hi", "from", "to").agg(
            F.count_if(F.col("value") < F.col("from")).alias("less"),
            F.count_if(F.col("value").between(F.col("from"), F.col("to"))).alias("n"))
        joined = narrowed.join(counted, [*ids, "lo", "hi", "from", "to"])
        start = F.col("below") + F.col("less")
        holds = (F.col("rank") >= start) & (F.col("rank") < start + F.col("n"))
        state = cut_lineage(joined.select(*ids, "rank", *[
            F.when(holds, new).otherwise(F.col(old)).alias(old) for old, new in
            (("lo", F.col("from")), ("hi", F.col("to")), ("inside", F.col("n")), ("below", start))]))
    counted = beside(bounds()).groupBy(*ids, "lo", "hi", "value").agg(F.count("*").alias("n"))
    up_to = Window.partitionBy(*ids, "lo", "hi").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("end", F.sum("n").over(up_to))
    return (state.join(counted, [*ids, "lo", "hi"])
            .where((F.col("rank") >= F.col("below") + F.col("end") - F.col("n"))
                   & (F.col("rank") < F.col("below") + F.col("end")))
            .select(*ids, "rank", "value"))


def _near_levels(wide: DataFrame, keys: list[str], count: int, levels: list[float], extent: DataFrame) -> DataFrame:
    """One row per key with, for column i and level j, bounds of the level (``_lo``, ``_hi``) and how many values lie
    ``_below`` and ``_inside`` of them. Bounds that miss the level are replaced by the extremes."""
    spots = [(i, j) for i in range(count) for j in range(len(levels))]
    counts = [e for i, j in spots for e in (
        F.count_if(F.col(f"_c{i}") < F.col(f"_from{i}_{j}")).alias(f"_less{i}_{j}"),
        F.count_if(F.col(f"_c{i}").between(F.col(f"_from{i}_{j}"), F.col(f"_to{i}_{j}"))).alias(f"_within{i}_{j}"))]
    seen = attach(wide, extent, keys).groupBy(*keys).agg(*counts)
    out = []
    for i, j in spots:
        h, less, within = (F.col(f"_n{i}") - 1) * levels[j], F.col(f"_less{i}_{j}"), F.col(f"_within{i}_{j}")
        holds = (F.floor(h) >= less) & (F.ceil(h) < less + within)
        out += [F.when(holds, near).otherwise(far).alias(f"{name}{i}_{j}") for name, near, far in (
            ("_lo", F.col(f"_from{i}_{j}"), F.col(f"_min{i}")), ("_hi", F.col(f"_to{i}_{j}"), F.col(f"_max{i}")),
            ("_below", less, F.lit(0).cast("long")), ("_inside", within, F.col(f"_n{i}")))]
    return cut_lineage(beside(extent, seen, keys).select(*keys, *[f"_n{i}" for i in range(count)], *out))


def exact_quantiles(df: DataFrame, columns: list[str], levels: dict[str, float],
                    keys: tuple[str, ...] | list[str] = (),
                    sort_limit: int = SORT_LIMIT) -> DataFrame:
    """Linearly interpolated quantiles: one row per key and column, one column per level.

    A column without any value in a series has no row. ``df`` is read at most three times, with all columns side by
    side: for sketches, for counts around each level, and for the few values near one, which are stored; what is
    left to narrow reads those alone.
    """
    keys, ids, points = list(keys), [*keys, "column"], list(levels.values())
    wide = without_nan(df.select(*keys, *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)]),
                       [f"_c{i}" for i in range(len(columns))])
    margin = 2 / ACCURACY
    around = F.array(*[F.lit(min(max(p + side, 0.0), 1.0)) for p in points for side in (-margin, margin)])
    aggregates, bounds = [], []
    for i in range(len(columns)):
        c = F.col(f"_c{i}")
        aggregates += [F.count(c).alias(f"_n{i}"), F.min(c).alias(f"_min{i}"), F.max(c).alias(f"_max{i}"),
                       F.percentile_approx(c, around, ACCURACY).alias(f"_at{i}")]
        for j, p in enumerate(points):
            at = F.col(f"_at{i}")
            bounds += [(F.col(f"_min{i}") if p <= margin else F.get(at, F.lit(2 * j))).alias(f"_from{i}_{j}"),
                       (F.col(f"_max{i}") if p >= 1 - margin else F.get(at, F.lit(2 * j + 1))).alias(f"_to{i}_{j}")]
    extent = cut_lineage(wide.groupBy(*keys).agg(*aggregates).select(
        *keys, *[f"{name}{i}" for i in range(len(columns)) for name in ("_n", "_min", "_max")], *bounds))
    largest = extent.agg(F.max(F.greatest(*[f"_n{i}" for i in range(len(columns))], F.lit(0)))).first()[0] or 0
    if largest <= sort_limit:
        names = F.element_at(F.array(*map(F.lit, columns)), F.substring("column", 3, 9).cast("int") + 1)
        at = F.percentile("value", F.array(*[F.lit(p) for p in points]))
        return (wide.unpivot(keys, [f"_c{i}" for i in range(len(columns))], "column", "value")
                .where(F.col("value").isNotNull()).groupBy(*ids).agg(at.alias("_p"))
                .select(*keys, names.alias("column"), *[F.col("_p")[j].alias(name) for j, name in enumerate(levels)]))
    near = _near_levels(wide, keys, len(columns), points, extent)
    ranks, close, totals = [], [], []
    for i, c in enumerate(columns):
        totals.append(F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("n")))
        hit = F.lit(False)
        for j, p in enumerate(points):
            lo, hi = F.col(f"_lo{i}_{j}"), F.col(f"_hi{i}_{j}")
            hit = hit | F.col(f"_c{i}").between(lo, hi)
            h = (F.col(f"_n{i}") - 1) * p
            ranks += [F.struct(F.lit(c).alias("column"), rank.alias("rank"), lo.alias("lo"), hi.alias("hi"),
                               F.col(f"_below{i}_{j}").alias("below"), F.col(f"_inside{i}_{j}").alias("inside"))
                      for rank in (F.floor(h), F.ceil(h))]
        close.append(F.when(hit, F.struct(F.lit(c).alias("column"), F.col(f"_c{i}").alias("value"))))
    stats = near.select(*keys, F.explode(F.array(*totals)).alias("_r")).select(*keys, "_r.*").where("n > 0")
    wanted = near.select(*keys, F.explode(F.array(*ranks)).alias("_r")).select(*keys, "_r.*").where("inside > 0")
    values = keep_table(attach(wide, near, keys).select(*keys, F.explode(F.array_compact(F.array(*close))).alias("_v"))
                        .select(*keys, "_v.*"), "near")
    # neighbouring levels may want the same rank between different bounds
    found = _select_ranks(values, ids, cut_lineage(wanted.distinct()), sort_limit)
    at = found.distinct().groupBy(*ids).agg(
        F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"))
    joined = stats.join(at, ids)
    out = []
    for name, p in levels.items():
        h = (F.col("n") - 1) * p
        low, high = F.col("_at")[F.floor(h)], F.col("_at")[F.ceil(h)]
        # no arithmetic between equal ends: infinite values have no difference
        out.append(F.when(low == high, low).otherwise(low + (high - low) * (h - F.floor(h))).alias(name))
    return joined.select(*ids, *out)


def value_at_rank(df: DataFrame, value: str, rank: DataFrame, keys: tuple[str, ...] | list[str],
                  sort_limit: int = SORT_LIMIT) -> DataFrame:
    """The value at one 0-based rank per key; ``rank`` has the keys and ``rank``.

    ``value`` must be exactly representable as a double.
    """
    ids = [*keys, "column"]
    values = df.select(*keys, F.lit(value).alias("column"), F.col(value).cast("double").alias("value"))
    values = without_nan(values, ["value"])
    values = values.where(F.col("value").isNotNull())
    stats = values.groupBy(*ids).agg(
        F.count("*").alias("inside"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    wanted = rank.withColumn("column", F.lit(value))
    state = cut_lineage(stats.join(wanted, ids).where(F.col("rank").between(0, F.col("inside") - 1))
                        .withColumn("below", F.lit(0).cast("long")))
    return _select_ranks(values, ids, state, sort_limit).select(*keys, "value")
