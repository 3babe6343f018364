"""Splits by position in time: every row gets a label, nothing is moved or dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..series import SeriesSpec, epoch_us
from .chunks import attach, with_place
from .quantiles import value_at_rank

# Default share of test rows, rows between train and test, folds, seed.
TEST_SHARE = 0.2
GAP_ROWS = 168
FOLDS = 3
SEED = 42

_P, _N = "_position", "_length"


def _placed(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    return with_place(df, spec, _P, _N)


def temporal(df: DataFrame, spec: SeriesSpec, test_share: float = TEST_SHARE,
             name: str = "split") -> DataFrame:
    """``train`` for the first rows of each series, ``test`` for the rest."""
    border = F.floor(F.col(_N) * F.lit(1 - test_share))
    label = F.when(F.col(_P) < border, "train").otherwise("test")
    return _placed(df, spec).withColumn(name, label).drop(_P, _N)


def with_gap(df: DataFrame, spec: SeriesSpec, test_share: float = TEST_SHARE,
             gap: int = GAP_ROWS, name: str = "split") -> DataFrame:
    """``train``, then ``gap`` rows labelled ``gap``, then ``test``.

    A series too short for gap and test fails the query instead of yielding wrong rows.
    """
    train_end = F.col(_N) - F.floor(F.col(_N) * F.lit(test_share)) - gap
    label = (F.when(train_end < 0, F.raise_error(F.lit("a series is shorter than test and gap")))
             .when(F.col(_P) < train_end, "train")
             .when(F.col(_P) < train_end + gap, "gap").otherwise("test"))
    return _placed(df, spec).withColumn(name, label).drop(_P, _N)


def random(df: DataFrame, spec: SeriesSpec, test_share: float = TEST_SHARE, seed: int = SEED,
           name: str = "split") -> DataFrame:
    """Exactly ``round(n * test_share)`` random test rows per series, the same on every run.

    A row's draw is 52 bits of the MD5 of its identity, with time stamps in microseconds since 1970, and the seed;
    the cut-off draw is found by counting.
    """
    stamps = {spec.ts: epoch_us(df, spec.ts)}
    identity = [stamps.get(c, F.col(c)).cast("string") for c in (*spec.keys, *spec.order)]
    digest = F.md5(F.concat_ws("|", *identity, F.lit(str(seed))))
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
    drawn = df.withColumn("_draw", draw)
    count = F.rint(F.count("*") * F.lit(test_share)).cast("long")
    wanted = df.groupBy(*spec.keys).agg((count - 1).alias("rank"))
    cut = value_at_rank(drawn, "_draw", wanted, spec.keys).withColumnRenamed("value", "_cut")
    if not spec.keys:
        cut = cut.agg(F.max("_cut").alias("_cut"))
    label = F.when(F.col("_draw") <= F.col("_cut"), "test").otherwise("train")
    return attach(drawn, cut, spec.keys).withColumn(name, label).drop("_draw", "_cut")


def expanding_folds(df: DataFrame, spec: SeriesSpec, folds: int = FOLDS) -> DataFrame:
    """Each row once per fold it takes part in, with ``fold`` (from 0) and ``role``.

    The last ``folds`` blocks of ``n // (folds + 1)`` rows are tested in turn, each by a
    model that saw only the rows before it.
    """
    size = F.call_function("div", F.col(_N), F.lit(folds + 1).cast("long"))
    roles = []
    for k in range(folds):
        start = F.col(_N) - size * (folds - k)
        role = (F.when(F.col(_P) < start, "train")
                .when(F.col(_P) < start + size, "test"))
        roles.append(F.when(role.isNotNull(), F.struct(F.lit(k).alias("fold"), role.alias("role"))))
    taking_part = F.array_compact(F.array(*roles))
    return (_placed(df, spec).withColumn("_f", F.explode(taking_part))
            .select(*df.columns, "_f.fold", "_f.role"))


def validation_tail(df: DataFrame, spec: SeriesSpec, share: float = TEST_SHARE) -> DataFrame:
    """The last rows of each series that ensemble weights are measured on."""
    return temporal(df, spec, share, "_part").where(F.col("_part") == "test").drop("_part")
