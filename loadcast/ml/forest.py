"""Random forests whose trees may grow to single rows, however large the table.

Nodes with many rows are split by passes over the table: every task sums weights and targets by node, feature and bin,
Spark adds them up and picks each node's split, and the driver gets one row per node. As soon as a node's rows fit into
a task they are shuffled there by tree and node, and the rest of the tree grows on the exact values. These parts stay a
table; the driver holds the nodes above them only, about two per ``LOCAL_CELLS`` values. A table that is no larger than
that goes to a few tasks whole, and each grows its share of the trees.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.evaluate import score
from ..session import keep_table, reach_package
from .trees import Nodes, Rule, draws, grown

#: Values (rows times features) up to which a node is grown in one task, and bytes of a task's sums in one pass.
LOCAL_CELLS, HIST_BYTES = 1 << 20, 128 << 20
#: Bins of a feature in a pass, and the accuracy of the quantiles between them.
BINS, ACCURACY = 256, 10_000
#: Tasks that take a small table whole; nodes of a model up to which every task has all of them; rows of a group
#: that is predicted by one part of a larger model.
TASKS, MODEL_NODES, GROUP_ROWS = 32, 2_000_000, 100_000
_PART = "tree int, part int, feature array<int>, threshold array<double>, left array<int>, value array<double>"
_FOREST = {"numTrees": 100, "seed": 42, "maxDepth": None, "minInstancesPerNode": 1, "minSamplesSplit": 2, "bootstrap": True}


@dataclass
class Top:
    """The upper nodes of a tree. A leaf with ``part`` True goes on in the part of the same number."""

    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])
    part: list[bool] = field(default_factory=lambda: [False])

    def split(self, node: int, feature: int, threshold: float) -> int:
        left = len(self.feature)
        self.feature[node], self.threshold[node], self.left[node] = feature, threshold, left
        for _ in range(2):
            for values, x in ((self.feature, -1), (self.threshold, 0.0), (self.left, 0), (self.value, self.value[node]),
                              (self.depth, self.depth[node] + 1), (self.part, False)):
                values.append(x)
        return left

    def nodes(self) -> Nodes:
        return Nodes(np.array(self.feature), np.array(self.threshold), np.array(self.left), np.array(self.value))

    def leaf(self, x: np.ndarray) -> np.ndarray:
        numbered = self.nodes()
        numbered.value = np.arange(len(self.feature))
        return numbered.walk(x, [None])[:, 0].astype(int)


def matrix(b: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Column ``x``, an array of the features, as rows."""
    column = b.column("x")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())


def _part_rows(found: list[tuple[int, int, Nodes]]) -> pa.Table:
    columns = [[t for t, _, _ in found], [p for _, p, _ in found],
               *[[getattr(n, c) for _, _, n in found] for c in ("feature", "threshold", "left", "value")]]
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.float64())]
    names = ["tree", "part", "feature", "threshold", "left", "value"]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def training_table(df: DataFrame, features: list[str], target: str, seed: int, extra: list[str] | None = None) -> DataFrame:
    """Rows with a target, stored: ``x`` (the features), ``y``, ``u`` (a random number that names the row) and ``extra``.

    A null or NaN feature is an error.
    """
    reach_package(df.sparkSession)
    known = df.where(F.col(target).isNotNull())
    number = [F.col(c).cast("double") for c in features]
    row = known.agg(F.count("*"), *[F.count_if(c.isNull() | F.isnan(c)) for c in number]).first()
    if not row[0]:
        raise ValueError("no row with a target to fit on")
    missing = [c for i, c in enumerate(features) if row[1 + i]]
    if missing:
        raise ValueError(f"null values in {', '.join(missing)}")
    return keep_table(known.select(F.array(*number).alias("x"), F.col(target).cast("double").alias("y"),
                                   F.xxhash64(F.rand(seed)).alias("u"), *(extra or [])), "forest")


def grown_here(x: np.ndarray, y: np.ndarray, u: np.ndarray, trees: list[int], seed: int | None, rule: Rule) -> list[Nodes]:
    """These trees from rows that are all in this task."""
    found = []
    for tree in trees:
        w = draws(u, tree, seed)
        drawn = w > 0 if w.any() else w == 0  # a few rows may all be missed
        found.append(grown(x[drawn], y[drawn], np.maximum(w[drawn], 1), rule))
    return found


class _Growth:
    """Grows all trees of one forest from a stored training table."""

    def __init__(self, table: DataFrame, width: int, trees: int, seed: int | None, rule: Rule):
        self.table, self.width, self.seed, self.rule = table, width, seed, rule
        self.rows = table.count()
        self.local = max(1, LOCAL_CELLS // width)
        self.tops = [Top() for _ in range(trees)]

    def run(self) -> DataFrame:
        """The parts; ``tops`` are filled."""
        if self.rows <= self.local:
            for top in self.tops:
                top.part[0] = True
            return self._whole()
        open_ = [(t, 0) for t in range(len(self.tops))]
        slots = max(1, HIST_BYTES // (self.width * BINS * 24))
        edges = self._edges(self.table)
        while open_:
            batch, open_ = open_[:slots], open_[slots:]
            more, stuck = self._split(batch, edges)
            for tree, node in stuck:  # its rows lie in one bin of every feature: cut bins from them alone
                again, _ = self._split([(tree, node)], self._edges(self._reached(tree, node)))
                more += again
            open_ += more
        return self._parts()

    def _whole(self) -> DataFrame:
        seed, rule, trees = self.seed, self.rule, len(self.tops)
        tasks = min(trees, TASKS)

        def run(rows: pa.Table) -> pa.Table:
            which = list(range(rows.column("block")[0].as_py(), trees, tasks))
            found = grown_here(matrix(rows), rows.column("y").to_numpy(), rows.column("u").to_numpy(), which, seed, rule)
            return _part_rows([(t, 0, n) for t, n in zip(which, found, strict=True)])

        blocks = self.table.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
        return keep_table(blocks.groupBy("block").applyInArrow(run, _PART), "parts")

    def _edges(self, rows: DataFrame) -> list[np.ndarray]:
        """Ascending ends of bins per feature: quantiles and the least value, so that any two values can be told apart."""
        shares = [i / (BINS - 1) for i in range(1, BINS - 1)]
        x = [F.col("x")[i] for i in range(self.width)]
        row = rows.agg(*[F.percentile_approx(c, shares, ACCURACY) for c in x], *[F.min(c) for c in x]).first()
        return [np.unique([row[self.width + i], *row[i]]) for i in range(self.width)]

    def _reached(self, tree: int, node: int) -> DataFrame:
        top = self.tops[tree]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(top.leaf(matrix(b)) == node))

        return self.table.select("x").mapInArrow(run, "x array<double>")

    def _split(self, batch: list[tuple[int, int]], edges: list[np.ndarray]) -> tuple[list, list]:
        """Split these nodes; the ones to be split next and the ones that no bin can split."""
        seed, width, rule = self.seed, self.width, self.rule
        wanted: dict[int, list[tuple[int, int]]] = {}
        for slot, (tree, node) in enumerate(batch):
            wanted.setdefault(tree, []).append((slot, node))
        tops = {tree: self.tops[tree] for tree in wanted}
        size, cells = len(batch), len(batch) * width * BINS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((3, cells))
            low, high = np.full(size, np.inf), np.full(size, -np.inf)
            for b in batches:
                x, y, u = matrix(b), b.column("y").to_numpy(), b.column("u").to_numpy()
                codes = np.column_stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)])
                for tree, nodes in wanted.items():
                    slot_of = np.full(len(tops[tree].feature), -1)
                    for slot, node in nodes:
                        slot_of[node] = slot
                    slot, w = slot_of[tops[tree].leaf(x)], draws(u, tree, seed)
                    used = np.flatnonzero((slot >= 0) & (w > 0))
                    np.minimum.at(low, slot[used], y[used])
                    np.maximum.at(high, slot[used], y[used])
                    cell = (((slot[used] * width)[:, None] + np.arange(width)) * BINS + codes[used]).ravel()
                    at, of = np.unique(cell, return_inverse=True)
                    for k, v in enumerate((None, w[used], w[used] * y[used])):
                        sums[k, at] += np.bincount(of, None if v is None else np.repeat(v, width), len(at))
            cell = np.flatnonzero(sums[0])
            slot = cell // (width * BINS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array(cell // BINS % width), pa.array(cell % BINS), *map(pa.array, sums[:, cell]),
                 pa.array(low[slot]), pa.array(high[slot])], ["slot", "f", "bin", "n", "w", "s", "low", "high"])

        cell = self.table.select("x", "y", "u").mapInArrow(
            run, "slot bigint, f bigint, bin bigint, n double, w double, s double, low double, high double")
        cell = cell.groupBy("slot", "f", "bin").agg(*[F.sum(c).alias(c) for c in "nws"], F.min("low").alias("low"),
                                                    F.max("high").alias("high"))
        all_bins = Window.partitionBy("slot", "f")
        up_to = all_bins.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        cell = cell.select("slot", "f", "bin", *[F.sum(c).over(up_to).alias(f"l{c}") for c in "nws"],
                           *[F.sum(c).over(all_bins).alias(c) for c in "nws"],
                           F.min("low").over(all_bins).alias("low"), F.max("high").over(all_bins).alias("high"))
        gain = F.expr(f"CASE WHEN ln >= {rule.min_leaf} AND n - ln >= {max(rule.min_leaf, 1)} "
                      "THEN (ls / lw - (s - ls) / (w - lw)) * (ls / lw - (s - ls) / (w - lw)) * lw * (w - lw) / w END")
        best = cell.withColumn("gain", gain).groupBy("slot").agg(
            F.max_by(F.struct("f", "bin", "ln", "lw", "ls"), F.struct("gain", -F.col("f"), -F.col("bin"))).alias("b"),
            F.max("gain").alias("gain"), *[F.max(c).alias(c) for c in ("n", "w", "low", "high")], F.max_by("s", "f").alias("s"))
        more, stuck = [], []
        for r in best.collect():
            tree, node = batch[r["slot"]]
            top = self.tops[tree]
            top.value[node] = r["s"] / r["w"]
            if not r["low"] < r["high"] or not rule.may_split(r["n"], top.depth[node]):
                continue
            if r["gain"] is None:
                stuck.append((tree, node))
                continue
            f, last = r["b"]["f"], r["b"]["bin"]
            left = top.split(node, int(f), float(edges[f][last]))
            for child, rows in ((left, r["b"]["ln"]), (left + 1, r["n"] - r["b"]["ln"])):
                if rows <= self.local:
                    top.part[child] = True
                else:
                    more.append((tree, child))
        return more, stuck

    def _parts(self) -> DataFrame:
        tops, seed, rule = self.tops, self.seed, self.rule
        parts = [np.array(t.part) for t in tops]

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, u = matrix(b), b.column("u").to_numpy()
                for tree, top in enumerate(tops):
                    leaf, w = top.leaf(x), draws(u, tree, seed)
                    used = np.flatnonzero(parts[tree][leaf] & (w > 0))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(used), tree)), pa.array(leaf[used]), _lists(x[used]),
                         b.column("y").take(pa.array(used)), pa.array(w[used])], ["tree", "part", "x", "y", "w"])

        def run(key: tuple, rows: pa.Table) -> pa.Table:
            tree, part = (int(k.as_py()) for k in key)
            w = rows.column("w").to_numpy()
            return _part_rows([(tree, part, grown(matrix(rows), rows.column("y").to_numpy(), w, rule,
                                                  tops[tree].depth[part]))])

        dealt = self.table.select("x", "y", "u").mapInArrow(deal, "tree bigint, part bigint, x array<double>, y double, w bigint")
        return keep_table(dealt.groupBy("tree", "part").applyInArrow(run, _PART), "parts")


def _whole_tree(top: Top, parts: dict[int, Nodes]) -> Nodes:
    """Top and parts in one tree: a part's root takes the place of its leaf, the rest is appended."""
    whole = [np.array(top.feature), np.array(top.threshold, float), np.array(top.left), np.array(top.value, float)]
    pieces, end = [whole], len(top.feature)
    for at, n in parts.items():
        left = np.where(n.feature >= 0, n.left + end - 1, 0)
        whole[0][at], whole[1][at], whole[2][at], whole[3][at] = n.feature[0], n.threshold[0], left[0], n.value[0]
        pieces.append([n.feature[1:], n.threshold[1:], left[1:], n.value[1:]])
        end += len(n.feature) - 1
    return Nodes(*(np.concatenate(c) for c in zip(*pieces, strict=True)))


@dataclass
class FittedForest:
    """The upper nodes of every tree and the table of the parts below. ``transform`` adds ``yhat``."""

    name: str
    feature_names: list[str]
    tops: list[Top]
    parts: DataFrame
    params: dict
    target: str = "y"
    details: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        cut = (self.params["numTrees"], self.params["maxDepth"])
        return self.predicted(df, [cut], "_yhats").withColumn("yhat", F.col("_yhats")[0]).drop("_yhats")

    def predicted(self, df: DataFrame, cuts: list[tuple[int, int | None]], name: str) -> DataFrame:
        """Add an array with the mean of the first ``trees`` trees, cut at ``depth``, for each such pair in ``cuts``.

        A model of few nodes is with every task; a larger one is shuffled to the rows by part (see ``_by_parts``).
        """
        reach_package(df.sparkSession)
        nodes = self.parts.agg(F.coalesce(F.sum(F.size("feature")), F.lit(0))).first()[0] + sum(len(t.feature) for t in self.tops)
        if nodes > MODEL_NODES:
            return self._by_parts(df, cuts, name)
        forest = _Forest(self.tops, self.parts.collect())

        @F.pandas_udf("array<double>")
        def run(*columns: pd.Series) -> pd.Series:
            return pd.Series(list(forest.means(np.column_stack([c.to_numpy(float) for c in columns]), cuts)))

        return df.withColumn(name, run(*[F.col(c).cast("double") for c in self.feature_names]))

    def _by_parts(self, df: DataFrame, cuts: list[tuple[int, int | None]], name: str) -> DataFrame:
        """Rows are stored with a number, dealt by tree and part in groups of bounded size, and summed up again.

        A part that many rows reach is copied to several groups.
        """
        tops, trees = self.tops, max(t for t, _ in cuts)
        depths = _depths(cuts)
        weights = [[(1.0 / n if tree < n else 0.0, depths.index(d)) for n, d in cuts] for tree in range(trees)]
        x = F.array(*[F.col(c).cast("double") for c in self.feature_names])
        rows = keep_table(df.withColumn("_row", F.monotonically_increasing_id()), "predicted")

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for tree in range(trees):
                    yield pa.RecordBatch.from_arrays(
                        [b.column("_row"), pa.array(np.full(b.num_rows, tree)), pa.array(tops[tree].leaf(matrix(b))), b.column("x")],
                        ["_row", "tree", "part", "x"])

        dealt = rows.select("_row", F.coalesce(F.transform(x, lambda v: F.coalesce(v, F.lit(float("nan")))), x).alias("x")).mapInArrow(
            deal, "_row bigint, tree bigint, part bigint, x array<double>")
        sizes = dealt.groupBy("tree", "part").agg(F.ceil(F.count("*") / GROUP_ROWS).alias("groups"))
        sizes = keep_table(sizes, "groups")
        below = keep_table(sizes.join(self.parts, ["tree", "part"], "left")
                           .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))), "salted")
        salted = dealt.join(sizes, ["tree", "part"]).withColumn("salt", F.pmod(F.xxhash64("_row"), "groups")).drop("groups")

        def run(key: tuple, rows: pa.Table, part: pa.Table) -> pa.Table:
            tree, at = int(key[0].as_py()), int(key[1].as_py())
            x = matrix(rows)
            whole = _whole_tree(tops[tree], {at: _nodes(part.to_pylist()[0])} if tops[tree].part[at] else {})
            by_depth = whole.walk(x, depths)
            values = np.column_stack([by_depth[:, d] * share for share, d in weights[tree]])
            return pa.Table.from_arrays([rows.column("_row"), _lists(values)], ["_row", "v"])

        keys = ["tree", "part", "salt"]
        values = salted.groupBy(*keys).cogroup(below.groupBy(*keys)).applyInArrow(run, "_row bigint, v array<double>")
        sums = values.groupBy("_row").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(len(cuts))]).alias(name))
        return rows.join(sums, "_row").drop("_row")

    def evaluate(self, df: DataFrame, by: list[str] | None = None) -> DataFrame:
        return score(self.transform(df), self.target, "yhat", by)

    def save(self, path: str) -> None:
        from .models import write_details

        spark = SparkSession.active()
        self.parts.write.mode("overwrite").parquet(f"{path}/parts")
        tops = spark.createDataFrame([(i, json.dumps(vars(t))) for i, t in enumerate(self.tops)], "tree int, top string")
        tops.write.mode("overwrite").parquet(f"{path}/tops")
        write_details(spark, path, {"kind": "forest", "name": self.name, "feature_names": self.feature_names,
                                    "params": self.params, "target": self.target, "details": self.details})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FittedForest:
        from .models import read_details

        info = read_details(spark, path)
        tops = [Top(**json.loads(r.top)) for r in spark.read.parquet(f"{path}/tops").orderBy("tree").collect()]
        return cls(info["name"], info["feature_names"], tops, spark.read.parquet(f"{path}/parts"), info["params"],
                   info["target"], info["details"])


def _depths(cuts: list[tuple[int, int | None]]) -> list[int | None]:
    """The different depths, ascending, None last."""
    return sorted({d for _, d in cuts}, key=lambda d: float("inf") if d is None else d)


def _nodes(row) -> Nodes:
    return Nodes(np.array(row["feature"]), np.array(row["threshold"], float), np.array(row["left"]), np.array(row["value"], float))


class _Forest:
    """All trees in memory."""

    def __init__(self, tops: list[Top], parts: list):
        found: dict[int, dict[int, Nodes]] = {}
        for r in parts:
            found.setdefault(r["tree"], {})[r["part"]] = _nodes(r)
        self.trees = [_whole_tree(t, found.get(i, {})) for i, t in enumerate(tops)]

    def means(self, x: np.ndarray, cuts: list[tuple[int, int | None]]) -> np.ndarray:
        """Per row and cut the mean of the first trees, cut at a depth."""
        return means(self.trees, x, cuts)


def means(trees: list[Nodes], x: np.ndarray, cuts: list[tuple[int, int | None]]) -> np.ndarray:
    depths = _depths(cuts)
    out, total = np.zeros((len(x), len(cuts))), np.zeros((len(x), len(depths)))
    for i, tree in enumerate(trees[: max(n for n, _ in cuts)]):
        total += tree.walk(x, depths)
        for c, (n, d) in enumerate(cuts):
            if n == i + 1:
                out[:, c] = total[:, depths.index(d)] / n
    return out


def settings_of(params: dict) -> dict:
    """All settings of a forest, defaults filled in; ``n_estimators`` and ``random_state`` are names for two of them."""
    known = {"n_estimators": "numTrees", "random_state": "seed"}
    given = {known.get(k, k): v for k, v in params.items()}
    unknown = set(given) - set(_FOREST)
    if unknown:
        raise TypeError(f"unknown settings {', '.join(sorted(unknown))}")
    return {**_FOREST, **given}


class DeepForest:
    """Estimator. Each tree draws as many rows as there are, with replacement, and looks at all features at every node;
    with ``bootstrap`` False it takes every row once.

    ``maxDepth`` None lets it grow until the targets of a node are equal, or ``minSamplesSplit`` and
    ``minInstancesPerNode`` forbid a split. A tree follows from the seed and its number: fewer trees are the first of
    more, and a bounded depth cuts the same tree.
    """

    def __init__(self, name: str = "Random Forest", **params):
        self.name, self.params = name, settings_of(params)

    @property
    def seed(self) -> int | None:
        return self.params["seed"] if self.params["bootstrap"] else None

    @property
    def rule(self) -> Rule:
        return Rule(self.params["maxDepth"], self.params["minSamplesSplit"], self.params["minInstancesPerNode"])

    def fit(self, df: DataFrame, features: list[str], target: str = "y") -> FittedForest:
        return self.fit_table(training_table(df, features, target, self.params["seed"]), features, target)

    def fit_table(self, table: DataFrame, features: list[str], target: str) -> FittedForest:
        """As ``fit``, on what ``training_table`` made."""
        growth = _Growth(table, len(features), self.params["numTrees"], self.seed, self.rule)
        parts = growth.run()
        return FittedForest(self.name, list(features), growth.tops, parts, self.params, target)

    def errors_here(self, train: tuple[np.ndarray, ...], test: tuple[np.ndarray, ...],
                    cuts: list[tuple[int, int | None]]) -> list[float]:
        """Mean squared errors on ``test`` of the first trees, cut at a depth, for each pair in ``cuts``; ``train`` and
        ``test`` are features, targets and row numbers that are all in this task."""
        trees = grown_here(*train, list(range(self.params["numTrees"])), self.seed, self.rule)
        return ((means(trees, test[0], cuts) - test[1][:, None]) ** 2).mean(axis=0).tolist()
