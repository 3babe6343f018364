"""Parameter search over folds that only ever train on the past."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import mse
from ..operators.chunks import with_place
from ..operators.splits import FOLDS
from ..series import SeriesSpec
from ..session import cut_lineage
from . import forest, models
from .least import FittedLinear, standardised
from .linear import ELASTIC_GRID, RIDGE_GRID, searched
from .moments import group_moments, scatter_of
from .quantile import Boosted, FittedBoosting, LeafBoosting

# The grids searched for trees.
FOREST_GRID = [{"numTrees": t, "maxDepth": d, "minInstancesPerNode": m}
               for t in (50, 100, 200) for d in (10, 20, 30) for m in (1, 2, 4)]
DEEP_GRID = [{"numTrees": t, "maxDepth": d, "minSamplesSplit": s, "minInstancesPerNode": m}
             for t in (50, 100, 200) for d in (10, 20, None) for s in (2, 5, 10) for m in (1, 2, 4)]
BOOSTING_GRID = [{"maxIter": i, "stepSize": s, "maxDepth": d}
                 for i in (100, 200) for s in (0.05, 0.1, 0.2) for d in (3, 5, 7)]
LEAF_GRID = [{"num_leaves": n, "learning_rate": r, "feature_fraction": f, "n_estimators": i}
             for n in (31, 50, 100) for r in (0.05, 0.1, 0.2) for f in (0.8, 0.9, 1.0) for i in (100, 200, 300)]


def folded(df: DataFrame, spec: SeriesSpec, folds: int = FOLDS) -> DataFrame:
    """Add ``_block``: 0 for rows always trained on, k for the rows tested in fold k.

    Fold k trains on the blocks below k. One stored table serves every fold.
    """
    placed = with_place(df, spec, "_p", "_n")
    size = F.call_function("div", F.col("_n"), F.lit(folds + 1).cast("long"))
    first = F.col("_n") - size * folds
    block = F.when(F.col("_p") < first, 0).otherwise(
        F.call_function("div", F.col("_p") - first, F.greatest(size, F.lit(1).cast("long"))) + 1)
    return placed.withColumn("_block", block).drop("_p", "_n")


class GridSearch:
    """Fit every setting on every fold, keep the one with the least mean squared error,
    and fit it once more on all rows."""

    def __init__(self, name: str, make: Callable[..., object], grid: list[dict], spec: SeriesSpec,
                 folds: int = FOLDS, parallelism: int = 4):
        self.name, self.make, self.grid, self.spec = name, make, grid, spec
        self.folds, self.parallelism = folds, parallelism
        self.results: list[dict] = []
        self.best_params: dict | None = None

    def fit(self, df: DataFrame, features: list[str], target: str | None = None) -> models.FittedModel:
        target = target or self.spec.target
        columns = dict.fromkeys([*self.spec.keys, *self.spec.order, target, *features])
        base = cut_lineage(folded(df.select(*columns), self.spec, self.folds))

        def one(task: tuple[int, int]) -> float:
            i, k = task
            model = self.make(**self.grid[i]).fit(base.where(F.col("_block") < k), features, target)
            tested = model.transform(base.where(F.col("_block") == k))
            return tested.agg(mse(target, "yhat")).first()[0]

        tasks = [(i, k) for i in range(len(self.grid)) for k in range(1, self.folds + 1)]
        with ThreadPoolExecutor(self.parallelism) as pool:
            errors = dict(zip(tasks, pool.map(one, tasks)))
        self.results = [
            {"params": p, "mean_mse": sum(errors[i, k] for k in range(1, self.folds + 1)) / self.folds}
            for i, p in enumerate(self.grid)]
        best = min(self.results, key=lambda r: r["mean_mse"])
        self.best_params = best["params"]
        model = self.make(**best["params"]).fit(base, features, target)
        model.name = self.name
        model.details = {"best_params": best["params"], "results": self.results}
        return model


class LinearSearch:
    """The same search for penalised linear models, in two passes however many settings and folds.

    One pass cuts the rows into time blocks, one takes the blocks' moments; every fit and every error follows from
    these on the driver, which holds ``folds + 1`` matrices.
    """

    def __init__(self, name: str, grid: list[dict], spec: SeriesSpec, folds: int = FOLDS):
        self.name, self.grid, self.spec, self.folds = name, grid, spec, folds
        self.results: list[dict] = []
        self.best_params: dict | None = None

    def fit(self, df: DataFrame, features: list[str], target: str | None = None) -> FittedLinear:
        target = target or self.spec.target
        columns = dict.fromkeys([*self.spec.keys, *self.spec.order, target, *features])
        rows = folded(df.select(*columns), self.spec, self.folds).where(F.col(target).isNotNull())
        width = len(features) + 1
        blocks = {r["_block"]: scatter_of(r, width)
                  for r in group_moments(rows, [*features, target], ["_block"]).collect()}
        if not blocks:
            raise ValueError("no row with a target to fit on")
        for found in blocks.values():
            standardised(found)  # for its checks
        errors, best, weights, intercept = searched(blocks, self.grid, self.folds)
        self.results = [{"params": p, "mean_mse": e} for p, e in zip(self.grid, errors, strict=True)]
        self.best_params = self.grid[best]
        return FittedLinear(self.name, list(features), weights.tolist(), intercept, target,
                            {"best_params": self.best_params, "results": self.results})


class TreeSearch:
    """The same search for trees, where settings that a longer fit contains are read off that fit.

    A kind is an estimator to fit, the settings read off it and where. A table that fits into a task is searched in
    one job, a task per fold and kind.
    """

    def __init__(self, name: str, grid: list[dict], spec: SeriesSpec, folds: int = FOLDS):
        self.name, self.grid, self.spec, self.folds = name, grid, spec, folds
        self.results: list[dict] = []
        self.best_params: dict | None = None

    def fit(self, df: DataFrame, features: list[str], target: str | None = None):
        target = target or self.spec.target
        columns = dict.fromkeys([*self.spec.keys, *self.spec.order, target, *features])
        rows = folded(df.select(*columns), self.spec, self.folds)
        kinds = self._kinds()
        table = forest.training_table(rows, features, target, 42, ["_block"])
        sizes = {r["_block"]: r["count"] for r in table.groupBy("_block").count().collect()}
        if any(b not in sizes for b in range(self.folds + 1)):
            raise ValueError(f"too few rows for {self.folds} folds")
        small = sum(sizes.values()) * len(features) <= forest.LOCAL_CELLS
        errors = self._small_errors(table, kinds) if small else self._large_errors(table, features, kinds)
        mean = {i: sum(errors[g, k][c] for k in range(1, self.folds + 1)) / self.folds
                for g, (_, members, _) in enumerate(kinds) for c, i in enumerate(members)}
        self.results = [{"params": p, "mean_mse": mean[i]} for i, p in enumerate(self.grid)]
        self.best_params = self.grid[min(range(len(self.grid)), key=mean.__getitem__)]
        model = self._best(table, df, features, target)
        model.name, model.details = self.name, {"best_params": self.best_params, "results": self.results}
        return model

    def _small_errors(self, table: DataFrame, kinds: list) -> dict[tuple[int, int], list[float]]:
        """Mean squared errors by kind and fold, one per setting."""
        def run(rows: pa.Table) -> pa.Table:
            g, k = (rows.column(c)[0].as_py() for c in ("kind", "fold"))
            estimator, _, cuts = kinds[g]
            early = np.asarray(rows.column("_block")) < k
            train, test = ((forest.matrix(part), part.column("y").to_numpy(), part.column("u").to_numpy())
                           for part in (rows.filter(pa.array(early)), rows.filter(pa.array(~early))))
            found = estimator.errors_here(train, test, cuts)
            return pa.table([pa.array([g], pa.int32()), pa.array([k], pa.int32()), pa.array([found])],
                            names=["kind", "fold", "errors"])

        tasks = F.array(*[F.struct(F.lit(g).alias("kind"), F.lit(k).alias("fold"))
                          for g in range(len(kinds)) for k in range(1, self.folds + 1)])
        dealt = table.withColumn("_t", F.explode(tasks)).select("x", "y", "u", F.col("_block").cast("int").alias("_block"), "_t.*")
        dealt = dealt.where("_block <= fold").repartition(len(kinds) * self.folds, "kind", "fold")
        found = dealt.groupBy("kind", "fold").applyInArrow(run, "kind int, fold int, errors array<double>").collect()
        return {(r["kind"], r["fold"]): r["errors"] for r in found}

    def _large_errors(self, table: DataFrame, features: list[str], kinds: list) -> dict[tuple[int, int], list[float]]:
        """The same with fits over the cluster, one after the other."""
        errors = {}
        wide = table.select("_block", "x", "u", F.col("y").alias("_y"), *[F.col("x")[i].alias(c) for i, c in enumerate(features)])
        for g, (estimator, _, cuts) in enumerate(kinds):
            for k in range(1, self.folds + 1):
                tested = self._tested(estimator, table.where(F.col("_block") < k), wide.where(F.col("_block") < k),
                                      wide.where(F.col("_block") == k), features, cuts)
                away = [F.avg((F.col("_p")[c] - F.col("_y")) ** 2) for c in range(len(cuts))]
                errors[g, k] = list(tested.agg(*away).first())
        return errors


class ForestSearch(TreeSearch):
    """A bounded depth cuts the same trees, and fewer trees are the first of more, so the 81 settings of ``DEEP_GRID``
    need nine forests a fold."""

    def _kinds(self) -> list[tuple[forest.DeepForest, list[int], list[tuple[int, int | None]]]]:
        kinds: dict[tuple, list[int]] = {}
        full = [forest.settings_of(p) for p in self.grid]
        for i, p in enumerate(full):
            kinds.setdefault((p["seed"], p["bootstrap"], p["minSamplesSplit"], p["minInstancesPerNode"]), []).append(i)
        made = []
        for members in kinds.values():
            cuts = [(full[i]["numTrees"], full[i]["maxDepth"]) for i in members]
            depths = [d for _, d in cuts]
            grown = {**full[members[0]], "numTrees": max(n for n, _ in cuts),
                     "maxDepth": None if None in depths else max(depths)}
            made.append((forest.DeepForest(self.name, **grown), members, cuts))
        return made

    def _best(self, table: DataFrame, df: DataFrame, features: list[str], target: str) -> forest.FittedForest:
        return forest.DeepForest(self.name, **self.best_params).fit_table(table, features, target)

    def _tested(self, estimator, train: DataFrame, _: DataFrame, test: DataFrame, features: list[str], cuts: list) -> DataFrame:
        return estimator.fit_table(train, features, "_y").predicted(test, cuts, "_p")


class BoostingSearch(TreeSearch):
    """Fewer rounds are the first of more, so the 18 settings of ``BOOSTING_GRID`` need nine fits a fold, and the 81 of
    ``LEAF_GRID`` 27."""

    @staticmethod
    def _settings(params: dict) -> dict:
        """Settings in Spark's names grow every node to a depth; others are those of ``LeafBoosting``."""
        names = {"maxIter": "n_estimators", "stepSize": "learning_rate", "maxDepth": "max_depth"}
        if not names.keys() & params.keys():
            return dict(params)
        whole = {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 6, "num_leaves": None, "feature_fraction": 1.0,
                 "bagging_fraction": 1.0, "min_child_samples": 1}
        return {**whole, **{names.get(k, k): v for k, v in params.items()}}

    def _kinds(self) -> list[tuple[LeafBoosting, list[int], list[int]]]:
        kinds: dict[tuple, tuple[dict, list[int], list[int]]] = {}
        for i, p in enumerate(map(self._settings, self.grid)):
            rounds = p.pop("n_estimators", 100)
            _, members, cuts = kinds.setdefault(tuple(sorted(p.items(), key=str)), (p, [], []))
            members.append(i)
            cuts.append(rounds)
        return [(LeafBoosting(n_estimators=max(cuts), **p), members, cuts) for p, members, cuts in kinds.values()]

    def _best(self, table: DataFrame, df: DataFrame, features: list[str], target: str) -> FittedBoosting:
        return LeafBoosting(**self._settings(self.best_params)).fit(df, features, target)

    def _tested(self, estimator, _: DataFrame, train: DataFrame, test: DataFrame, features: list[str], cuts: list) -> DataFrame:
        member = (fitted := estimator.fit(train, features, "_y")).member
        stages = [Boosted(member.start, member.rate, member.trees[:n]) for n in cuts]
        return test.withColumn("_p", F.array(*[s.prediction(features, fitted.depth) for s in stages]))


def enhanced_linear(spec: SeriesSpec, regularization: str = "ridge", **options) -> LinearSearch:
    if regularization == "ridge":
        return LinearSearch("Enhanced Ridge", RIDGE_GRID, spec, **options)
    if regularization == "elastic":
        return LinearSearch("Enhanced Elastic", ELASTIC_GRID, spec, **options)
    raise ValueError("regularization must be ridge or elastic")


def enhanced_random_forest(spec: SeriesSpec, grid: list[dict] | None = None, **options) -> ForestSearch:
    return ForestSearch("Enhanced Random Forest", grid or DEEP_GRID, spec, **options)


def enhanced_boosting(spec: SeriesSpec, grid: list[dict] | None = None, **options) -> BoostingSearch:
    return BoostingSearch("Enhanced Gradient Boosting", grid or BOOSTING_GRID, spec, **options)
