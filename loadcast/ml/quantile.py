"""Boosted trees for quantiles and for the mean, and what fitted ones can do.

A fitted model is one expression of constant size over the feature columns, so predicting stays in the JVM.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import score, score_quantiles
from .histograms import Boosting, Grower, Growth, Loss, boosted_here, codes_of, edges_here, leaf_of
from .models import NAMES, read_details, write_details

# Default quantiles and boosting settings.
QUANTILES = [0.1, 0.5, 0.9]
ROUNDS, RATE, DEPTH, SEED = 100, 0.1, 6, 42


def quantile_name(q: float) -> str:
    return f"q{round(q * 100)}"


@dataclass
class Boosted:
    """One quantile: a start value, then trees as rows of nodes."""

    start: float
    rate: float
    trees: list[list[list[float]]] = field(default_factory=list)

    def prediction(self, features: list[str], depth: int) -> Column:
        """One expression of constant size: all trees lie in one array and are walked by the same few steps."""
        table, roots = [], []
        for tree in self.trees:
            base = len(table)
            roots.append(base)
            table += [{"f": int(f), "t": t, "l": int(low) + base, "r": int(high) + base, "v": v}
                      for f, t, low, high, v in tree]
        nodes = F.from_json(F.lit(json.dumps(table)), "array<struct<f:int,t:double,l:int,r:int,v:double>>")
        start = F.from_json(F.lit(json.dumps(roots)), "array<int>")
        x = F.array(*[F.col(c).cast("double") for c in features])

        def walked(bound: Column, root: Column) -> Column:
            def step(place: Column, _: Column) -> Column:
                node = bound["nodes"][place]
                return F.when(node["f"] < 0, place).when(
                    F.get(bound["x"], node["f"]) <= node["t"], node["l"]).otherwise(node["r"])

            return F.aggregate(F.sequence(F.lit(1), F.lit(max(depth, 1))), root, step)

        # a lambda's variable holds the row's features and the nodes, so that they are made once per row
        bound = F.array(F.struct(nodes.alias("nodes"), x.alias("x")))
        total = F.transform(bound, lambda b: F.aggregate(
            start, F.lit(self.start), lambda sum_, root: sum_ + self.rate * b["nodes"][walked(b, root)]["v"]))
        return total[0]


@dataclass
class FittedQuantileModel:
    """``transform`` adds one column per quantile, such as q10, q50 and q90."""

    name: str
    feature_names: list[str]
    target: str
    members: dict[float, Boosted]
    params: dict
    sort_crossing: bool = False

    @property
    def quantiles(self) -> list[float]:
        return list(self.members)

    def transform(self, df: DataFrame) -> DataFrame:
        depth = self.params["max_depth"]
        out = df.withColumns({quantile_name(q): member.prediction(self.feature_names, depth)
                              for q, member in self.members.items()})
        if self.sort_crossing:
            names = [quantile_name(q) for q in sorted(self.members)]
            out = out.withColumn("_sorted", F.array_sort(F.array(*names)))
            out = out.withColumns({n: F.col("_sorted")[i] for i, n in enumerate(names)}).drop("_sorted")
        return out

    def predict_median(self, df: DataFrame) -> DataFrame:
        if 0.5 not in self.members:
            raise ValueError("the median is not among the fitted quantiles")
        return self.transform(df).withColumn("yhat", F.col("q50"))

    def evaluate(self, df: DataFrame, by: list[str] | None = None) -> DataFrame:
        """Point metrics of the median."""
        return score(self.predict_median(df), self.target, "yhat", by)

    def evaluate_quantiles(self, df: DataFrame, by: list[str] | None = None) -> DataFrame:
        names = [quantile_name(q) for q in self.members]
        return score_quantiles(self.transform(df), self.target, names, by)

    def save(self, path: str) -> None:
        write_details(SparkSession.active(), path, {
            "kind": "quantile", "name": self.name, "feature_names": self.feature_names,
            "target": self.target, "params": self.params, "sort_crossing": self.sort_crossing,
            "members": [{"quantile": q, "start": m.start, "rate": m.rate, "trees": m.trees}
                        for q, m in self.members.items()]})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FittedQuantileModel:
        info = read_details(spark, path)
        members = {e["quantile"]: Boosted(e["start"], e["rate"], e["trees"]) for e in info["members"]}
        return cls(info["name"], info["feature_names"], info["target"], members, info["params"],
                   info["sort_crossing"])


class QuantileBoosting:
    """Estimator for several quantiles at once; they share every pass over the data."""

    def __init__(self, quantiles: list[float] | None = None, n_estimators: int = ROUNDS,
                 learning_rate: float = RATE, max_depth: int = DEPTH, random_state: int = SEED,
                 min_instances: int = 1, sort_crossing: bool = False):
        self.name = NAMES["gradient_boosting_quantile"]
        self.quantiles = quantiles or QUANTILES
        self.rounds, self.rate, self.depth = n_estimators, learning_rate, max_depth
        self.seed, self.min_instances, self.sort_crossing = random_state, min_instances, sort_crossing

    def fit(self, df: DataFrame, features: list[str], target: str = "y") -> FittedQuantileModel:
        """Each round's trees follow the sign of the residuals; each leaf becomes the wanted quantile of those in it."""
        found = Boosting(df, features, target, [Loss(q) for q in self.quantiles], self.rate,
                         Growth(max_depth=self.depth, min_rows=self.min_instances), self.seed).run(self.rounds)
        members = {q: Boosted(found.start[i], self.rate, [t.rows(found.edges) for t in found.trees[i]])
                   for i, q in enumerate(self.quantiles)}
        params = {"n_estimators": self.rounds, "learning_rate": self.rate, "max_depth": self.depth,
                  "random_state": self.seed}
        return FittedQuantileModel(self.name, list(features), target, members, params, self.sort_crossing)


@dataclass
class FittedBoosting:
    """Boosted trees for the mean. ``transform`` adds ``yhat``."""

    name: str
    feature_names: list[str]
    member: Boosted
    depth: int
    target: str = "y"
    details: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("yhat", self.member.prediction(self.feature_names, self.depth))

    def evaluate(self, df: DataFrame, by: list[str] | None = None) -> DataFrame:
        return score(self.transform(df), self.target, "yhat", by)

    def save(self, path: str) -> None:
        write_details(SparkSession.active(), path, {
            "kind": "boosting", "name": self.name, "feature_names": self.feature_names, "target": self.target,
            "depth": self.depth, "details": self.details, "start": self.member.start, "rate": self.member.rate,
            "trees": self.member.trees})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FittedBoosting:
        info = read_details(spark, path)
        return cls(info["name"], info["feature_names"], Boosted(info["start"], info["rate"], info["trees"]),
                   info["depth"], info["target"], info["details"])


class LeafBoosting:
    """Trees grown leaf by leaf, best first, for the squared error, on samples of features and rows.

    Each tree sees ``feature_fraction`` of the features; ``bagging_fraction`` of the rows are drawn anew every
    ``bagging_freq`` rounds. A leaf keeps ``min_child_samples`` rows. ``num_leaves`` None grows every node to
    ``max_depth``.
    """

    def __init__(self, n_estimators: int = 100, learning_rate: float = 0.05, num_leaves: int | None = 31,
                 feature_fraction: float = 0.9, bagging_fraction: float = 0.8, bagging_freq: int = 5,
                 min_child_samples: int = 20, random_state: int = 42, name: str = NAMES["lightgbm"], max_depth: int = 63):
        self.name, self.rounds, self.rate, self.leaves = name, n_estimators, learning_rate, num_leaves
        self.features, self.rows, self.every = feature_fraction, bagging_fraction, bagging_freq
        self.least, self.seed, self.depth = min_child_samples, random_state, max_depth

    @property
    def growth(self) -> Growth:
        return Growth(self.depth, self.leaves, self.least)

    def fit(self, df: DataFrame, features: list[str], target: str = "y") -> FittedBoosting:
        found = Boosting(df, features, target, [Loss()], self.rate, self.growth,
                         self.seed, self.features, self.rows, self.every).run(self.rounds)
        trees = found.trees[0]
        depth = max((max(t.depth) for t in trees), default=0)
        details = {"n_estimators": self.rounds, "learning_rate": self.rate, "num_leaves": self.leaves}
        return FittedBoosting(self.name, list(features), Boosted(found.start[0], self.rate, [t.rows(found.edges) for t in trees]),
                              depth, target, details)

    def errors_here(self, train: tuple[np.ndarray, ...], test: tuple[np.ndarray, ...], rounds: list[int]) -> list[float]:
        """Mean squared errors on ``test`` after each number of ``rounds``; both are features, targets and row numbers
        that are all in this task."""
        x, y, u = train
        edges = edges_here(x)
        grower = Grower([Loss()], self.growth, x.shape[1], self.features, np.random.default_rng(self.seed))
        start = float(y.mean())
        trees = boosted_here(grower, codes_of(x, edges), y, np.full((len(y), 1), start), u, max(rounds), self.rate,
                             self.seed, self.rows, self.every)[0]
        codes, f, found = codes_of(test[0], edges), np.full(len(test[0]), start), {}
        for r, tree in enumerate(trees, 1):
            arrays = tree.arrays()
            f += self.rate * arrays[4][leaf_of(codes, arrays)]
            if r in rounds:
                found[r] = float(((f - test[1]) ** 2).mean())
        return [found[r] for r in rounds]
