"""Boosted trees on binned features, grown from histograms.

Features are cut into bins once, one byte each. A pass over the rows then sums, for all outputs at once, the pull of
the loss in every node, feature and bin; the driver picks splits from these sums, which are as many as nodes, features
and bins, whatever the rows. Only the smaller child of a split is counted: its sibling is the parent's rest.
Rows keep the predictions of a stored table; the few trees since then are walked again in each pass, so a lost
executor costs a re-read, and no plan grows with the rounds.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep_table, reach_package

#: Bins of a feature, and accuracy of the quantiles between them.
BINS, ACCURACY = 256, 10_000
#: Rows of a partition of the binned table; rounds after which predictions are stored.
ROWS, STORE_EVERY = 50_000, 10


@dataclass
class Tree:
    """Nodes as parallel lists; a leaf has feature -1. ``bin`` is the last bin that goes left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, last: int) -> tuple[int, int]:
        made = []
        for _ in range(2):
            made.append(len(self.feature))
            self.feature.append(-1)
            self.bin.append(0)
            self.left.append(made[-1])
            self.right.append(made[-1])
            self.value.append(0.0)
            self.depth.append(self.depth[node] + 1)
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, last, *made
        return made[0], made[1]

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(x) for x in (self.feature, self.bin, self.left, self.right, self.value))

    def rows(self, edges: list[np.ndarray]) -> list[list[float]]:
        """Rows feature, threshold, left, right, value."""
        return [[f, float(edges[f][b]) if f >= 0 else 0.0, low, high, v]
                for f, b, low, high, v in zip(self.feature, self.bin, self.left, self.right, self.value, strict=True)]


def leaf_of(codes: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    """The leaf of each row."""
    feature, last, left, right, _ = tree
    node = np.zeros(len(codes), np.int64)
    going = np.arange(len(codes))
    while len(going):
        at = node[going]
        going, at = going[feature[at] >= 0], at[feature[at] >= 0]
        node[going] = np.where(codes[going, feature[at]] <= last[at], left[at], right[at])
    return node


@dataclass
class Loss:
    """``pull`` is the direction in which a row draws its prediction; ``quantile`` is None for the squared error."""

    quantile: float | None = None

    def pull(self, y: np.ndarray, f: np.ndarray) -> np.ndarray:
        return y - f if self.quantile is None else np.where(y > f, self.quantile, self.quantile - 1)


@dataclass
class Growth:
    """How a tree grows: to a depth, to a number of leaves chosen best first, or both."""

    max_depth: int = 63
    max_leaves: int | None = None
    min_rows: int = 1


def bin_edges(df: DataFrame, columns: list[str], features: list[str]) -> list[np.ndarray]:
    """Ascending upper ends of all bins but the last, per feature: every value if they are few, else quantiles.

    A null feature is an error.
    """
    shares = [i / BINS for i in range(1, BINS)]
    columns = [F.col(c) for c in columns]
    p = len(features)
    row = df.agg(F.count("*"), *[F.count(c) for c in columns], *[F.approx_count_distinct(c) for c in columns],
                 *[F.percentile_approx(c, shares, ACCURACY) for c in columns]).first()
    if not row[0]:
        raise ValueError("no row with a target to fit on")
    missing = [c for i, c in enumerate(features) if row[1 + i] < row[0]]
    if missing:
        raise ValueError(f"null values in {', '.join(missing)}")
    edges = [sorted(set(row[1 + 2 * p + i])) for i in range(p)]
    few = [i for i in range(p) if row[1 + p + i] <= BINS // 2]
    if few:
        values = df.agg(*[F.collect_set(columns[i]) for i in few]).first()  # about BINS / 2 values each
        for i, found in zip(few, values, strict=True):
            if len(found) <= BINS:
                edges[i] = sorted(found)[:-1]
    return [np.array(e, float) for e in edges]


class Counter:
    """Sums of pulls and counts of rows by wanted node, feature and bin, for every output."""

    def __init__(self, losses: list[Loss], width: int, trees: list[Tree], wanted: list[list[int]]):
        self.losses, self.width, self.trees = losses, width, [t.arrays() for t in trees]
        self.slots = []
        for tree, nodes in zip(trees, wanted, strict=True):
            slot = np.full(len(tree.feature), -1)
            slot[nodes] = np.arange(len(nodes))
            self.slots.append(slot)
        self.sizes = [len(nodes) * width * BINS for nodes in wanted]
        self.starts = np.cumsum([0, *self.sizes])
        self.total = np.zeros((2, self.starts[-1]))

    def add(self, codes: np.ndarray, y: np.ndarray, f: np.ndarray, in_bag: np.ndarray) -> None:
        for o, loss in enumerate(self.losses):
            if not self.sizes[o]:
                continue
            slot = self.slots[o][leaf_of(codes, self.trees[o])]
            used = np.flatnonzero((slot >= 0) & in_bag)
            cell = (((slot[used] * self.width)[:, None] + np.arange(self.width)) * BINS + codes[used]).ravel()
            pull = np.repeat(loss.pull(y[used], f[used, o]), self.width)
            part = self.total[:, self.starts[o] : self.starts[o + 1]]
            part[0] += np.bincount(cell, pull, self.sizes[o])
            part[1] += np.bincount(cell, None, self.sizes[o])

    def histograms(self) -> list[np.ndarray]:
        """Per output an array (sum or count, node, feature, bin)."""
        return [self.total[:, a:b].reshape(2, -1, self.width, BINS) for a, b in zip(self.starts[:-1], self.starts[1:], strict=True)]


def drawn(u: np.ndarray, bag: int, seed: int, share: float) -> np.ndarray:
    """Which rows, known by a random number each, are in a bag."""
    salt = np.uint64((bag * 0x9E3779B97F4A7C15 + seed) % (1 << 64))
    mixed = (u.view(np.uint64) ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (mixed >> np.uint64(32)).astype(np.int64) < int(share * (1 << 32))


@dataclass
class Grower:
    """Grows the trees of a round from histograms, wherever these are counted."""

    losses: list[Loss]
    growth: Growth
    width: int
    feature_share: float
    random: np.random.Generator

    def _best_split(self, hist: np.ndarray, allowed: np.ndarray) -> tuple[float, int, int, float, float]:
        """Gain, feature, last bin, sum and rows of the left side of a node's best split; gain 0 if there is none."""
        sums, counts = hist[0].cumsum(axis=1), hist[1].cumsum(axis=1)
        s, n = sums[0, -1], counts[0, -1]
        other = n - counts
        fine = (counts >= self.growth.min_rows) & (other >= self.growth.min_rows) & (counts > 0) & (other > 0) & allowed[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fine, sums**2 / counts + (s - sums) ** 2 / other - s * s / max(n, 1), 0.0)
        best = int(gain.argmax())
        f, b = divmod(best, BINS)
        least = 1e-12 * (abs(s) + n)  # beyond rounding
        return (float(gain[f, b]) if gain[f, b] > least else 0.0), f, b, float(sums[f, b]), float(counts[f, b])

    def grown(self, histograms: Callable) -> list[Tree]:
        """One tree per output; ``histograms(trees, nodes)`` counts the given nodes of each tree.

        Splits are worked out for all nodes that a best-first choice reaches, a level at a time; the choice is made
        again when more are known, until it reaches none that is not. What it takes then is what a choice of one
        split after the other takes.
        """
        keep = max(1, round(self.feature_share * self.width))
        allowed = np.zeros(self.width, bool)
        allowed[self.random.permutation(self.width)[:keep]] = True
        growth = self.growth
        candidates = [Tree() for _ in self.losses]
        hists: list[dict[int, np.ndarray]] = [{} for _ in self.losses]
        splits: list[dict[int, tuple]] = [{} for _ in self.losses]
        parent: list[dict[int, tuple[int, int]]] = [{} for _ in self.losses]  # of a counted node: parent, sibling
        totals: list[dict[int, tuple[float, float]]] = [{} for _ in self.losses]  # sum and rows of a node
        asked: list[list[int]] = [[0] for _ in self.losses]
        while any(asked):
            found = histograms(candidates, asked)
            for o, nodes in enumerate(asked):
                for k, node in enumerate(nodes):
                    fresh = {node: found[o][:, k]}
                    if node in parent[o]:
                        above, sibling = parent[o][node]
                        fresh[sibling] = hists[o].pop(above) - found[o][:, k]
                    else:
                        totals[o][node] = tuple(found[o][:, k, 0].sum(axis=1))
                    for some, hist in fresh.items():
                        hists[o][some], splits[o][some] = hist, self._best_split(hist, allowed)
            asked = []
            for o, tree in enumerate(candidates):
                more = []
                for node in self._chosen(tree, splits[o])[0]:
                    if tree.feature[node] < 0:
                        _, f, b, s_left, n_left = splits[o][node]
                        left, right = tree.split(node, f, b)
                        s, n = totals[o][node]
                        totals[o][left], totals[o][right] = (s_left, n_left), (s - s_left, n - n_left)
                        if tree.depth[left] < growth.max_depth:
                            small, large = (left, right) if 2 * n_left <= n else (right, left)
                            parent[o][small] = (node, large)
                            more.append(small)
                asked.append(more)
        return [self._cut(tree, splits[o], totals[o]) for o, tree in enumerate(candidates)]

    def _chosen(self, tree: Tree, splits: dict[int, tuple]) -> tuple[list[int], list[int]]:
        """Nodes split by a best-first choice among the known splits, and the leaves that leaves."""
        leaves, taken = [0], []
        while self.growth.max_leaves is None or len(leaves) < self.growth.max_leaves:
            open_ = [n for n in leaves if n in splits and splits[n][0] > 0 and tree.depth[n] < self.growth.max_depth]
            if not open_:
                break
            node = max(open_, key=lambda n: (splits[n][0], -n))
            taken.append(node)
            leaves.remove(node)
            if tree.feature[node] >= 0:
                leaves += [tree.left[node], tree.right[node]]
        return taken, leaves

    def _cut(self, tree: Tree, splits: dict[int, tuple], totals: dict[int, tuple[float, float]]) -> Tree:
        """The chosen part of the candidates, leaves valued by their mean pull."""
        taken = set(self._chosen(tree, splits)[0])
        out, place = Tree(), [(0, 0)]
        for node, at in place:
            if node in taken:
                left, right = out.split(at, tree.feature[node], tree.bin[node])
                place += [(tree.left[node], left), (tree.right[node], right)]
            else:
                s, n = totals[node]
                out.value[at] = float(s / n) if n else 0.0
        return out


def edges_here(x: np.ndarray) -> list[np.ndarray]:
    """As ``bin_edges``, from rows that are all in this task."""
    shares = np.arange(1, BINS) / BINS
    return [v[:-1] if len(v := np.unique(c)) <= BINS else np.unique(np.quantile(c, shares, method="inverted_cdf")) for c in x.T]


def codes_of(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)]).astype(np.uint8)


def boosted_here(grower: Grower, codes: np.ndarray, y: np.ndarray, f: np.ndarray, u: np.ndarray, rounds: int, rate: float,
                 seed: int, row_share: float, row_rounds: int) -> list[list[Tree]]:
    """The trees of each output from rows that are all in this task; ``f`` (rows, outputs) is moved along."""
    made: list[list[Tree]] = [[] for _ in grower.losses]
    for r in range(rounds):
        in_bag = drawn(u, r // row_rounds, seed, row_share)

        def here(trees: list[Tree], wanted: list[list[int]], in_bag: np.ndarray = in_bag) -> list[np.ndarray]:
            counter = Counter(grower.losses, codes.shape[1], trees, wanted)
            counter.add(codes, y, f, in_bag)
            return counter.histograms()

        for o, tree in enumerate(grower.grown(here)):
            leaf, q = leaf_of(codes, tree.arrays()), grower.losses[o].quantile
            if q is not None:
                order = np.lexsort((rest := (y - f[:, o])[in_bag], leaf[in_bag]))
                at, start, n = np.unique(leaf[in_bag][order], return_index=True, return_counts=True)
                for node, x in zip(at, rest[order][start + np.maximum(np.ceil(q * n).astype(int) - 1, 0)], strict=True):
                    tree.value[node] = float(x)
            f[:, o] += rate * np.array(tree.value)[leaf]
            made[o].append(tree)
    return made


class Boosting:
    """One fit: the binned rows, and rounds of one tree per output."""

    def __init__(self, df: DataFrame, features: list[str], target: str, losses: list[Loss], rate: float, growth: Growth,
                 seed: int = 42, feature_share: float = 1.0, row_share: float = 1.0, row_rounds: int = 1):
        reach_package(df.sparkSession)
        self.losses, self.rate, self.seed = losses, rate, seed
        self.row_share, self.row_rounds = row_share, row_rounds
        rows = df.where(F.col(target).isNotNull()).select(
            *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)], F.col(target).cast("double").alias("_y"))
        self.edges = bin_edges(rows, [f"_x{i}" for i in range(len(features))], features)
        self.width = len(features)
        self.grower = Grower(losses, growth, self.width, feature_share, np.random.default_rng(seed))
        self.start = self._starts(rows)
        self.trees: list[list[Tree]] = [[] for _ in losses]
        self.stored = 0  # rounds whose trees are in the stored predictions
        self.table = self._binned(rows)

    def _starts(self, rows: DataFrame) -> list[float]:
        quantiles = [x.quantile for x in self.losses]
        asked = [F.avg("_y") if q is None else F.percentile_approx("_y", q, ACCURACY) for q in quantiles]
        return [float(x) for x in rows.agg(*asked).first()]

    def _binned(self, rows: DataFrame) -> DataFrame:
        edges, start, width = self.edges, self.start, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                codes = np.column_stack([np.searchsorted(edges[i], b.column(i).to_numpy(zero_copy_only=False), side="left")
                                         for i in range(width)]).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c.tobytes() for c in codes], pa.binary()), b.column(width), pa.array([start] * b.num_rows),
                     b.column(width + 1)], ["b", "y", "f", "u"])

        made = rows.withColumn("_u", F.xxhash64(F.rand(self.seed))).mapInArrow(run, "b binary, y double, f array<double>, u bigint")
        table = keep_table(made, "binned")
        self.parts = max(1, -(-table.count() // ROWS))
        return table.coalesce(self.parts).persist()

    def _known(self) -> list[list[tuple]]:
        """The trees that the stored predictions lack, per output."""
        return [[t.arrays() for t in trees[self.stored :]] for trees in self.trees]

    def _pass(self, make: Callable, schema: str) -> DataFrame:
        """``make(codes, y, predictions, in_bag)`` is called for each batch; what it returns at the end are the rows."""
        known, rate, width, outputs = self._known(), self.rate, self.width, len(self.losses)
        bag, seed, share = len(self.trees[0]) // self.row_rounds, self.seed, self.row_share

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            add, finish = make()
            for b in batches:
                n = b.num_rows
                codes = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(n, width)
                f = b.column(2).flatten().to_numpy().reshape(n, outputs).copy()
                for o, trees in enumerate(known):
                    for tree in trees:
                        f[:, o] += rate * tree[4][leaf_of(codes, tree)]
                in_bag = drawn(b.column(3).to_numpy(), bag, seed, share)
                out = add(codes, b.column(1).to_numpy(), f, in_bag, b)
                if out is not None:
                    yield out
            out = finish()
            if out is not None:
                yield out

        return self.table.mapInArrow(run, schema)

    def _histograms(self, trees: list[Tree], wanted: list[list[int]]) -> list[np.ndarray]:
        """The histograms of all rows: counted in every partition, summed by cell."""
        losses, width = self.losses, self.width

        def make() -> tuple[Callable, Callable]:
            counter = Counter(losses, width, trees, wanted)

            def finish() -> pa.RecordBatch:
                cell = np.flatnonzero(counter.total[1])
                return pa.RecordBatch.from_arrays([pa.array(cell), *map(pa.array, counter.total[:, cell])], ["cell", "s", "n"])

            return lambda codes, y, f, in_bag, _: counter.add(codes, y, f, in_bag), finish

        rows = self._pass(make, "cell bigint, s double, n double").groupBy("cell").agg(
            F.sum("s").alias("s"), F.sum("n").alias("n")).toArrow()
        whole = Counter(losses, width, trees, wanted)
        whole.total[:, rows.column("cell").to_numpy()] = [rows.column("s").to_numpy(), rows.column("n").to_numpy()]
        return whole.histograms()

    def _set_quantiles(self, trees: list[Tree]) -> None:
        """Leaves of quantile losses get that quantile of the rest in them."""
        arrays = [t.arrays() for t in trees]
        which = [o for o, loss in enumerate(self.losses) if loss.quantile is not None]
        if not which:
            return

        def make() -> tuple[Callable, Callable]:
            def add(codes, y, f, in_bag, _):
                n = int(in_bag.sum())
                leaf = np.concatenate([leaf_of(codes[in_bag], arrays[o]) for o in which])
                rest = np.concatenate([(y - f[:, o])[in_bag] for o in which])
                return pa.RecordBatch.from_arrays([pa.array(np.repeat(which, n)), pa.array(leaf), pa.array(rest)],
                                                  ["o", "leaf", "rest"])

            return add, lambda: None

        asked = [self.losses[o].quantile for o in which]
        found = self._pass(make, "o bigint, leaf bigint, rest double").groupBy("o", "leaf").agg(
            F.percentile_approx("rest", asked, ACCURACY).alias("q")).collect()
        for r in found:
            trees[r["o"]].value[r["leaf"]] = float(r["q"][which.index(r["o"])])

    def run(self, rounds: int) -> Boosting:
        if self.parts == 1:
            self._run_in_place(rounds)
            rounds = 0
        for r in range(rounds):
            trees = self.grower.grown(self._histograms)
            self._set_quantiles(trees)
            for o, tree in enumerate(trees):
                self.trees[o].append(tree)
            if (r + 1) % STORE_EVERY == 0 and r + 1 < rounds:
                self._store()
        self.table.unpersist()
        return self

    def _run_in_place(self, rounds: int) -> None:
        """A table of one partition: its task has all histograms, so every round runs there, with the same result."""
        grower, width, rate, seed = self.grower, self.width, self.rate, self.seed
        row_rounds, row_share = self.row_rounds, self.row_share

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(list(batches)).combine_chunks()
            y, u = rows.column("y").to_numpy(), rows.column("u").to_numpy()
            codes = np.frombuffer(b"".join(rows.column("b").to_pylist()), np.uint8).reshape(len(y), width)
            f = np.array(rows.column("f").combine_chunks().flatten()).reshape(len(y), -1).copy()
            made = boosted_here(grower, codes, y, f, u, rounds, rate, seed, row_share, row_rounds)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["trees"])

        self.trees = pickle.loads(self.table.mapInArrow(work, "trees binary").first()[0])

    def _store(self) -> None:
        def make() -> tuple[Callable, Callable]:
            def add(codes, y, f, in_bag, b):
                lists = pa.ListArray.from_arrays(np.arange(0, f.size + 1, f.shape[1], dtype=np.int32), f.ravel())
                return pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, b.column(3)], ["b", "y", "f", "u"])

            return add, lambda: None

        after = keep_table(self._pass(make, "b binary, y double, f array<double>, u bigint"), "boosting")
        self.table.unpersist()
        self.table, self.stored = after.coalesce(self.parts).persist(), len(self.trees[0])
