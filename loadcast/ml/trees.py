"""One regression tree grown row by row to any depth, and how trees are walked. Numpy only, called inside tasks."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: Chance that a row is drawn at most k times when as many rows are drawn, with replacement, as there are.
_DRAWN = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])
#: Gains that differ by less, relatively, are equal: the same rows parted by another feature sum up differently.
EQUAL = 1e-9


def draws(u: np.ndarray, tree: int, seed: int | None) -> np.ndarray:
    """How often a tree draws each row, once if ``seed`` is None.

    A row is known by a random number, so every task draws alike.
    """
    if seed is None:
        return np.ones(len(u), int)
    salt = np.uint64(((tree + 1) * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) % (1 << 64))
    mixed = u.view(np.uint64) ^ salt
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(factor)
    mixed ^= mixed >> np.uint64(29)
    return np.searchsorted(_DRAWN, (mixed >> np.uint64(11)) / float(1 << 53), side="right")


@dataclass(frozen=True)
class Rule:
    """When a node is not split: at ``max_depth`` (None: never), under ``min_split`` rows, or if a child would have
    fewer than ``min_leaf``. Rows drawn several times count once here, and so often in means."""

    max_depth: int | None = None
    min_split: int = 2
    min_leaf: int = 1

    def may_split(self, rows, depth: int):
        deep = self.max_depth is not None and depth >= self.max_depth
        return (rows >= max(self.min_split, 2 * self.min_leaf, 2)) & (not deep)


@dataclass
class Nodes:
    """A tree as arrays: a row goes left where its ``feature`` is at most ``threshold``, else to ``left + 1``.

    A leaf has feature -1. Every node has its mean as ``value``, so that a tree can be cut at any depth.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def walk(self, x: np.ndarray, cuts: list[int | None], start: int = 0) -> np.ndarray:
        """Value per row and depth at which the walk stops; ``cuts`` ascend, None (last) is the leaf."""
        node = np.full(len(x), start)
        going = np.arange(len(x))
        out = np.empty((len(x), len(cuts)))
        depth = 0
        for c, cut in enumerate(cuts):
            while len(going) and (cut is None or depth < cut):
                at = node[going]
                inner = self.feature[at] >= 0
                going, at = going[inner], at[inner]
                node[going] = self.left[at] + ~(x[going, self.feature[at]] <= self.threshold[at])
                depth += 1
            out[:, c] = self.value[node]
        return out


def grown(x: np.ndarray, y: np.ndarray, w: np.ndarray, rule: Rule, depth: int = 0) -> Nodes:
    """The tree of rows ``x`` (features), ``y`` and ``w`` (times drawn, at least 1), whose root lies at ``depth``.

    Each split takes away the most squared error; of equals the first feature and then the least threshold is taken,
    half-way between two values. A node is split until its targets are equal or the rule forbids it. A level is grown
    at once: every feature keeps the rows ordered by node and value, so all splits are read off running sums.
    """
    columns = np.ascontiguousarray(x.T, float)
    p = len(columns)
    features = np.arange(p)[:, None]
    centre = float(np.average(y, weights=w))
    pull, w = w * (y - centre), w.astype(float)
    order = np.argsort(columns, axis=1, kind="stable")
    node = np.zeros(len(y), int)
    levels: list[tuple[np.ndarray, ...]] = []
    made = 0
    while order.shape[1]:
        m, first = order.shape[1], order[0]
        at = node[first]
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        sizes = np.diff(starts, append=m)
        k = len(starts)
        total_w, total = np.add.reduceat(w[first], starts), np.add.reduceat(pull[first], starts)
        impure = np.minimum.reduceat(y[first], starts) < np.maximum.reduceat(y[first], starts)
        may = impure & rule.may_split(sizes, depth)
        feature, threshold, left = np.full(k, -1), np.zeros(k), np.zeros(k, int)
        split = np.zeros(k, bool)
        if may.any():
            rank = np.arange(m) - starts[at] + 1
            enough = may[at] & (rank >= rule.min_leaf) & (sizes[at] - rank >= max(rule.min_leaf, 1))
            values = columns[features, order]
            fine = np.zeros((p, m), bool)
            fine[:, :-1] = enough[:-1] & (values[:, :-1] < values[:, 1:])
            lw, ls = w[order], pull[order]
            cw, cs = lw.cumsum(axis=1), ls.cumsum(axis=1)
            lw, ls = cw - (cw - lw)[:, starts][:, at], cs - (cs - ls)[:, starts][:, at]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(fine, ls**2 / lw + (total[at] - ls) ** 2 / (total_w[at] - lw), -np.inf)
            best = np.maximum.reduceat(gain, starts, axis=1)
            top = best.max(axis=0)
            split = top > -np.inf
            top = np.where(split, top - EQUAL * np.abs(top), np.inf)
            chosen = (best >= top).argmax(axis=0)
            hits = np.flatnonzero(gain[chosen[at], np.arange(m)] >= top[at])
            _, one = np.unique(at[hits], return_index=True)
            place, chosen = hits[one], chosen[split]
            low, high = values[chosen, place], values[chosen, place + 1]
            middle = low / 2 + high / 2
            feature[split] = chosen
            threshold[split] = np.where((middle >= low) & (middle < high), middle, low)
            left[split] = made + k + 2 * np.arange(len(place))
        levels.append((feature, threshold, left, centre + total / total_w))
        made += k
        rows = first[split[at]]
        of = node[rows]
        stays = np.zeros(len(y), bool)
        stays[rows] = True
        new = 2 * (split.cumsum() - 1)[of] + ~(columns[feature[of], rows] <= threshold[of])
        order = order[stays[order]].reshape(p, -1)
        node[rows] = new
        order = np.take_along_axis(order, np.argsort(node[order], axis=1, kind="stable"), axis=1)
        depth += 1
    return Nodes(*(np.concatenate(parts) for parts in zip(*levels, strict=True)))
