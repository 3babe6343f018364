"""Ridge and elastic net, solved on the scatter matrix of the rows, and their searches over time folds.

Alpha means |y - Xw|^2 + alpha |w|^2 for ridge, and |y - Xw|^2 / (2n) + alpha (l1 |w|_1 + (1 - l1) |w|^2 / 2) for the
elastic net.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .least import FittedLinear, LeastSquares, solve, standardised
from .moments import Scatter, elastic, group_moments, scatter_of, squared_error, sum_of

# The grids searched.
RIDGE_GRID = [{"alpha": a} for a in (0.1, 1.0, 10.0, 100.0)]
ELASTIC_GRID = [{"alpha": a, "l1_ratio": l1} for a in (0.1, 1.0, 10.0) for l1 in (0.1, 0.5, 0.9)]


class Ridge(LeastSquares):
    def __init__(self, alpha: float = 1.0):
        super().__init__("Ridge", alpha)


class ElasticNet:
    def __init__(self, alpha: float = 1.0, l1_ratio: float = 0.5):
        self.name, self.alpha, self.l1_ratio = "Elastic Net", alpha, l1_ratio

    def fit(self, df: DataFrame, features: list[str], target: str = "y") -> FittedLinear:
        """One pass; rows without a target do not count, a null feature is an error."""
        row = group_moments(df.where(F.col(target).isNotNull()), [*features, target], []).first()
        if row is None:
            raise ValueError("no row with a target to fit on")
        found = scatter_of(row, len(features) + 1)
        standardised(found)  # for its checks
        weights, intercept = elastic(found, self.alpha, self.l1_ratio)
        return FittedLinear(self.name, list(features), weights.tolist(), intercept, target,
                            {"alpha": self.alpha, "l1_ratio": self.l1_ratio})


def solver(settings: dict) -> Callable[[Scatter], tuple[np.ndarray, float]]:
    """How the coefficients of a setting follow from a scatter matrix: an elastic net if it names ``l1_ratio``."""
    if "l1_ratio" in settings:
        return lambda found: elastic(found, settings["alpha"], settings["l1_ratio"])
    return lambda found: solve(standardised(found), settings["alpha"])


def searched(blocks: dict[int, Scatter], grid: list[dict], folds: int) -> tuple[list[float], int, np.ndarray, float]:
    """Mean squared error of each setting over the folds, the best one, and its fit on all blocks.

    Fold k trains on the blocks below k and is tested on block k; moments of blocks add up, so no fold reads a row.
    A fold without tested or without training rows does not count.
    """
    tested = [k for k in range(1, folds + 1) if k in blocks and any(b < k for b in blocks)]
    trained = {k: sum_of([blocks[b] for b in sorted(blocks) if b < k]) for k in tested}
    errors = [float(np.mean([squared_error(blocks[k], *solver(s)(trained[k])) for k in tested])) if tested else float("nan")
              for s in grid]
    best = int(np.nanargmin(errors)) if tested else 0
    return errors, best, *solver(grid[best])(sum_of([blocks[b] for b in sorted(blocks)]))
