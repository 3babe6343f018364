"""Connected components of a graph given by its edges, for any length of path and size of component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _least(links: DataFrame) -> DataFrame:
    """Smallest neighbour of each ``u``, or ``u`` itself."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges``: columns u, v (longs). Returns node, component (smallest node that can be reached).

    Alternates two steps until the edges stop to change: each node ties its larger neighbours to the
    smallest node it sees, then each node ties its smaller neighbours to the smallest of them. Edges
    then form stars around the smallest node of each component, after a number of rounds that grows with
    the logarithm of the longest path. Every step is a grouped minimum, combined before the shuffle, and
    a join that adaptive execution may split. Each round is written to the shared folder. Loops and
    repeated edges are allowed; edges with a null end are ignored; no edges give no rows.
    """
    state = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                   .distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = state.union(state.select("v", "u"))
        large = (both.join(_least(both), "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        smallest = _least(large)
        small = (large.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(smallest.where("u <> m").select("u", F.col("m").alias("v"))).distinct())
        state = stored(small, "edges")
        after = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
