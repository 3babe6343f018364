"""Near-duplicate documents by SimHash fingerprints, found by a grid join of segment bit counts."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bits, fresh, map_texts, stored
from .components import components

BITS = 64
SEED = 42
#: Fingerprints in one grid cell up to which its pairs are compared; fuller cells go by midpoints.
CELL_PAIRS = 64
#: Shingles whose bits are counted at once.
CHUNK = 1 << 18
LOW_BITS = 0x5555555555555555


def fingerprints(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """SimHash of each text as unsigned 64-bit numbers.

    A-Z are lower-cased, words are runs without ASCII white space. A shingle is ``shingle`` words joined by
    spaces, or the whole text if it has fewer; shingles count as often as they occur. A bit is 1 if it is set
    in over half of the XXH64 hashes. A text without a word gets 0.
    """
    total = np.zeros((len(texts), BITS), np.int64)
    counts = np.zeros(len(texts), np.int64)
    hashes: list[int] = []
    owners: list[tuple[int, int]] = []
    digest = xxhash.xxh64_intdigest

    def flush() -> None:
        if not owners:
            return
        rows = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        which, starts = (np.array(x) for x in zip(*owners, strict=True))
        total[which] += np.add.reduceat(rows, starts, axis=0, dtype=np.int64)
        hashes.clear()
        owners.clear()

    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= shingle:
            starts, ends = [0], [len(joined)]
        else:
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            last = np.cumsum(lengths + 1) - 1
            starts, ends = (last - lengths)[: 1 - shingle or None].tolist(), last[shingle - 1 :].tolist()
        counts[i] = len(starts)
        for at in range(0, len(starts), CHUNK):
            owners.append((i, len(hashes)))
            hashes.extend([digest(joined[a:b], SEED)
                           for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)])
            if len(hashes) >= CHUNK:
                flush()
    flush()
    majority = (2 * total > counts[:, None]).astype(np.uint8)
    return np.packbits(majority, axis=1, bitorder="little").reshape(-1, 8).view("<u8").reshape(-1)


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long, for every row."""
    return map_texts(docs, id_col, text_col, lambda texts: [fingerprints(texts, shingle).view(np.int64)], "fp bigint")


def embedding(fp: str) -> Column:
    """Bit counts of the 32 two-bit segments, each written as that many low ones.

    Two embeddings differ in as many bits as the Manhattan distance of their counts, which is at most the
    number of bits in which the fingerprints differ.
    """
    pair = F.shiftrightunsigned(fp, 1)
    either, both = bits(F.col(fp).bitwiseOR(pair), LOW_BITS), bits(F.col(fp).bitwiseAND(pair), LOW_BITS)
    return either.bitwiseOR(F.shiftleft(both, 1))


def block_masks(blocks: int) -> list[int]:
    """Bits of each of ``blocks`` runs of whole segments."""
    cuts = [2 * (BITS // 2 * i // blocks) for i in range(blocks + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]


def links(prints: DataFrame, max_distance: int = 2, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """Edges u, v between distinct fingerprints (column fp) that connect all within ``max_distance`` bits.

    A Manhattan ball of radius d leaves two of d + 2 blocks of segments without a difference, so two
    fingerprints in range share a grid cell: the counts in some pair of blocks. In cells of up to
    ``cell_pairs`` fingerprints the pairs are compared, by the Manhattan distance first and then by their
    bits. Fingerprints of fuller cells are tied to all points within half the distance instead: two lie
    within ``max_distance`` if and only if they share such a midpoint, so no link is lost, the number of rows
    stays in proportion, and no midpoint has more than a bounded number of fingerprints.
    """
    if max_distance % 2:
        raise ValueError("max_distance must be even: midpoints lie half-way")
    masks = [a | b for a, b in combinations(block_masks(max_distance + 2), 2)]
    cells = prints.select("fp", embedding("fp").alias("e")).select(
        "fp", "e", F.posexplode(F.array(*[bits("e", m) for m in masks])).alias("pair", "cell"))
    sizes = cells.groupBy("pair", "cell").agg(F.count("*").alias("n")).where("n > 1")
    crowd = stored(cells.join(sizes, ["pair", "cell"]), "cells")
    sparse = crowd.where(F.col("n") <= cell_pairs)
    left, right = sparse.alias("a"), sparse.alias("b")
    near = F.bit_count(F.col("a.e").bitwiseXOR(F.col("b.e"))) <= max_distance
    exact = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_distance
    compared = (left.join(right, (F.col("a.pair") == F.col("b.pair")) & (F.col("a.cell") == F.col("b.cell"))
                          & (F.col("a.fp") < F.col("b.fp")) & near & exact)
                .select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")))
    flips = [sum(1 << b for b in some) for n in range(max_distance // 2 + 1) for some in combinations(range(BITS), n)]
    flip = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in flips])
    midpoints = (crowd.where(F.col("n") > cell_pairs).select("fp").distinct()
                 .select("fp", F.explode(flip).alias("flip"))
                 .groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("midpoint"))
                 .agg(F.min("fp").alias("u"), F.collect_set("fp").alias("all"))
                 .where(F.size("all") > 1)
                 .select("u", F.explode("all").alias("v")).where("u <> v"))
    return compared.union(midpoints).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_distance: int = 2, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """One row per input row: doc_id, fp (signed long), component_id (smallest id that links can reach).

    Null and empty texts have fingerprint 0 and link like any other. Equal fingerprints always link. Repeated
    rows give repeated results; a component whose ids are all null has a null id. An empty table gives no rows.
    """
    prints = stored(with_fingerprint(docs, id_col, text_col, shingle), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    label = components(links(distinct.select("fp"), max_distance, cell_pairs))
    grouped = stored(distinct.join(label, distinct.fp == label.node, "left")
                     .select("fp", "least", F.coalesce("component", "fp").alias("component")), "groups")
    smallest = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    return (prints.join(grouped.join(smallest, "component").select("fp", "component_id"), "fp")
            .select("doc_id", "fp", "component_id"))


def hex16(fp: str = "fp") -> Column:
    """A signed long as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their group of near-duplicates, with all columns.

    Rows without an id belong to no group and stay. Of several rows with the same id, which are the same
    document, one stays: the one with the smallest text.
    """
    known = docs.where(F.col(id_col).isNotNull())
    mark, nth = fresh(docs, "_keep"), fresh(docs, "_nth")
    keep = (near_duplicates(known, id_col, text_col, **options).where("doc_id = component_id")
            .select(F.col("doc_id").alias(mark)).distinct())
    order = Window.partitionBy(mark).orderBy(F.col(text_col))
    first = (known.join(keep, known[id_col] == keep[mark]).withColumn(nth, F.row_number().over(order))
             .where(F.col(nth) == 1).select(docs.columns))
    return first.union(docs.where(F.col(id_col).isNull()))
