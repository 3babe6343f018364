"""Toxic texts by compression distance: what a dictionary of toxic text saves over one of ordinary text.

Two zstandard dictionaries are trained apart, one on windows of ordinary text, one on the words that mark toxic text
in the places where they stand. Each window of a text is compressed with the ordinary dictionary alone and with the
toxic one laid before it. A window without toxic words costs the same either way; a toxic word becomes one match.
A text is judged by what its best two windows save, against a threshold calibrated on labelled texts that the
dictionaries have not seen.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Bound of the training sample: texts per class, and bytes per text.
TOXIC_TEXTS, ORDINARY_TEXTS, SAMPLE_BYTES = 1_000, 3_000, 16_000
#: Words of a window, and bytes of a piece that a longer word is cut into.
WINDOW, PIECE = 8, 64
#: Bytes of the dictionary of ordinary text, and windows it is trained on.
ORDINARY_BYTES, ORDINARY_WINDOWS = 32_768, 60_000
#: A word marks toxic text if it has this many different neighbourhoods there, this many times its share of ordinary
#: ones, and this large a likelihood ratio (twice the logarithm).
LEAST_CONTEXTS, LEAST_RATIO, LEAST_EVIDENCE = 3, 4.0, 14.0
#: Score from which a text counts as toxic; the calibrated threshold gets this score.
CUT = 0.7
#: Windows of a text whose savings count.
BEST = 2
_WORD = re.compile(r"[^\W\d_]+")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose label is never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def windows(text: str) -> list[bytes]:
    """Consecutive windows of ``WINDOW`` lower-cased words; overlong words are cut, so that windows stay short."""
    words = text.lower().split()
    if any(len(w) > PIECE for w in words):
        words = [w[a : a + PIECE] for w in words for a in range(0, len(w), PIECE)]
    return [f" {' '.join(words[a : a + WINDOW])} ".encode() for a in range(0, len(words), WINDOW)]


@dataclass(frozen=True)
class Model:
    """Both dictionaries, and the map from saved bytes to a score: ``slope`` and the ``threshold`` that gets ``CUT``."""

    ordinary: bytes
    toxic: bytes
    slope: float
    threshold: float

    def savings(self, texts: list[bytes]) -> np.ndarray:
        """Bytes that the best windows of each text save; 0 for a text without windows."""
        plain, both = _compressors(self.ordinary, self.toxic)
        found = np.zeros(len(texts))
        for i, text in enumerate(texts):
            saved = sorted((len(plain(w)) - len(both(w)) for w in windows(text.decode("utf-8", "replace"))), reverse=True)
            found[i] = sum(x for x in saved[:BEST] if x > 0)
        return found

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.toxic:
            return np.zeros(len(texts))
        odds = np.clip(self.slope * (self.savings(texts) - self.threshold) + math.log(CUT / (1 - CUT)), -500, 500)
        return 1 / (1 + np.exp(-odds))


NOTHING = Model(b"", b"", 0.0, 0.0)


@lru_cache(maxsize=4)
def _compressors(ordinary: bytes, toxic: bytes) -> tuple:
    """Compressing with the ordinary dictionary, and with the toxic one before it.

    The search tree holds every place of both, so that no match is missed by chance.
    """
    settings = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_BTLAZY2, window_log=17, hash_log=17, chain_log=18, search_log=9, min_match=4,
        target_length=8, write_content_size=False, write_checksum=False, write_dict_id=False)
    found = []
    for content in (ordinary, toxic + ordinary):
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=settings)
        found.append(zstandard.ZstdCompressor(dict_data=known, compression_params=settings).compress)
    return tuple(found)


def _contexts(texts: list[str]) -> tuple[Counter, int]:
    """Different neighbourhoods (word before, word, word after) of each word, so that copies of a passage count once."""
    seen: set[tuple[str, str, str]] = set()
    for text in texts:
        words = _WORD.findall(text.lower())
        seen.update(zip(["", *words], words, [*words[1:], ""], strict=False))
    return Counter(word for _, word, _ in seen), len(seen)


def marking_words(toxic: list[str], ordinary: list[str]) -> dict[str, int]:
    """Words that mark toxic texts, with the number of their neighbourhoods there."""
    ours, n = _contexts(toxic)
    theirs, m = _contexts(ordinary)

    def part(seen: int, expected: float) -> float:
        return seen * math.log(seen / expected) if seen else 0.0

    found = {}
    for word, a in ours.items():
        b = theirs[word]
        if a < LEAST_CONTEXTS or a * m <= LEAST_RATIO * b * n:
            continue
        share = (a + b) / (n + m)
        evidence = 2 * (part(a, n * share) + part(b, m * share) + part(n - a, n * (1 - share)) + part(m - b, m * (1 - share)))
        if evidence > LEAST_EVIDENCE:
            found[word] = a
    return found


def _trained(samples: list[bytes], size: int, **options) -> bytes:
    """A zstandard dictionary of the samples; as too few of them cannot train one, these are taken as they are."""
    try:
        return zstandard.train_dictionary(size, samples, **options).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def _dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    rng = np.random.default_rng(5)
    pool = [w for t in ordinary for w in windows(t) if len(w) >= 8]
    plain = _trained([pool[i] for i in sorted(rng.permutation(len(pool))[:ORDINARY_WINDOWS])], ORDINARY_BYTES) if pool else b""
    marks = marking_words(toxic, ordinary)
    if not marks:
        return plain, b""
    # whole words three times in a row, so that the trainer's segments do not cut them; what it leaves out comes first
    order = sorted(marks, key=lambda w: (-marks[w], w))
    samples = [((" " + w) * 3 + " ").encode() for w in order for _ in range(min(marks[w], 20))]
    known = _trained(samples, 300 + 2 * sum(3 * len(w.encode()) + 4 for w in order), d=6, k=32)
    rest = [f" {w} ".encode() for w in reversed(order) if f" {w} ".encode() not in known]
    return plain, b"".join(rest) + known


def fit(texts: list[str], labels: list[int]) -> Model:
    """Dictionaries from two thirds of the texts, the threshold with the best F1 from the others.

    Without texts of both classes, or a word that marks one, there is no model: every score is 0.
    """
    rows = sorted({(t, y) for t, y in zip(texts, labels, strict=True)})
    sides = {y: [t for t, z in rows if z == y] for y in (0, 1)}
    if not sides[0] or not sides[1]:
        return NOTHING
    learn = {y: [t for i, t in enumerate(s) if i % 3 or len(s) < 9] for y, s in sides.items()}
    judge = {y: [t for i, t in enumerate(s) if i % 3 == 0 or len(s) < 9] for y, s in sides.items()}
    plain, toxic = _dictionaries(learn[1], learn[0])
    if not toxic:
        return NOTHING
    model = Model(plain, toxic, 1.0, 0.0)
    high, low = (np.sort(model.savings([t.encode() for t in judge[y]])) for y in (1, 0))
    best, threshold = -1.0, 0.0
    for cut in range(1, int(max(high.max(), low.max(), 1)) + 2):
        caught, wrong = int((high >= cut).sum()), int((low >= cut).sum())
        f1 = 2 * caught / (2 * caught + wrong + len(high) - caught)
        if f1 > best:
            best, threshold = f1, cut - 0.5
    return Model(plain, toxic, _slope(high, low, threshold), threshold)


def _slope(high: np.ndarray, low: np.ndarray, threshold: float) -> float:
    """The slope at the threshold under which the labels are likeliest, each class with equal weight."""
    slopes = np.geomspace(0.05, 5, 60)
    cut = math.log(CUT / (1 - CUT))
    loss = [np.logaddexp(0, -(s * (high - threshold) + cut)).mean() + np.logaddexp(0, s * (low - threshold) + cut).mean()
            for s in slopes]
    return float(slopes[int(np.argmin(loss))])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          toxic_texts: int = TOXIC_TEXTS, ordinary_texts: int = ORDINARY_TEXTS, max_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on a bounded sample: ``toxic_texts`` and ``ordinary_texts`` labelled texts of up to ``max_bytes`` bytes.

    Only rows outside ``held_out`` with label 0 or 1 are learned from; an id with both labels counts as 1. The sample
    is the ids with the smallest hash of each class, one row of each; only its texts come to the driver.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where(
        F.col("i").isNotNull() & F.col("t").isNotNull() & ~held_out("i") & (F.octet_length("t") <= max_bytes))
    marks = (labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
             .where(F.col("i").isNotNull() & F.col("y").isin(0, 1) & ~held_out("i"))
             .groupBy("i").agg(F.max("y").alias("y")))
    known = rows.select("i").distinct().join(marks, "i")
    known = known.select("i", "y", F.xxhash64("i").alias("h"))

    def first(label: int, n: int) -> DataFrame:
        return known.where(F.col("y") == label).orderBy("h", "i").limit(n).select("i", "y")

    chosen = first(1, toxic_texts).union(first(0, ordinary_texts))  # so many short rows at most
    sample = rows.join(F.broadcast(chosen), "i").groupBy("i", "y").agg(F.min("t").alias("t")).collect()
    return fit([r.t for r in sample], [r.y for r in sample])


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1, higher if likelier toxic), predicted (1 from a score of 0.7).

    Whole texts are scored, and nothing but the text is looked at. A null or empty text saves nothing and has the
    lowest score. Repeated rows get the same answer; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[bytes]) -> list[np.ndarray]:
        score = shared.value.scores(texts)
        return [score, (score >= CUT).astype(np.int32)]

    return map_texts(docs, id_col, text_col, work, "score double, predicted int")
