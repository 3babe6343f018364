"""Language of texts from a linear-chain conditional random field over their words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import byte_texts, filter_texts, map_arrow, map_texts, numbered, steps, stored
from .tokens import cut, distinct_words, joined, places

UNKNOWN = "und"
#: Where a sample is asked for: bytes of its longest text, and how many languages it has.
SAMPLE_BYTES, MAX_LANGUAGES = 20_000, 200
#: Labelled text that one task learns from, and of the blocks it takes one after the other, about.
TASK_BYTES, BLOCK_BYTES = 1 << 25, 1 << 23
#: Up to so much labelled text in all is learned from three times.
SMALL_BYTES = 1 << 22
#: Words that a task counts before it hands its counts on, and weights in a batch of those it hands on.
HELD_WORDS, MIXED_ROWS = 500_000, 1 << 16
#: Metrics are added up as whole numbers, this many to 1.
WHOLE = 1 << 20
#: Words of a sequence that is learned from, mean words of a run in it, and step of the gradient.
STEPS, RUN, RATE = 48, 12, 0.5
BUCKETS = 1 << 18
#: A language's lexicon: its most frequent words in the sample.
LEXICON = 300
_WORD = re.compile(r"[^\W\d_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_N_PREFIX, _N_SUFFIX, _N_GRAM = range(0, 3), range(3, 6), range(6, 8)


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _words(text: str) -> list[str]:
    """Runs of letters in lower case. Raised and Roman numbers look like letters to the pattern, but do not count."""
    found = _WORD.findall(text.lower())
    if text.isascii():
        return found
    return [w for w in found if w.isalpha() or any(map(str.isalpha, w))]


def _coded(texts: list[bytes]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """The ``_words`` of UTF-8 texts as numbers of distinct ones, these, and the number of words of each text.

    Texts are cut at spaces and line ends first, which no word holds and no letter's lower case looks across, so that
    letters are looked for in different parts only.
    """
    _, data, begin = joined(texts)
    edge = np.flatnonzero(np.diff((data == 32) | (data == 10), prepend=True, append=True))
    start, size = edge[::2], np.diff(edge)[::2]
    code, of = distinct_words(data, start, size)
    parts = b"\n".join(cut(data, start[of], size[of])).decode("utf-8", "replace").lower().split("\n")
    found = [[part] if part.isalpha() else _words(part) for part in parts[: len(of)]]
    many = np.fromiter(map(len, found), np.int64, len(found))
    numbers, distinct = numbered([w for some in found for w in some])
    sizes = many[code]
    lengths = np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(start, [*begin.tolist(), len(data)])])
    return numbers[places((np.cumsum(many) - many)[code], sizes)], distinct, lengths


def _hash(kind: int, parts: list[np.ndarray]) -> np.ndarray:
    key = np.full(len(parts[0]), kind + 1, np.uint64)
    for p in parts:
        key = (key ^ p.astype(np.uint64)) * _ODD
        key ^= key >> np.uint64(31)
    return (key % np.uint64(BUCKETS)).astype(np.int64)


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed prefixes and suffixes of 1 to 3 characters and inner n-grams of 2 and 3: buckets, word of each."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size) - size
    end, number = start + size, np.arange(len(words))
    owner = np.repeat(number, size)
    room = end[owner] - np.arange(len(flat))
    found, of = [], []
    for n in (1, 2, 3):
        some = np.flatnonzero(size >= n)
        found += [_hash(_N_PREFIX[n - 1], [flat[start[some] + k] for k in range(n)]),
                  _hash(_N_SUFFIX[n - 1], [flat[end[some] - n + k] for k in range(n)])]
        of += [number[some], number[some]]
        if n > 1:
            at = np.flatnonzero(room >= n)
            found.append(_hash(_N_GRAM[n - 2], [flat[at + k] for k in range(n)]))
            of.append(owner[at])
    return np.concatenate(found), np.concatenate(of)


@dataclass
class Crf:
    """Weights of features by label, of words of each language's lexicon, and of transitions.

    ``lexicon`` has the row of each word in ``members``, which says whose lexicon it is in; row 0 is for other words.
    """

    labels: list[str]
    weights: np.ndarray
    lexicon: dict[str, int]
    members: np.ndarray
    lexicon_weights: np.ndarray
    transitions: np.ndarray

    def _memberships(self, words: list[str]) -> np.ndarray:
        rows = np.fromiter((self.lexicon.get(w, 0) for w in words), np.int64, len(words))
        return self.members[rows].astype(np.int64)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Score of each label for each word; long words weigh no more than short ones."""
        found, of = _features(words)
        n = len(words)
        out = np.empty((n, len(self.labels)), np.float32)
        many = np.maximum(np.bincount(of, minlength=n), 1)
        for k in range(len(self.labels)):
            out[:, k] = np.bincount(of, self.weights[found, k], n) / many
        return out + self._memberships(words) @ self.lexicon_weights

    def marginals(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Forward-backward over sequences laid end to end: probability of each label at each word.

        Sequences advance together, longest first, so those still running are always the first ones. Words lie by their
        place in the sequence meanwhile.
        """
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        starts = (np.cumsum(lengths) - lengths)[order]
        steps = int(sizes[0]) if len(sizes) else 0
        running = np.searchsorted(-sizes, -np.arange(steps), side="left")
        ends = np.cumsum(running)
        at = starts[np.arange(len(emissions)) - np.repeat(ends - running, running)] + np.repeat(np.arange(steps), running)
        score = emissions[at]
        score -= score.max(axis=1, keepdims=True)
        np.exp(score, out=score)
        move = np.exp(self.transitions - self.transitions.max()).astype(np.float32)
        alpha, beta = np.empty_like(score), np.ones_like(score)
        parts = [slice(end - n, end) for end, n in zip(ends.tolist(), running.tolist(), strict=True)]
        for t, part in enumerate(parts):
            now = alpha[part]
            if t:
                np.matmul(alpha[parts[t - 1]][: len(now)], move, out=now)
                now *= score[part]
            else:
                now[:] = score[part]
            now /= now.sum(axis=1, keepdims=True)
        for t in range(steps - 1, 0, -1):
            back = (beta[parts[t]] * score[parts[t]]) @ move.T
            back /= back.sum(axis=1, keepdims=True)
            beta[parts[t - 1]][: len(back)] = back
        alpha *= beta
        alpha /= alpha.sum(axis=1, keepdims=True)
        found = np.empty_like(alpha)
        found[at] = alpha
        return found

    def label(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """Marginals of all words, their numbers among distinct words, these, and the number of words of each text."""
        codes, distinct, lengths = _coded(texts)
        if not len(codes):
            return np.zeros((0, len(self.labels)), np.float32), codes, distinct, lengths
        return self.marginals(self.emissions(distinct)[codes], lengths), codes, distinct, lengths

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Label with the largest mean probability over a text's words, and that mean; ties go to the first."""
        if not self.labels:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        marginal, _, _, lengths = self.label(texts)
        owner = np.repeat(np.arange(len(texts)), lengths)
        means = np.stack([np.bincount(owner, marginal[:, k], len(texts)) for k in range(len(self.labels))], axis=1)
        means /= np.maximum(lengths, 1)[:, None]
        best = means.argmax(axis=1)
        score = np.clip(means[np.arange(len(texts)), best], 0, 1)
        return [self.labels[b] if n else UNKNOWN for b, n in zip(best, lengths, strict=True)], score

    def spans(self, text: str) -> list[tuple[str, list[str]]]:
        """Runs of words of one language in a code-switched text, in order."""
        marginal, codes, distinct, _ = self.label([text.encode()])
        found: list[tuple[str, list[str]]] = []
        for word, row in zip((distinct[c] for c in codes), marginal, strict=True):
            name = self.labels[int(row.argmax())]
            if not found or found[-1][0] != name:
                found.append((name, []))
            found[-1][1].append(word)
        return found


class Learner:
    """Trains a model by gradient steps on the likelihood of code-switched sequences.

    Only whole texts have a language, so sequences of ``STEPS`` words are made by cutting all texts into runs of random
    length (``RUN`` words on average) and joining these in random order; the transitions are learned from them. Every
    word of every text takes part in each epoch. ``share`` is how much a word of each language counts.
    """

    def __init__(self, labels: list[str], lexicon: list[tuple[str, str]], share: dict[str, float], seed: int = 7) -> None:
        """``lexicon``: language and word, in the order of the table."""
        size = len(labels)
        self.number = {name: k for k, name in enumerate(labels)}
        rows: dict[str, int] = {}
        own = [(rows.setdefault(w, len(rows) + 1), self.number[name]) for name, w in lexicon]
        members = np.zeros((len(rows) + 1, size), bool)
        for row, k in own:
            members[row, k] = True
        self.model = Crf(labels, np.zeros((BUCKETS, size), np.float32), rows, members, np.zeros((size, size), np.float32),
                         np.zeros((size, size), np.float32))
        self.squares = [np.zeros_like(x) for x in self.tables]
        self.share = np.array([share.get(name, 0) for name in labels], np.float32)
        self.rng = np.random.default_rng(seed)

    @property
    def tables(self) -> list[np.ndarray]:
        return [self.model.weights, self.model.lexicon_weights, self.model.transitions]

    def learn(self, texts: list[bytes], langs: list[str], epochs: int = 1) -> None:
        codes, distinct, lengths = _coded(texts)
        if not len(codes):
            return
        truth = np.repeat([self.number[name] for name in langs], lengths)
        found, of = _features(distinct)
        order = np.argsort(of, kind="stable")
        # weights of what these words have lie together while they are learned from
        some = np.zeros(BUCKETS, bool)
        some[found] = True
        used, found = np.flatnonzero(some), (np.cumsum(some) - 1)[found[order]]
        sizes = np.bincount(of, minlength=len(distinct))
        starts, member = np.cumsum(sizes) - sizes, self.model._memberships(distinct)
        del of, order, distinct
        weights, squares = self.model.weights[used], self.squares[0][used]
        batch = STEPS * int(np.clip(len(codes) // (100 * STEPS), 64, 256))
        for _ in range(epochs):
            cuts = np.cumsum(self.rng.geometric(1 / RUN, len(codes) * 2 // RUN + 1))
            begin = np.unique(np.concatenate([np.cumsum(lengths) - lengths, cuts, [0]]))
            begin = begin[begin < len(codes)]
            mixed = self.rng.permutation(len(begin))
            at = places(begin[mixed], np.diff(begin, append=len(codes))[mixed])
            # the last sequence is filled up from the first one
            at = np.resize(at, -(-len(at) // STEPS) * STEPS)
            for some in (at[k : k + batch] for k in range(0, len(at), batch)):
                word, own = np.unique(codes[some], return_inverse=True)
                place, n = found[places(starts[word], sizes[word])], sizes[word]
                sums = np.add.reduceat(weights[place], np.cumsum(n) - n, axis=0)
                scores = sums / n[:, None] + member[word] @ self.model.lexicon_weights
                error, pairs = self._error(scores.astype(np.float32)[own], truth[some])
                of_word = np.stack([np.bincount(own, e, len(word)) for e in error.T], axis=1)
                grad = np.stack([np.bincount(place, np.repeat(e, n), len(used)) for e in (of_word / n[:, None]).T.copy()],
                                axis=1)
                for table, square, g in ((weights, squares, grad),
                                         (self.model.lexicon_weights, self.squares[1], member[word].T @ of_word),
                                         (self.model.transitions, self.squares[2], pairs)):
                    square += g**2
                    table += RATE * g / np.sqrt(square + 1e-6)
        self.model.weights[used], self.squares[0][used] = weights, squares

    def _error(self, scores: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is missing to the right label at each word, and to the right transitions; rows are sequences end to end."""
        size = len(self.model.labels)
        marginal, joint = _both_ways(scores.reshape(-1, STEPS, size), self.model.transitions,
                                     self.share[truth].reshape(-1, STEPS))
        error = -marginal.reshape(-1, size)
        error[np.arange(len(truth)), truth] += 1
        pair = truth.reshape(-1, STEPS)
        seen = np.bincount((pair[:, :-1] * size + pair[:, 1:]).ravel(), self.share[pair[:, 1:]].ravel(), size * size)
        return error * self.share[truth][:, None], seen.reshape(size, size) - joint


def _both_ways(scores: np.ndarray, transitions: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of sequences of equal length, and expected transitions, each counting the share of its second word."""
    score = np.exp(scores - scores.max(axis=2, keepdims=True)).transpose(1, 0, 2).copy()
    move = np.maximum(np.exp(transitions - transitions.max()), 1e-20).astype(score.dtype)
    steps = len(score)
    alpha, beta, late = np.empty_like(score), np.ones_like(score), score.copy()
    for t in range(steps):
        state = (alpha[t - 1] @ move) * score[t] if t else score[t]
        alpha[t] = state / state.sum(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        back = late[t + 1] @ move.T
        beta[t] = back / back.sum(axis=1, keepdims=True)
        late[t] *= beta[t]
    marginal = alpha * beta
    marginal /= marginal.sum(axis=2, keepdims=True)
    whole = ((alpha[:-1] @ move) * late[1:]).sum(axis=2, keepdims=True)
    before = alpha[:-1] * (share.T[1:, :, None] / whole)
    size = scores.shape[2]
    return marginal.transpose(1, 0, 2), (before.reshape(-1, size).T @ late[1:].reshape(-1, size)) * move


def _expected_moves(model: Crf, words: list[str], batch: int, steps: int) -> np.ndarray:
    """Expected number of transitions between labels in sequences of equal length."""
    emissions = model.emissions(words).reshape(batch, steps, len(model.labels))
    return _both_ways(emissions, model.transitions, np.ones((batch, steps)))[1]


def _shares(counts: dict[str, int]) -> dict[str, float]:
    """How much a word of each language counts, so that all languages count alike and a word 1 on average."""
    some = {name: n for name, n in counts.items() if n}
    return {name: sum(some.values()) / len(some) / n for name, n in some.items()}


def fit(texts: list[str], langs: list[str], epochs: int = 3) -> Crf:
    """Train on labelled texts that one process holds; their order does not matter."""
    labels = sorted(set(langs))
    counts: dict[str, Counter] = {name: Counter() for name in labels}
    ordered = sorted(zip(texts, langs, strict=True))
    for text, name in ordered:
        counts[name].update(_words(text))
    lexicon = [(name, w) for name in labels
               for w in sorted(counts[name], key=lambda w: (-counts[name][w], w))[:LEXICON]]
    learner = Learner(labels, lexicon, _shares({name: c.total() for name, c in counts.items()}))
    learner.learn([t.encode() for t, _ in ordered], [name for _, name in ordered], epochs)
    return learner.model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int | None = None, max_bytes: int = SAMPLE_BYTES) -> Crf:
    """Fit on all rows outside ``held_out`` with an id, a text and a language; all languages are learned.

    With ``per_language`` only a sample is learned from, see ``_sample``. No labelled row gives a model without labels,
    which predicts ``und``.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"),
                       F.col(lang_col).cast("string").alias("l")).where(
        F.col("l").isNotNull() & F.col("i").isNotNull() & F.col("t").isNotNull() & ~held_out("i"))
    if per_language is not None:
        sample = _sample(rows.where(F.octet_length("t") <= max_bytes), per_language)
        return fit([r.t for r in sample], [r.l for r in sample])
    counts = stored(word_counts(rows), "word_counts")
    totals = counts.groupBy("l").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).collect()
    nth = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "w"))
    lexicon = sorted((r.l, r.k, r.w) for r in counts.where("n > 0").withColumn("k", nth).where(F.col("k") <= LEXICON)
                     .select("l", "w", "k").collect())
    return fitted(rows, sorted(r.l for r in totals), [(name, w) for name, _, w in lexicon],
                  _shares({r.l: r.n for r in totals}), sum(r.bytes for r in totals))


def word_counts(rows: DataFrame) -> DataFrame:
    """l, w, n: how often each language has each word; a word null has the ``bytes`` of the language's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        sizes: Counter = Counter()

        def emit() -> Iterator[pa.RecordBatch]:
            for name, found in counts.items():
                words = [*found, None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(words), pa.string()), pa.array(words, pa.string()),
                     pa.array([*found.values(), 0], pa.int64()),
                     pa.array([0] * len(found) + [sizes[name]], pa.int64())], ["l", "w", "n", "bytes"])
            counts.clear()
            sizes.clear()

        for some in steps(batches, 0):
            texts = byte_texts(some.column(0))
            codes, distinct, lengths = _coded(texts)
            number, names = numbered(some.column(1).to_pylist())
            key, n = np.unique(np.repeat(number, lengths) * max(len(distinct), 1) + codes, return_counts=True)
            ends = np.searchsorted(key, np.arange(len(names) + 1) * max(len(distinct), 1))
            for k, name in enumerate(names):
                own = slice(ends[k], ends[k + 1])
                words = map(distinct.__getitem__, (key[own] - k * len(distinct)).tolist())
                counts.setdefault(name, Counter()).update(dict(zip(words, n[own].tolist(), strict=True)))
            for text, k in zip(texts, number.tolist(), strict=True):
                sizes[names[k]] += len(text)
            if sum(map(len, counts.values())) > HELD_WORDS:
                yield from emit()
        yield from emit()

    found = map_arrow(rows.select("t", "l"), run, "l string, w string, n bigint, bytes bigint")
    return found.groupBy("l", "w").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))


def fitted(rows: DataFrame, labels: list[str], lexicon: list[tuple[str, str]], share: dict[str, float],
           n_bytes: int) -> Crf:
    """The model of all ``rows`` (i, t, l), learned in tasks of about ``TASK_BYTES`` of text and mixed.

    Rows are dealt by a hash, so that each task has texts of all kinds. A task takes its gradient steps on block after
    block of its texts. A weight is the mean of the tasks' weights, each counting as the root of the sum of its squared
    gradients, which is the metric of the steps: what a task has not seen does not count. The means are of whole
    numbers and rows are sorted in a task, so neither their order nor how they were partitioned matters.
    """
    size = len(labels)
    tasks = max(1, -(-n_bytes // TASK_BYTES))
    epochs = 1 if n_bytes > SMALL_BYTES else 3
    shared = rows.sparkSession.sparkContext.broadcast((labels, lexicon, share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner(*shared.value, seed=TaskContext.get().partitionId())
        for some in steps(batches, 0, BLOCK_BYTES):
            learner.learn(byte_texts(some.column(0)), some.column(1).to_pylist(), epochs)
        base = 0
        for table, square in zip(learner.tables, learner.squares, strict=True):
            seen = np.flatnonzero(square)
            for at in (seen[k : k + MIXED_ROWS] for k in range(0, len(seen), MIXED_ROWS)):
                metric = np.sqrt(square.ravel()[at].astype(float)) * WHOLE
                yield pa.RecordBatch.from_arrays(
                    [pa.array(base + at), pa.array(np.rint(metric * table.ravel()[at]).astype(np.int64)),
                     pa.array(np.rint(metric).astype(np.int64))], ["k", "part", "metric"])
            base += table.size

    dealt = (rows.withColumn("h", F.xxhash64("i", "t")).repartition(tasks, "h")
             .sortWithinPartitions("h", "i", "t", "l").select("t", "l"))
    mixed = (map_arrow(dealt, run, "k bigint, part bigint, metric bigint").groupBy("k")
             .agg(F.sum("part").alias("part"), F.sum("metric").alias("metric")).where("metric > 0")
             .select("k", (F.col("part") / F.col("metric")).cast("float").alias("w")).toArrow())
    shared.unpersist()
    model = Learner(labels, lexicon, share).model
    key, weight, base = mixed.column("k").to_numpy(), mixed.column("w").to_numpy(), 0
    for table in (model.weights, model.lexicon_weights, model.transitions):
        own = (key >= base) & (key < base + table.size)
        table.reshape(-1)[key[own] - base] = weight[own]
        base += table.size
    return model


def _sample(rows: DataFrame, per_language: int) -> list:
    """``per_language`` texts of each of the ``MAX_LANGUAGES`` languages with the most ids (ties by name).

    The ids with the smallest hash, found from short columns first, and of each its smallest text.
    """
    ids = rows.select("i", "l").distinct()
    most = ids.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(MAX_LANGUAGES).select("l")
    nth = F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("i"), "i"))
    chosen = (ids.join(F.broadcast(most), "l").withColumn("n", nth).where(F.col("n") <= per_language).select("i", "l"))
    # at most per_language * MAX_LANGUAGES short rows
    return rows.join(F.broadcast(chosen), ["i", "l"]).groupBy("i", "l").agg(F.min("t").alias("t")).collect()


def language(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (0 to 1).

    ``lang_pred`` is ``und`` with score 0 for a null text or one without a letter. Whole texts are labelled word
    by word; only the text is looked at. Repeated rows get the same answer; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, id_col, text_col, lambda texts: shared.value.predict(texts),
                     "lang_pred string, score double")


def in_known_language(docs: DataFrame, model: Crf, text_col: str = "text", min_score: float = 0.4) -> DataFrame:
    """The rows of ``docs`` whose language is found with at least ``min_score``, with all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts: list[bytes]) -> np.ndarray:
        names, score = shared.value.predict(texts)
        return (np.array(names, object) != UNKNOWN) & (score >= min_score)

    return filter_texts(docs, text_col, keep)
