"""Quality rules on repetition: characters inside repeated n-grams and lines of a text."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from .common import filter_texts, map_texts, numbered

#: Largest share of a text's word characters inside n-grams that occur twice or more, by n. Published rules for
#: web text start at 0.15; these start where the base rule does, so that a short text with one line
#: written twice is not lost.
COVERAGE = {5: 0.20, 6: 0.19, 7: 0.18, 8: 0.17, 9: 0.16, 10: 0.15}
#: Largest share of characters in lines that equal an earlier line.
LINE_CHARS = 0.20
MIN_WORDS, BASE_WINDOW, BASE_PERCENT = 10, 5, 20
SYMBOLS = b"#*$%&|<>"
FIELDS = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
          "dup_line_share double, dup_line_char_share double, repeat_char_share double, "
          "base_failed boolean, kept boolean")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _repeated(codes: np.ndarray, owner: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Which of the windows of ``n`` words at ``starts`` occur again in the same text.

    Windows are compared by a rolling polynomial hash; each hit is checked word by word, and a collision
    starts over with another multiplier.
    """
    if not len(starts):
        return np.zeros(0, bool)
    odd = _ODD
    while True:
        key = owner[starts].astype(np.uint64) * odd
        for k in range(n):
            key = (key ^ (key >> np.uint64(29))) * odd + codes[starts + k].astype(np.uint64)
        order = np.argsort(key)
        a, b = starts[order[:-1]], starts[order[1:]]
        hit = np.flatnonzero(key[order[:-1]] == key[order[1:]])
        same = owner[a[hit]] == owner[b[hit]]
        for k in range(n):
            same &= codes[a[hit] + k] == codes[b[hit] + k]
        if same.all():
            found = np.zeros(len(starts), bool)
            found[order[hit]] = found[order[hit + 1]] = True
            return found
        odd = odd * np.uint64(6364136223846793005) | np.uint64(1)


def _sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, values, n).astype(np.int64)


def measure(texts: Sequence[bytes], coverage: dict[int, float] | None = None) -> list[np.ndarray]:
    """The columns of ``FIELDS`` for each text."""
    limits = COVERAGE if coverage is None else coverage
    n = len(texts)
    split = [t.split() for t in texts]
    n_words = np.fromiter(map(len, split), np.int64, n)
    words = [w for s in split for w in s]
    owner = np.repeat(np.arange(n), n_words)
    codes, distinct = numbered(words)
    points = np.fromiter((len(w) if w.isascii() else len(w.decode("utf-8", "replace")) for w in distinct),
                         np.int64, len(distinct))
    chars = points[codes]
    word_chars = _sums(chars, owner, n)
    symbols = np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64)

    n_lines, dup_lines, line_chars, dup_chars = (np.zeros(n, np.int64) for _ in range(4))
    for i, text in enumerate(texts):
        seen: set[bytes] = set()
        for line in text.split(b"\n"):
            if line and not line.isspace():
                n_lines[i] += 1
                line_chars[i] += len(line)
                if line in seen:
                    dup_lines[i] += 1
                    dup_chars[i] += len(line)
                else:
                    seen.add(line)

    first = np.cumsum(n_words) - n_words
    place = np.arange(len(codes)) - first[owner]
    room = n_words[owner] - place
    repeat_words, worst = np.zeros(n, np.int64), np.zeros(n)
    over = np.zeros(n, bool)
    # a repeated window of n + 1 words starts with a repeated window of n, so each length looks at less
    starts = np.arange(len(codes))
    for length in sorted({BASE_WINDOW, *limits}):
        starts = starts[room[starts] >= length]
        starts = starts[_repeated(codes, owner, starts, length)]
        change = np.zeros(len(codes) + 1, np.int64)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + length, -1)
        covered = np.cumsum(change[:-1]) > 0
        if length == BASE_WINDOW:
            repeat_words = _sums(covered, owner, n)
        if length in limits:
            share = _sums(chars * covered, owner, n) / np.maximum(word_chars, 1)
            worst, over = np.maximum(worst, share), over | (share > limits[length])
    line_share, char_share = dup_lines / np.maximum(n_lines, 1), dup_chars / np.maximum(line_chars, 1)
    failed = (n_words < MIN_WORDS) | (100 * repeat_words > BASE_PERCENT * n_words)
    kept = ~failed & ~over & (char_share <= LINE_CHARS)
    return [n_words, word_chars, symbols, dup_lines, repeat_words, line_share, char_share, worst, failed, kept]


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            coverage: dict[int, float] | None = None) -> DataFrame:
    """One row per input row: doc_id and the columns of ``FIELDS``.

    Words are runs without ASCII white space, lines are split at line feeds and count if they hold a word.
    ``n_repeat_words`` are the words inside five-word windows that occur twice or more, the first one
    included; ``repeat_char_share`` is the largest share of word characters in repeated n-grams of the lengths
    in ``coverage``. A text fails the base rule with under 10 words or with over 20 % repeated words; it is
    kept if it passes that and all limits of lines and n-grams. Null counts as empty and fails. Repeated rows
    are judged each for itself. An empty table gives no rows.
    """
    return map_texts(docs, id_col, text_col, lambda texts: measure(texts, coverage), FIELDS)


def good(docs: DataFrame, text_col: str = "text", coverage: dict[int, float] | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all columns."""
    return filter_texts(docs, text_col, lambda texts: measure(texts, coverage)[-1])
