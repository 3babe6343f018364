from collections import Counter

import edge
import numpy as np

from loadcast.llm import quality


def brute(text):
    text = text or ""
    words = edge.words(text)
    lines = [x for x in text.split("\n") if edge.words(x)]
    repeat = {}
    for n in {5, *quality.COVERAGE}:
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        many = Counter(grams)
        inside = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(n)}
        repeat[n] = (len(inside), sum(len(words[i]) for i in inside))
    n_chars = sum(map(len, words))
    earlier, dups = set(), []
    for x in lines:
        dups.append(x in earlier)
        earlier.add(x)
    chars = [len(x.encode()) for x in lines]
    failed = len(words) < 10 or 100 * repeat[5][0] > 20 * len(words)
    fine = all(repeat[n][1] <= s * max(n_chars, 1) for n, s in quality.COVERAGE.items())
    fine &= sum(c for c, d in zip(chars, dups) if d) <= quality.LINE_CHARS * max(sum(chars), 1)
    return (len(words), n_chars, sum(text.count(c) for c in "#*$%&|<>"), sum(dups), repeat[5][0], failed,
            fine and not failed)


def test_matches_brute_force(spark):
    rows = edge.documents() + [edge.row(500, "a b c d e # a b c d e | x y"), edge.row(501, "x " * 400),
                               edge.row(502, "\n".join(["line of words number one"] * 5 + ["and the other"]))]
    found = quality.quality(edge.frame(spark, rows)).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)
                  for r in found)
    assert got == Counter((r[0], *brute(r[1])) for r in rows)


def test_collisions_start_over(monkeypatch):
    """A multiplier of 0 makes all windows collide; the check by words mends it."""
    monkeypatch.setattr(quality, "_ODD", np.uint64(0))
    text = " ".join("abcdefghij") + " " + " ".join("klmnopqrst") + " " + " ".join("abcdefghij")
    assert quality.measure([text.encode()])[4][0] == brute(text)[4] == 20


def test_good_keeps_rows_and_columns(spark):
    docs = edge.frame(spark)
    kept = quality.good(docs)
    want = [r for r in edge.documents() if brute(r[1])[-1]]
    assert kept.columns == docs.columns
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, want))


def test_empty_table(spark):
    assert quality.quality(edge.frame(spark, [])).count() == 0
