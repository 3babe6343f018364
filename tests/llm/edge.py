"""Small documents with every awkward case, and brute-force helpers."""

from __future__ import annotations

import random
import re

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, fp bigint, th bigint, digest string, "
          "host string, h string, component_id bigint, lines_equal string")
CLASH = (7, 8, "clash", "clash", "clash", 9, "clash")


def row(i, text, lang="en"):
    return (i, text, lang, "src", None if text is None else len(text), *CLASH)


def prose(rng, n):
    words = ["the", "of", "and", "river", "stone", "walks", "under", "morning", "light", "carries", "old", "songs",
             "over", "hills", "quiet", "towns", "where", "people", "gather", "bread"]
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "ing"]) for _ in range(n))


def documents(seed=3):
    rng = random.Random(seed)
    base = [prose(rng, 60) for _ in range(12)]
    rows = [row(i, t) for i, t in enumerate(base)]
    rows += [row(100, None), row(101, None), row(102, ""), row(103, " \t\n "), row(104, "one"), row(105, "two words")]
    rows += [row(110, base[0]), row(111, base[0].replace(" ", "  ")), row(112, base[1] + " x"), row(113, base[1].upper())]
    rows += [row(120, "\n".join([base[2], base[3], base[2]])), row(121, prose(rng, 6000)),
             row(122, "ab" * 4000), row(123, "Ünïcödé 中文 😀 \x00 \x1c   \xa0 end\r\n next\x0bline\x0c")]
    rows += [row(130, base[4]), row(130, base[4]), row(130, base[5]), row(None, base[6]), row(None, None)]
    rows += [row(200 + i, f"{base[7]} {i % 3}") for i in range(40)]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def edits(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def groups(nodes, linked):
    """Smallest node that can be reached from each, over all pairs."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {n: root(n) for n in nodes}
