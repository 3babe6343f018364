import random

import edge
import pytest
from pyspark.sql import functions as F

from loadcast.llm import lines


def brute(rows, min_chars=lines.MIN_CHARS, k=lines.THRESHOLD):
    """Cleaned text of each (id, text), with counts, over all pairs of distinct lines."""
    places = {}
    docs = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert len({d[0] for d in docs}) == len(docs), "the order of equal ids is by hash"
    for i, text in docs:
        for p, line in enumerate(text.split("\n")):
            if edge.words(line):
                places.setdefault(line, (i is not None, i or 0, p))
    links = {a: [b for b in places if a != b and abs(len(a) - len(b)) <= k and edge.edits(a, b) <= k
                 and min(len(a), len(b)) >= min_chars] for a in places}
    out = {}
    for i, text in docs:
        kept, equal, near, n = [], 0, 0, 0
        for p, line in enumerate(text.split("\n")):
            place = (i is not None, i or 0, p)
            first = places.get(line)
            n += len(links.get(line, ()))
            if first is not None and first != place:
                equal += 1
            elif any(places[b] < first for b in links.get(line, ())):
                near += 1
            else:
                kept.append(line)
        out[i] = ("\n".join(kept) if equal or near else text, equal, near, n)
    return out


def typo(rng, line):
    at = rng.randrange(len(line))
    return rng.choice([line[:at] + line[at + 1 :], line[:at] + "q" + line[at:], line[:at] + "z" + line[at + 1 :]])


def corpus(seed, n=40, pool=12):
    rng = random.Random(seed)
    base = [edge.prose(rng, rng.randrange(4, 14)) for _ in range(pool)]
    rows = []
    for i in range(n):
        some = []
        for _ in range(rng.randrange(1, 6)):
            line = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                line = typo(rng, line)
            some.append(line)
        rows.append(edge.row(i, "\n".join(some)))
    return rows + [edge.row(900, None), edge.row(901, ""), edge.row(902, "\n\n"), edge.row(None, base[0]),
                   edge.row(903, "é" * 40 + "\n" + "é" * 39 + "😀"), edge.row(904, "short\n \t\nshort\nshots"),
                   edge.row(905, "short\n \t\n" + "x" * 29 + "\n" + "x" * 30)]


@pytest.mark.parametrize("threshold,cell_pairs", [(1, 64), (1, 2), (2, 64), (3, 64)])
def test_matches_all_pairs(spark, threshold, cell_pairs):
    rows = corpus(threshold * 10 + cell_pairs)
    found = lines.dedup_lines(edge.frame(spark, rows), threshold=threshold, cell_pairs=cell_pairs).collect()
    got = {r.doc_id: (r.text, r["_lines_equal"], r.lines_near, r.line_links) for r in found}
    want = brute(rows, k=threshold)
    assert len(found) == len(rows) and got.pop(900) == (None, 0, 0, 0)
    assert got == want


def test_crowded_entries_find_the_same(spark):
    """Many one-letter variants of one line: their segments are crowded whatever the limit."""
    line = "this is the line that everybody copies and changes a little"
    rows = [edge.row(i, line[:i] + "#" + line[i + 1 :] if i % 2 else line[:i] + line[i + 1 :]) for i in range(len(line))]
    rows += [edge.row(1000, line), edge.row(1001, line + "\n" + line)]
    got = {r.doc_id: (r.text, r["_lines_equal"], r.lines_near, r.line_links)
           for r in lines.dedup_lines(edge.frame(spark, rows), cell_pairs=4).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("k", [0, 1, 2, 4])
def test_automaton_is_the_edit_distance(spark, k):
    rng = random.Random(k)
    pairs = [("", ""), ("a", ""), ("", "ab"), ("kitten", "sitting"), ("äöü😀", "äöü"), ("abc", "abc")]
    for _ in range(150):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(12)))
        b = a
        for _ in range(rng.randrange(5)):
            b = typo(rng, b or "x")
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lines.within("a", "b", k).alias("near"))
    assert [(r.a, r.b) for r in df.collect() if bool(r.near) != (edge.edits(r.a, r.b) <= k)] == []


def test_repeated_rows_and_columns(spark):
    docs = edge.frame(spark)
    found = lines.dedup_lines(docs)
    assert found.columns == [*docs.columns, "_lines_equal", "lines_near", "line_links"]
    assert found.count() == docs.count()
    twins = found.where("doc_id = 130").select("text").collect()
    # their lines stand in documents 4 and 5 already
    assert [r.text for r in twins] == [""] * 3


def test_empty_table(spark):
    assert lines.dedup_lines(edge.frame(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    df = lines.dedup_lines(edge.frame(spark)).select("text", F.length("text"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
