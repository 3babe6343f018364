"""Toxicity by compression distance: held-out accuracy on the given labels, and awkward texts."""

import random
import zlib

import edge
import pytest
from pyspark.sql import functions as F

from loadcast.llm import toxicity
from loadcast.llm.queries import QUERIES

BAD = ["scumbag", "moronic", "worthless", "vequance", "loweident"]


def corpus(seed=2, n=700):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = edge.prose(rng, rng.randint(5, 200)).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(rng.randint(2, 6)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(BAD))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def model(rows):
    return toxicity.fit([t for _, t, _ in rows], [y for _, _, y in rows])


def test_words_that_mark():
    rows = corpus()
    marks = toxicity.marking_words([t for _, t, y in rows if y], [t for _, t, y in rows if not y])
    assert set(marks) == set(BAD)
    copies = ["one odd passage copied again and again"] * 40
    assert not toxicity.marking_words(copies, [t for _, t, y in rows if not y])


def test_separates_texts_not_seen():
    found = model(corpus(2))
    rows = corpus(9)
    scores = found.scores([t.encode() for _, t, _ in rows])
    caught = [s >= toxicity.CUT for s, (_, _, y) in zip(scores, rows, strict=True) if y]
    wrong = [s >= toxicity.CUT for s, (_, _, y) in zip(scores, rows, strict=True) if not y]
    assert sum(caught) > 0.95 * len(caught) and sum(wrong) < 0.03 * len(wrong)
    assert scores.min() >= 0 and scores.max() <= 1


def test_windows_cover_whole_texts():
    text = " ".join(["word"] * 20 + ["x" * 500] + ["Ünïcödé"])
    found = toxicity.windows(text)
    assert b"".join(w.replace(b" ", b"") for w in found).decode() == text.lower().replace(" ", "")
    assert max(map(len, found)) < 1000 and toxicity.windows(" \t\n") == []


def test_toxic_words_count_wherever_they_stand():
    found = model(corpus())
    clean = edge.prose(random.Random(1), 30_000)
    low, high = found.scores([clean.encode(), f"{clean} {BAD[0]} {edge.prose(random.Random(2), 9)} {BAD[1]}".encode()])
    assert low < toxicity.CUT <= high


@pytest.mark.parametrize("rows", [[], [("a b c", 1)], [("a b c", 0)], [("a b c", 0), ("a b c", 1)], [("", 0), ("", 1)]])
def test_nothing_to_learn_from(rows):
    found = toxicity.fit([t for t, _ in rows], [y for _, y in rows])
    assert found.scores([b"", b"any text"]).tolist() == [0, 0]


def test_awkward_documents(spark):
    docs = edge.frame(spark)
    result = toxicity.toxicity(docs, model(corpus())).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in result) == sorted(
        (r.doc_id is None, r.doc_id or 0) for r in docs.collect())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in result)
    lowest = min(r.score for r in result)
    assert {r.score for r in result if r.doc_id in (100, 101, 102, 103)} == {lowest}
    assert toxicity.toxicity(docs.where("false"), toxicity.NOTHING).isEmpty()


def test_training_reads_a_bounded_sample_outside_the_held_out_rows(spark, monkeypatch):
    rows = corpus(4, 300)
    docs = spark.createDataFrame([*rows, *rows[:20], (None, "no id", 1), (5000, None, 1)], "doc_id long, text string, y int")
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 50 != 3, F.col("y")).alias("toxic"), F.lit("x").alias("text"))
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda texts, marks: seen.update(texts=texts, marks=marks))
    toxicity.train(docs.select("doc_id", "text"), labels.union(labels.limit(5)), toxic_texts=30, ordinary_texts=40)
    assert seen["marks"].count(1) == 30 and seen["marks"].count(0) == 40
    held = {t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    assert not held & set(seen["texts"]) and len(seen["texts"]) == 70
    toxicity.train(docs.select("doc_id", "text").where("false"), labels)
    assert seen == {"texts": [], "marks": []}


def test_held_out_accuracy_of_the_query(spark):
    folder = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    found = QUERIES["op12_toxicity"](spark, folder).join(truth, "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    toxic = [r for r in found if r.toxic]
    clean = [r for r in found if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.7 * len(toxic) and sum(r.predicted for r in clean) <= 0.05 * len(clean)
    higher = sum((a.score > b.score) + (a.score == b.score) / 2 for a in toxic for b in clean)
    assert higher >= 0.85 * len(toxic) * len(clean)
