import zlib
from itertools import product

import edge
import numpy as np
import pytest
from pyspark.sql import functions as F

from loadcast.llm import language


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return language.train(docs)


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(1)
    crf = language.Crf(["a", "b", "c"], np.zeros((1, 3)), {}, np.zeros((1, 3), bool), np.zeros((3, 3)), rng.normal(size=(3, 3)))
    lengths = np.array([4, 1, 5, 4])
    emissions = rng.normal(size=(lengths.sum(), 3)).astype(np.float32)
    found = crf.marginals(emissions, lengths)
    at = 0
    for n in lengths:
        want = np.zeros((n, 3))
        for path in product(range(3), repeat=int(n)):
            score = sum(emissions[at + t, k] for t, k in enumerate(path))
            score += sum(crf.transitions[a, b] for a, b in zip(path, path[1:]))
            for t, k in enumerate(path):
                want[t, k] += np.exp(score)
        assert np.allclose(found[at : at + n], want / want.sum(axis=1, keepdims=True), atol=1e-5)
        at += n


def test_held_out_accuracy(spark, docs, model):
    found = language.language(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.where(language.held_out() & F.col("lang").isNotNull())
    right, total = held.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert total > 200 and right / total > 0.97
    assert held.where("score < 0 OR score > 1").count() == 0


def test_held_out_rule(spark):
    ids = [0, 1, 17, 123456, -5]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id bigint").select("doc_id", language.held_out().alias("h"))
    assert {r.doc_id: r.h for r in got.collect()} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in ids}


def test_nothing_but_text_is_read_for_a_prediction(docs, model):
    blind = docs.select("doc_id", "text", F.lit("xx").alias("lang"), F.lit(None).cast("string").alias("source"))
    a, b = (language.language(d, model).orderBy("doc_id").collect() for d in (docs, blind))
    assert a == b


def test_held_out_rows_do_not_change_the_model(docs, model):
    other = docs.withColumn("lang", F.when(language.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    again = language.train(other)
    assert again.labels == model.labels and np.array_equal(again.weights, model.weights)


def test_code_switched_text(docs, model):
    texts = {r.lang: r.text for r in docs.where("lang IS NOT NULL AND length(text) > 500").limit(300).collect()}
    mixed = " ".join(" ".join(texts[k].split()[5:25]) for k in ("en", "fr", "de"))
    assert [name for name, words in model.spans(mixed) if len(words) > 5] == ["en", "fr", "de"]


def test_edges(spark, model):
    rows = edge.documents() + [edge.row(600, "123 456 !!"), edge.row(601, "中文"), edge.row(602, "² ½ Ⅷ _ ٣")]
    found = language.language(edge.frame(spark, rows), model).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (100, 102, 103, 600, 602))
    assert by[601].lang_pred in model.labels
    assert language.language(edge.frame(spark, []), model).count() == 0


def test_no_labelled_rows(spark):
    docs = edge.frame(spark, [edge.row(1, "some words", None)])
    model = language.train(docs)
    assert model.labels == [] and language.language(docs, model).first().lang_pred == "und"
    assert language.in_known_language(docs, model).count() == 0


def test_expected_transitions_match_enumeration():
    rng = np.random.default_rng(2)
    words = ["aa", "bb", "cc", "aa", "bb", "dd", "cc", "bb"]
    crf = language.Crf(["x", "y"], np.zeros((language.BUCKETS, 2)), {"aa": 1, "bb": 2, "cc": 3},
                       np.array([[0, 0], [1, 0], [1, 1], [0, 1]], bool), rng.normal(size=(2, 2)), rng.normal(size=(2, 2)))
    want = np.zeros((2, 2))
    for run in (words[:4], words[4:]):
        emissions = crf.emissions(run)
        total, part = 0.0, np.zeros((2, 2))
        for path in product(range(2), repeat=4):
            weight = np.exp(sum(emissions[t, k] for t, k in enumerate(path))
                            + sum(crf.transitions[a, b] for a, b in zip(path, path[1:])))
            total += weight
            for a, b in zip(path, path[1:]):
                part[a, b] += weight
        want += part / total
    assert np.allclose(language._expected_moves(crf, words, 2, 4), want, atol=1e-5)


def test_many_languages_and_repeated_ids(spark, monkeypatch):
    rng = np.random.default_rng(3)
    names = [f"l{k:03d}" for k in range(90)]
    rows = [(k * 100 + j, " ".join(f"{n[1:].translate(str.maketrans('0123456789', 'abcdefghij'))}{x}" for x in rng.choice(list("uvwxyz"), 12)), n)
            for k, n in enumerate(names) for j in range(4)]
    model = language.fit([t for _, t, _ in rows], [n for *_, n in rows], epochs=1)
    assert len(model.labels) == 90 and model.predict([rows[5][1].encode()])[0] == [rows[5][2]]
    seen = {}
    monkeypatch.setattr(language, "fit", lambda texts, langs: seen.update(texts=texts, langs=langs))
    monkeypatch.setattr(language, "MAX_LANGUAGES", 3)
    docs = spark.createDataFrame([*rows, *[(i, f"other {n}", "l007") for i in range(1, 25) for n in range(3)],
                                  *[(i, "more", "l009") for i in range(40, 60)]], "doc_id long, text string, lang string")
    language.train(docs, per_language=5)
    assert set(seen["langs"]) >= {"l007", "l009"} and len(set(seen["langs"])) == 3
    assert max(seen["langs"].count(n) for n in set(seen["langs"])) <= 5 and seen["langs"].count("l009") == 5


def test_every_labelled_text_is_learned_from(spark):
    """Long texts, more than a few hundred of a language, and words that one text alone has."""
    own = ["w" + "".join(chr(97 + int(d)) for d in f"{i:03d}") for i in range(400)]
    rows = [(4 * i, f"{w} ist hier und dort", "de") for i, w in enumerate(own)]
    rows += [(4 * i + 1, "la casa verde " * 2000, "es") for i in range(8)]
    rows += [(4 * i + 2, "here and there", "en") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = docs.where(~language.held_out())
    counts = {(r.l, r.w): r.n for r in language.word_counts(learned.selectExpr("text t", "lang l")).where("n > 0").collect()}
    want = {}
    for r in learned.collect():
        for w in r.text.split():
            want[r.lang, w] = want.get((r.lang, w), 0) + 1
    assert counts == want
    model = language.train(docs)
    assert model.labels == sorted({n for n, _ in want}) and "es" in model.labels and "casa" in model.lexicon
    assert sum(w in model.lexicon for w in own) > 200
    assert model.predict([b"la casa verde", b"hier und dort"])[0] == ["es", "de"]


def test_tasks_are_mixed_alike_however_rows_lie(spark, docs, monkeypatch):
    """Several tasks and blocks, with rows in another order and other partitions."""
    monkeypatch.setattr(language, "TASK_BYTES", 700_000)
    monkeypatch.setattr(language, "BLOCK_BYTES", 200_000)
    a, b = (language.train(d) for d in (docs, docs.orderBy("text").repartition(5)))
    assert a.labels == b.labels and np.array_equal(a.weights, b.weights) and np.array_equal(a.transitions, b.transitions)
    held = language.language(docs, a).join(docs.select("doc_id", "lang"), "doc_id").where(
        language.held_out() & F.col("lang").isNotNull())
    assert held.where("lang = lang_pred").count() / held.count() > 0.97
