"""Registered queries against their SQL, and the pipeline stage by stage."""

import random

import corpus_pipeline
import pyarrow as pa
import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from loadcast.llm import simhash
from loadcast.llm.common import steps
from loadcast.llm.filters import bitmap_of, maybe_in, split_by
from loadcast.llm.oracles import ORACLES
from loadcast.llm.queries import QUERIES


@pytest.mark.parametrize("name", ORACLES)
def test_same_values(spark, folder, name):
    assert difference(spark, connect(folder), QUERIES[name], ORACLES[name], folder) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES and n != "op11_whitening"])
def test_one_row_per_document(spark, folder, name):
    found = QUERIES[name](spark, folder)
    ids = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id")
    assert found.select("doc_id").distinct().exceptAll(ids).isEmpty() and ids.exceptAll(found.select("doc_id").distinct()).isEmpty()


def test_pipeline_by_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before, tables = docs, [docs]
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, folder).cache()
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert after.columns == docs.columns, name
            assert after.select("doc_id").exceptAll(before.select("doc_id")).isEmpty(), name
            assert 0 < after.count() <= before.count()
        tables.append(after)
        before = after
    und = docs.where("text IS NULL OR NOT text RLIKE '\\\\p{L}'").select("doc_id")
    assert tables[1].join(und, "doc_id").isEmpty()
    prints = simhash.near_duplicates(tables[3])
    assert prints.select("component_id").distinct().count() == tables[4].count()
    assert tables[5].select("doc_id").distinct().count() == tables[4].count()
    assert tables[3].where("n_chars <> length(text)").isEmpty()
    run = corpus_pipeline.run(spark, folder)
    assert run.drop("sequence_id").exceptAll(tables[5].drop("sequence_id")).isEmpty() and run.count() == tables[5].count()


def test_bitmap_lets_all_keys_pass(spark):
    keys = spark.range(0, 5000, 7).withColumnRenamed("id", "k")
    rows = spark.range(5000).withColumnRenamed("id", "k")
    passed = maybe_in(rows, bitmap_of(keys, "k"), "k")
    assert keys.exceptAll(passed).isEmpty() and passed.count() < 800
    yes, no = split_by(rows, bitmap_of(keys, "k"), "k")
    assert yes.count() + no.count() == 5000 and no.join(keys, "k").isEmpty()
    none = bitmap_of(keys.where("k < 0"), "k")
    assert maybe_in(rows, none, "k").isEmpty() and split_by(rows, none, "k")[1].count() == 5000
    full = bitmap_of(spark.range(200).select(F.col("id").alias("k")), "k", bits=16)
    assert maybe_in(rows.where("k < 200"), full, "k", bits=16).count() == 200


@pytest.mark.parametrize("limit", [1, 7, 100, 10_000])
def test_steps_keep_all_rows_in_order(limit):
    rng = random.Random(limit)
    texts = [None if rng.random() < 0.1 else "é" * rng.choice([0, 0, 1, 3, 40]) for _ in range(200)]
    table = pa.table({"n": list(range(200)), "t": pa.array(texts, pa.string())})
    made = list(steps(iter(table.to_batches(max_chunksize=9)), 1, limit))
    assert [x for b in made for x in b.column(0).to_pylist()] == list(range(200))
    assert [x for b in made for x in b.column(1).to_pylist()] == texts
    sizes = [[len((x or "").encode()) for x in b.column(1).to_pylist()] for b in made]
    assert all(sum(s) <= limit or len([x for x in s if x]) == 1 for s in sizes) and all(sizes)
