import hashlib
import re

import edge
import pytest
from pyspark.sql import functions as F

from loadcast.llm import exact
from loadcast.session import shared_folder


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.fixture()
def folder(spark):
    return shared_folder(spark, "exact-test")


def write(spark, rows, path, files=3):
    edge.frame(spark, rows).repartition(files).write.mode("append").parquet(path)


def check(found, rows):
    first, size = {}, {}
    for r in rows:
        key = normal(r[1])
        size[key] = size.get(key, 0) + 1
        first[key] = min(first.get(key, (r[0] is not None, r[0])), (r[0] is not None, r[0]), key=lambda x: (x[0], x[1] or 0))
    by_id = {}
    for r in rows:
        by_id.setdefault((r[0], hashlib.sha256(normal(r[1]).encode()).digest()), normal(r[1]))
    assert len(found) == len(rows)
    return first, size, by_id


@pytest.mark.parametrize("files_per_batch", [1, 100])
def test_matches_grouping(spark, folder, files_per_batch):
    rows = edge.documents()
    write(spark, rows, folder)
    found = exact.exact_duplicates(spark, folder, edge.frame(spark, []).schema, files_per_batch=files_per_batch).collect()
    first, size, text = check(found, rows)
    for r in found:
        key = text[r.doc_id, bytes(r.digest)]
        assert (r.keep_id, r.group_size) == (first[key][1], size[key])
    assert sum(r.kept for r in found) == len(first)


def test_weak_digest_is_mended_by_the_bytes(spark, folder):
    """Half a byte of digest makes most texts collide; groups must still be those of equal texts."""
    rows = edge.documents()
    write(spark, rows, folder)
    weak = lambda c: F.concat(F.lit("0"), F.substring(F.sha2(c, 256), 1, 1))
    found = exact.exact_duplicates(spark, folder, edge.frame(spark, []).schema, digest=weak).collect()
    first, size, _ = check(found, rows)
    want = sorted((r[0] or -1, first[normal(r[1])][1] or -1, size[normal(r[1])]) for r in rows)
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size) for r in found) == want
    assert sum(r.kept for r in found) == len(first)


def test_state_survives_and_takes_new_files(spark, folder):
    schema = edge.frame(spark, []).schema
    write(spark, [edge.row(5, "same text"), edge.row(6, "other")], folder, 1)
    stream = exact.ExactDedup(spark, folder, schema)
    stream.ingest()
    write(spark, [edge.row(2, "same  text"), edge.row(9, "same\ttext")], folder, 1)
    again = exact.ExactDedup(spark, folder, schema, checkpoint=stream.checkpoint)
    again.ingest()
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in again.result().collect()}
    assert got == {5: (2, 3, False), 2: (2, 3, True), 9: (2, 3, False), 6: (6, 1, True)}


def test_empty_table_and_single_file(spark, folder):
    write(spark, [], folder, 1)
    assert exact.exact_duplicates(spark, folder, edge.frame(spark, []).schema).count() == 0


def test_settings_are_put_back(spark, folder):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    write(spark, [edge.row(1, "x")], folder, 1)
    exact.exact_duplicates(spark, folder, edge.frame(spark, []).schema).count()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
