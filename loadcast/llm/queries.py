"""Each operator applied to its whole test table; ``corpus_pipeline`` adds the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (exact, idfiles, language, licences, lines, negatives, packing, pieces, quality, simhash, toxicity, urls,
               whitening)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    found = pieces.encoded(_table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_pieces", F.crc32("ids").alias("ids_crc32"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_exact(spark: SparkSession, folder: str) -> DataFrame:
    schema = _table(spark, folder, "documents").schema
    found = exact.exact_duplicates(spark, f"{folder}/documents.parquet", schema)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.quality(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", "kept")


def op4_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(_table(spark, folder, "documents"))


def op5_id_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    manifest = idfiles.write(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, idfiles.new_folder(spark))
    return idfiles.read(manifest, "bigint")


def op6_lines(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.dedup_lines(_table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "lines_equal", "lines_near", "line_links",
                        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.packed(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


#: Rules of the URL query: host, path, verdict.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op8_urls(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(_table(spark, folder, "pages"), rules)


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    found = language.language(docs, language.train(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex16().alias("fingerprint"), "component_id")


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found = whitening.whiten(_table(spark, folder, "embeddings"), 4)
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    found = toxicity.toxicity(docs, toxicity.train(docs, _table(spark, folder, "labels")))
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op13_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, folder, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return negatives.mine(vectors, "i % 50 = 0", positives=5, negatives=3, low=50, high=95)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pieces": op1_pieces,
    "op2_exact": op2_exact,
    "op3_quality": op3_quality,
    "op4_licences": op4_licences,
    "op5_id_files": op5_id_files,
    "op6_lines": op6_lines,
    "op7_packing": op7_packing,
    "op8_urls": op8_urls,
    "op9_language": op9_language,
    "op10_simhash": op10_simhash,
    "op11_whitening": op11_whitening,
    "op12_toxicity": op12_toxicity,
    "op13_negatives": op13_negatives,
}
