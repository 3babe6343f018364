"""A training corpus from raw documents: five stages, each applied to what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.llm import language, lines, packing, quality, simhash
from loadcast.llm.common import stored


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; null texts, texts without letters and unsure ones go.

    Without labelled documents no language is known and all go; an empty table gives an empty one.
    """
    return language.in_known_language(docs, language.train(docs))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null and empty texts go; an empty table gives an empty one."""
    return quality.good(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in an earlier one; those that lose all their words go.

    Null texts and texts without a word go too. Column ``n_chars`` follows the text; a table without it has no need.
    """
    texts = lines.dedup_lines(docs).select(docs.columns).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" not in docs.columns:
        return texts
    return texts.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by SimHash fingerprints, the one with the smallest id.

    Documents without a word have equal fingerprints and link like others; those without an id stay; an empty table
    gives an empty one.
    """
    return simhash.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of related ones, with their ids as little-endian 32-bit numbers."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), 2)


STAGES = [
    ("language", keep_known_languages),
    ("quality", keep_good),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", one_of_each),
    ("packing", pack),
]

#: SQL cannot state a trained model, so the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn on ``documents``; each result is written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
