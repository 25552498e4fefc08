"""Corpus cleaning in stages; each is written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm import exact_dedup, language_id, near_dedup, packing, passage_dedup
from locusframe.llm.common import cut_compressed, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the rows with a language; texts whose language can't be told (no letters, hardly a guess) go."""
    return language_id.drop_unidentified(docs, language_id.fit(docs))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, similarity of 0.8 or more)."""
    return near_dedup.drop_near_duplicates(docs, percent=80, bands=40, rows=5)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds go; ``n_chars`` follows the text."""
    kept = passage_dedup.drop_repeated_passages(docs)
    return kept.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: doc_id, doc_tokens, start, length, ids, sequence_id, offset."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact),
    ("MinHash near-dedup", drop_near),
    ("substring dedup", drop_passages),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_compressed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language ID, shingle sets and packing have no SQL form; tests/llm compare the stages with brute force.
ORACLE_SQL = None
