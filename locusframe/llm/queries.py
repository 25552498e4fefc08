"""Registered queries of the pipeline operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm import byte_bpe, class_lm, language_id, near_dedup, packing, passage_dedup, preferences, ranked_search, sharding, spelling, token_files, vector_search
from locusframe.llm.common import scratch_folder, table
from locusframe.llm.exact_dedup import exact_duplicates


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents"))


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.encode(table(spark, folder, "documents"), path, pattern, round_trip=True).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, folder, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op5_passage_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return passage_dedup.repeated_passages(table(spark, folder, "documents"))


def op6_preferences(spark: SparkSession, folder: str) -> DataFrame:
    turns = preferences.clean_turns(table(spark, folder, "conversations"))
    return preferences.preference_rows(turns, preferences.pair_by_opening(turns))


def op7_class_lm(spark: SparkSession, folder: str) -> DataFrame:
    return class_lm.score_documents(table(spark, folder, "documents"))


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(table(spark, folder, "documents"))


def op9_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


def op10_vector_search(spark: SparkSession, folder: str) -> DataFrame:
    return vector_search.search(table(spark, folder, "embeddings"))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"))


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_token_files(spark: SparkSession, folder: str) -> DataFrame:
    target = scratch_folder(spark)
    token_files.write_token_files(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), target)
    return token_files.read_documents(spark, target).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_byte_bpe, op3_packing, op4_sharding,
                                   op5_passage_dedup, op6_preferences, op7_class_lm, op8_language_id, op9_near_dedup, op10_vector_search,
                                   op11_spelling_variants, op12_ranked_search, op13_token_files)}
