"""The queries opN_<name>: each operator over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, language, media, near_dedup, quality, secrets, substring_dedup, token_counts, token_files
from .common import crc, documents, shared_dir


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each benchmark item in each document that has it."""
    found = decontaminate.find_items(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.item_id", "hit.distance", "hit.word_end", "hit.item_words")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = crc(F.col("doc_id")) % 5 == 0
    model = quality.train(docs.where(~held_out), spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out))
    return quality.score_quality(docs.withColumn("held_out", F.coalesce(held_out, F.lit(False))), model).select("doc_id", "held_out", "score", "predicted")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = crc(F.col("doc_id")) % 4 == 2
    model = language.train(docs.where(~held_out))
    return language.identify(docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text"), model).drop("text")


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return token_files.read_tokens(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    return token_counts.count_tokens(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), cache)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link_components(documents(spark, sf_dir), size=3, percent=85)


def op10_media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_secret_scan, op3_decontaminate, op4_quality, op5_language_id, op6_bpe_round_trip, op7_token_files, op8_token_counts, op9_near_dedup, op10_media_clips)}

#: All windows by SQL would be slow on whole tables, models and tokenizers have no SQL: those are tested against brute force.
ORACLE_SQL: dict[str, str] = {}
