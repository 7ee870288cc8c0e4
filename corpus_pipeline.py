"""A corpus pipeline of the llm operators. Each stage reads what the one before has written."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseweave.llm import bpe, decontaminate, language, near_dedup, secrets
from pulseweave.llm.common import Scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without a letter, which language identification rejects, go: null, empty, digits and
    signs only. Without a language to learn from all go. Repeated rows go or stay alike; the doc_id may be null."""
    model = language.train(docs)
    return language.identify(docs, model).where("lang_pred <> 'und'").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more), that of least doc_id.

    Rows that repeat a doc_id are one document: the row of the least hash among those with words stays. Rows without a
    doc_id and documents without words link to nothing and stay."""
    tables = Scratch(spark, "gone")
    gone = near_dedup.link_components(docs, size=5, percent=80).where("not kept").select("doc_id").distinct()
    kept = docs.join(tables.save(gone), "doc_id", "left_anti").select(*docs.columns)
    again = tables.save(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    blank = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    first = F.min(F.struct(blank.alias("blank"), F.xxhash64("text").alias("h"), F.struct(*docs.columns).alias("row")))
    once = kept.join(again, "doc_id").groupBy("doc_id").agg(first.alias("first")).select("first.row.*")
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).union(once.select(*docs.columns))


def drop_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item (edit distance in words of at most a fifth of the item). Null and empty texts hold
    none and stay, with an empty benchmark all do; repeated rows go or stay alike."""
    return decontaminate.find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(F.size("hits") == 0).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars made to fit; a null text stays null."""
    return secrets.redact(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a document: doc_id, n_tokens and the digests of ids and of the bytes decoded from them; a null text has no ids."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_documents(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN).drop("text")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark_items),
    ("secret_scan", redact_secrets),
    ("bpe_encode", encode_tokens),
]

#: Models, components and merges have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = tables.save(docs)
    return docs
