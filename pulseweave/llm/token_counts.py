"""Token counts through a digest cache.

A content is known by the SHA-256 of its normalised text (null becomes empty; nothing else may change, or the count
would) and a tokenizer by the SHA-256 of its file. The cache is a Parquet table of content digest, tokenizer digest and
count. Contents that it lacks are taken once each, encoded and appended; counts then come from a join with the cache,
which sort-merges, so that a content that very many rows share is split among tasks.

Defined cases: null text counts as empty: 0 bytes and 0 tokens; repeated rows are encoded once and each keep their row; a
cache that has counts of other tokenizers is not confused by them; an empty table appends nothing; other columns go
through, those named like an output are replaced. Two runs that append the same content leave equal rows, taken once.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

SCHEMA = "content string, tokenizer string, n_tokens long"
#: White space with what follows it: no match of the byte-level tokenizers' patterns reaches over such a cut.
PIECE = regex.compile(r"\s*\S+|\s+")


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def cuts_at_space(form: dict) -> bool:
    """May texts be cut before white space without changing the ids: true of byte-level files with their own pattern, with no
    normal form or one that keeps to characters, and whose special strings hold no white space."""
    split, normal = form["pre_tokenizer"] or {}, form["normalizer"] or {}
    steps = split.get("pretokenizers", [split])
    own = [x.get("type") for x in steps] == ["ByteLevel"] and steps[0]["use_regex"] and not steps[0]["add_prefix_space"]
    plain = all(x["type"] in ("NFC", "Lowercase") for x in normal.get("normalizers", [normal]) if x)
    return own and plain and not any(c.isspace() for x in form["added_tokens"] for c in x["content"]) and not any(x["lstrip"] or x["rstrip"] for x in form["added_tokens"])


class PieceCounts:
    """piece -> tokens, from the tokenizers library; special strings inside texts are handled as is its default.

    Pieces are texts cut before white space, or whole texts where the file does not allow that."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.table = C.WordTable(self.learn, np.int64)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split = PIECE.findall if cuts_at_space(json.loads(self.tokenizer.to_str())) else lambda text: [text]

    def learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for k in range(0, len(pieces), 5000):
            found += map(len, self.tokenizer.encode_batch_fast(pieces[k : k + 5000], add_special_tokens=False))
        return np.array(found), np.ones(len(found), np.int64)

    def counts(self, texts: list[str]) -> list[int]:
        found, at = self.table.look_up(self.split, texts)
        return np.diff(np.concatenate([[0], np.cumsum(found)])[at]).tolist()


class SentencePieceCounts:
    """The same for .model files; whole texts are encoded, as their white space carries over."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]


_LOADED: dict[str, object] = {}


def counter(path: str):
    if path not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _LOADED[path] = SentencePieceCounts(path) if path.endswith(".model") else PieceCounts(path)
    C.alone(*[t for t in [getattr(_LOADED[path], "table", None)] if t])
    return _LOADED[path]


def count_tokens(docs: DataFrame, path: str, cache: str, limit: int = 1024) -> DataFrame:
    """The documents with n_bytes, n_tokens and over_limit. `cache` is a folder all executors share; it may not exist yet."""
    spark = docs.sparkSession
    C.small_batches(spark)
    version = file_digest(path)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        spark.createDataFrame([], SCHEMA).write.parquet(cache)

    def stored() -> DataFrame:
        return spark.read.schema(SCHEMA).parquet(cache).where(F.col("tokenizer") == version).select("content", "n_tokens")

    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    content = F.sha2(whole.cast("binary"), 256)
    missing = docs.select(content.alias("content"), whole.alias("text")).join(stored().select("content"), "content", "left_anti")
    missing = missing.dropDuplicates(["content"])

    def make():
        tool = counter(path)
        return lambda texts: [tool.counts(texts)]

    new = C.map_rows(missing, make, [T.StructField("n_tokens", T.LongType())], drop=("text",), table=True)
    new.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    key = C.free_name(docs, "content")
    columns = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit", "text")]
    keyed = docs.select(*[F.col(f"`{c}`") for c in columns], content.alias(key), F.octet_length(whole).cast("long").alias("n_bytes"))
    known = stored().groupBy("content").agg(F.max("n_tokens").alias("n_tokens")).withColumnRenamed("content", key)
    tables = C.Scratch(spark, "counts")
    out = keyed.join(tables.save(known), key).drop(key)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
