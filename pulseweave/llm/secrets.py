"""Secrets in texts: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Two order-2 character models are trained from labelled samples: strings drawn from the alphabets of keys, with the
values that the patterns find in a bounded sample of the documents' tokens (label secret), and the sample's identifiers
and words of letters, signs and at most a short number behind (label ordinary). A token of LEAST characters or more whose mean log-likelihood ratio a character is over
a margin is a further span, kind `model`; margin: that of all but RARE of the ordinary training tokens, but no more than
a twentieth of the secret ones lie under, and 0 at least.

Defined cases: null text is empty; no span gives counts of 0 and the digest of an empty string; spans of different
kinds may overlap; a model span never overlaps a pattern's (of a token that does, the parts outside are scored); a table with nothing to train from leaves the built-in
ordinary sample; other columns go through, those named like an output are replaced.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: The patterns of the contract.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: What is sampled, and what of it is labelled ordinary: letters and signs, then a short number at most.
SAMPLE = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
PLAIN = re.compile(r"[A-Za-z+/_=-]+[0-9]{0,4}")
KINDS = ("assign", "access", "hex")

#: Bounds of the training sample (tokens; texts they are from, and characters of a text) and of the model.
SAMPLE_TEXTS, LONGEST = 20_000, 20_000
SAMPLE_TOKENS, DRAWN, LEAST, RARE = 20_000, 4_000, 16, 0.0005
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.full(128, 0, np.int64)
for _i, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _i + 1
SIZE = len(ALPHABET) + 1
ORDINARY = ["configuration_value", "applicationContext", "transformation_matrix", "user_identifier_name", "createdTimestampUtc", "international-standards", "src/main/resources/index", "============================", "--------------------------------", "________________________"]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX_LONG.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


class Covered:
    """Places under spans, which come by start."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        self.starts, self.ends = [], []
        for a, z, _ in spans:
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(z, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(z)

    def outside(self, a: int, z: int) -> list[tuple[int, int]]:
        """The parts of [a, z) that no span covers."""
        out, i = [], bisect_right(self.ends, a)
        while i < len(self.starts) and self.starts[i] < z:
            if a < self.starts[i]:
                out.append((a, self.starts[i]))
            a = self.ends[i]
            i += 1
        return [*out, (a, z)] if a < z else out


def _grams(token: str) -> np.ndarray:
    c = np.concatenate([[0, 0], _CODE[np.frombuffer(token.encode("ascii"), np.uint8)]])
    return (c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:]


class MarkovRatio:
    """Log-likelihood ratio of random strings to ordinary ones under order-2 character models, interpolated with order 1."""

    def __init__(self, secret: list[str], ordinary: list[str]):
        self.table = (self._model(secret) - self._model(ordinary)).ravel()
        scores, wanted = sorted(map(self.score, ordinary)), sorted(map(self.score, secret))
        usual = scores[min(len(scores) - 1, int(len(scores) * (1 - RARE)))] if scores else 0.0
        self.margin = max(0.0, min(usual, wanted[len(wanted) // 20]) if wanted else usual)  # unlabelled secrets may pass for ordinary

    @staticmethod
    def _model(tokens: list[str]) -> np.ndarray:
        n = np.zeros(SIZE**3)
        for t in tokens:
            np.add.at(n, _grams(t), 1)
        n = n.reshape(SIZE, SIZE, SIZE)
        one = n.sum((0, 1)) + 1
        one = one / one.sum()
        two = n.sum(0) + 8 * one
        two = two / two.sum(1, keepdims=True)
        three = n + 8 * two[None]
        return np.log(three / three.sum(2, keepdims=True))

    def score(self, token: str) -> float:
        return float(self.table[_grams(token)].mean())

    def secret(self, token: str) -> bool:
        return self.score(token) > self.margin

    def spans(self, text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        covered = Covered(taken)
        found = [part for m in TOKEN.finditer(text) for part in covered.outside(m.start(), m.end())]
        return [(a, z, "model") for a, z in found if z - a >= LEAST and self.secret(text[a:z])]


def drawn_secrets(n: int = DRAWN) -> list[str]:
    rng = random.Random(11)
    kinds = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ALPHABET[:62], ALPHABET[:64], "abcdefghijklmnopqrstuvwxyz0123456789"]
    return ["".join(rng.choices(kinds[i % len(kinds)], k=rng.randint(16, 48))) for i in range(n)]


def _label(texts: list[str | None]) -> list[list[list[dict]]]:
    out = []
    for text in texts:
        covered, found = Covered(base_spans(text or "")), []
        for m in SAMPLE.finditer(text or ""):
            hit = covered.outside(*m.span()) != [m.span()]
            if hit or PLAIN.fullmatch(m[0]):  # else of unknown label
                found.append({"token": m[0][:64], "secret": hit})
        out.append(found)
    return [out]


def train(docs: DataFrame, text: str = "text", tokens: int = SAMPLE_TOKENS, texts: int = SAMPLE_TEXTS) -> MarkovRatio:
    """Fits both models on at most `tokens` distinct tokens, those with the least hashes, of about `texts` distinct texts,
    also those with the least hashes (a longer one's first LONGEST characters); the rest is drawn or built in."""
    kind = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("secret", T.BooleanType())]))
    some = docs.select(F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    some = C.least_hashes(some, texts // C.SPARE, []).withColumn("text", F.substring("text", 1, LONGEST)).dropDuplicates(["h"]).select("text")
    found = C.map_rows(some, lambda: _label, [T.StructField("tokens", kind)], drop=("text",))
    found = found.select(F.explode("tokens").alias("t")).groupBy("t.token").agg(F.max("t.secret").alias("secret"))
    rows = found.orderBy(F.xxhash64("token"), "token").limit(tokens).collect()
    secret = [r["token"] for r in rows if r["secret"]]
    ordinary = [r["token"] for r in rows if not r["secret"]]
    return MarkovRatio(drawn_secrets() + [t.split("=", 1)[-1] or t for t in secret], ordinary + ORDINARY)


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{z}" for a, z, k in spans)


def find_spans(text: str | None, model: MarkovRatio) -> tuple[list, list]:
    """Pattern spans, and all spans, both by start, then kind."""
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + model.spans(text, base), key=lambda x: (x[0], (*KINDS, "model").index(x[2])))


def scan_secrets(docs: DataFrame, model: MarkovRatio | None = None) -> DataFrame:
    """The documents with n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined) and n_model."""
    C.small_batches(docs.sparkSession)
    model = model or train(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)  # two tables of SIZE^3 numbers

    def make():
        model = held.value

        def run(texts):
            cols: list[list] = [[], [], [], [], [], []]
            for t in texts:
                base, every = find_spans(t, model)
                kinds = [k for _, _, k in base]
                row = [*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)]
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            return cols

        return run

    kinds = [T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")]
    return C.map_rows(docs, make, [*kinds, T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_model", T.LongType())])


def redact(docs: DataFrame, model: MarkovRatio | None = None, mark: str = "[secret]") -> DataFrame:
    """The documents with every span replaced by `mark` in `text`, and n_chars made to fit where there is such a column."""
    C.small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def make():
        model = held.value

        def run(texts):
            out = []
            for t in texts:
                parts, at = [], 0
                for a, z, _ in find_spans(t, model)[1]:
                    if a >= at:
                        parts += [t[at:a], mark]
                    at = max(at, z)
                out.append(None if t is None else "".join([*parts, t[at:]]))
            return [out]

        return run

    name = C.free_name(docs, "original_text")
    out = C.map_rows(docs.withColumn(name, F.col("text")), make, [T.StructField("text", T.StringType())], text=name, drop=(name,))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
