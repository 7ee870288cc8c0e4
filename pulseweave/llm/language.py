"""Language identification by error-correcting output codes.

Every language has a codeword of bits, chosen so that codewords lie far apart. For each bit a binary classifier on
hashed byte 1- to 3-grams (lower case, digits and signs as spaces, square roots of shares) predicts the bit's sign.
Decoding takes the codeword with the least weighted logistic loss over the bits, the weight being a bit's accuracy
above chance on training texts left out of its fit. The text is ambiguous if the two best codewords' losses are close.

Defined cases: null text and text without a letter are `und` with score 0; no language to learn gives `und` for all; one
language gives it for every text with a letter; rows of equal text get equal results; other columns go through, those
named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Bounds of the training sample: documents of a language (least hashes) and their characters; languages at most.
PER_LANGUAGE, CHARACTERS, LANGUAGES = 400, 2_000_000, 100
LONGEST = CHARACTERS // 10  # of a longer text its beginning is learned, so that no text takes the place of all others
FEATURES, LEAST_BITS, STEPS, AMBIGUOUS = 2048, 15, 120, 0.02
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features(text: str) -> np.ndarray:
    b = np.frombuffer((" " + " ".join(text.lower().encode().translate(_LETTERS).decode().split()) + " ").encode(), np.uint8).astype(np.uint32)
    n = np.zeros(FEATURES)
    codes = [b * np.uint32(2654435761)]
    if len(b) > 1:
        two = b[:-1] * np.uint32(256) + b[1:]
        codes.append((two + np.uint32(1 << 24)) * np.uint32(2654435761))
        if len(b) > 2:
            codes.append((two[:-1] * np.uint32(256) + b[2:] + np.uint32(1 << 25)) * np.uint32(2246822519))
    for c in codes:
        n += np.bincount((c >> np.uint32(21)).astype(np.int64), minlength=FEATURES)
    return np.sqrt(n / n.sum()).astype(np.float32)


def codewords(classes: int, seed: int = 5) -> np.ndarray:
    """classes rows of -1 and 1: greedily, the random word farthest from those chosen; no bit is the same for all."""
    bits = max(LEAST_BITS, 4 * max(1, classes - 1).bit_length())
    rng = np.random.default_rng(seed)
    words = [rng.choice([-1, 1], bits)]
    while len(words) < classes:
        some = rng.choice([-1, 1], (200, bits))
        words.append(some[np.argmax((some[:, None] != np.array(words)[None]).sum(2).min(1))])
    out = np.array(words)
    for k in np.flatnonzero(np.abs(out.sum(0)) == classes):
        out[k % classes, k] *= -1
    return out


class OutputCodes:
    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        if len(self.langs) < 2:
            return
        rng = np.random.default_rng(3)
        rows, y = [], []
        for t, lang in zip(texts, langs, strict=True):
            words = t.split()
            pieces = [t]
            for size in (4, 12):  # short texts are to be told apart too
                at = int(rng.integers(0, max(1, len(words) - size)))
                pieces.append(" ".join(words[at : at + size]))
            for p in pieces:
                if any(map(str.isalpha, p)):
                    rows.append(features(p))
                    y.append(self.langs.index(lang))
        x, y = np.array(rows), np.array(y)
        self.codes = codewords(len(self.langs))
        held = np.arange(len(y)) % 5 == 4
        sign = self.codes[y].astype(np.float32)
        share = np.bincount(y, minlength=len(self.langs)).astype(np.float32)
        even = (len(y) / len(self.langs) / share[y])[~held]
        xt, st = x[~held], sign[~held]
        w, speed = np.zeros((FEATURES, self.codes.shape[1]), np.float32), 0
        bias = np.zeros(self.codes.shape[1], np.float32)
        for _ in range(STEPS):  # gradient steps with momentum on the logistic loss
            pull = st * (even[:, None] / (1 + np.exp(np.clip(st * (xt @ w + bias), -30, 30))))
            speed = 0.9 * speed + (xt.T @ pull) / len(xt) - 1e-5 * w
            w = w + 12 * speed
            bias = bias + 0.5 * pull.mean(0)
        self.w, self.bias = w, bias
        right = (np.sign(x[held] @ w + bias) == sign[held]).mean(0) if held.any() else np.ones(len(bias))
        self.weight = np.maximum(2 * right - 1, 0.05)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (share of its probability), ambiguous."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0, False
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        margin = np.clip(features(text) @ self.w + self.bias, -30, 30)
        loss = (self.weight * np.log1p(np.exp(-self.codes * margin))).sum(1) / self.weight.sum()
        best, second = np.argsort(loss, kind="stable")[:2]
        p = np.exp(-(loss - loss[best]) * len(self.weight))
        return self.langs[best], float(1 / p.sum()), bool(loss[second] - loss[best] < AMBIGUOUS)


def train(docs: DataFrame, sample: int = PER_LANGUAGE) -> OutputCodes:
    """Fits on at most `sample` documents of each language of the documents given, of the LANGUAGES with most texts; only
    text and lang are read."""
    known = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.withColumn("h", F.xxhash64("text")).withColumn("n", F.least(F.length("text"), F.lit(LONGEST)))
    some = C.least_hashes(known, sample, ["lang"], LANGUAGES).withColumn("text", F.substring("text", 1, LONGEST)).dropDuplicates(["lang", "h"])
    in_order = Window.partitionBy("lang").orderBy("h")  # over some times `sample` rows
    some = some.withColumn("rank", F.row_number().over(in_order)).withColumn("upto", F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = some.where((F.col("rank") <= sample) & (F.col("upto") <= CHARACTERS)).select("lang", "h", "text").collect()
    rows.sort(key=lambda r: (r["h"], r["lang"]))
    return OutputCodes([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: OutputCodes) -> DataFrame:
    """The documents with lang_pred, score and ambiguous."""
    C.small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights a bit

    def make():
        model = held.value
        return lambda texts: [list(c) for c in zip(*map(model.predict, texts), strict=True)] if texts else [[], [], []]

    return C.map_rows(docs, make, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
