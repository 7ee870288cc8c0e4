"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

Each stretch of STRETCH bytes of a text is compressed with both dictionaries. The normalised difference of the sizes, and
how far the lesser size falls under that of usual text (words over and over compress with either), are the evidence,
which a logistic fit on other labelled documents, weighted to the true share of labels, turns into a
probability that the label is 1. One half of the bounded training sample builds dictionaries, the other half calibrates.

Defined cases: null and empty text score the share of label 1; a label other than 0 and 1, or null, teaches nothing;
without both labels every text scores the share found (1/2 if none); several labels for one document all count;
repeated rows score alike; other columns go through, those named like an output are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: The training sample holds at most SAMPLE documents of each label, those with the least hashes, and SAMPLE_CHARS in all of them.
SAMPLE, SAMPLE_CHARS, STRETCH, DICTIONARY, LEVEL = 1000, 8_000_000, 512, 1 << 15, 3
LONGEST = SAMPLE_CHARS // 10  # of a longer text its beginning is learned, so that no text takes the place of all others


def stretches(data: bytes, size: int = STRETCH) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


def build_dictionary(samples: list[bytes]) -> bytes:
    pieces = [p for s in samples for p in stretches(s, 512) if len(p) >= 64]
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:  # too few samples: their plain text serves as the dictionary
        return b"".join(pieces)[-DICTIONARY:] or b" " * 8


class CompressionScore:
    def __init__(self, good: bytes, bad: bytes):
        self.dictionaries, self.line, self.share, self._tools = (good, bad), None, 0.5, None

    def __getstate__(self):
        return {**self.__dict__, "_tools": None}

    def evidence(self, text: str | None) -> tuple[float, float]:
        """Normalised difference of the two sizes, and how far the lesser falls under half of the text's size."""
        if self._tools is None:
            kind = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO) for d in self.dictionaries]
            for k in kind:
                k.precompute_compress(level=LEVEL)
            self._tools = [zstandard.ZstdCompressor(level=LEVEL, dict_data=k, write_checksum=False, write_content_size=False, write_dict_id=False) for k in kind]
        data = C.text_bytes(text)
        good, bad = (sum(len(tool.compress(s)) for s in stretches(data)) for tool in self._tools)
        return ((bad - good) / (bad + good), max(0.0, 0.5 - min(good, bad) / len(data))) if data else (0.0, 0.0)

    def calibrate(self, texts: list[str | None], labels: list[int], share: float) -> None:
        """Logistic fit of the label on the evidence, by Newton steps with a little shrinkage; weights restore `share`."""
        self.share = share
        y = np.array(labels, float)
        if not 0 < y.sum() < len(y):
            return
        x = np.array([self.evidence(t) for t in texts])
        centre, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
        z = np.concatenate([np.ones((len(x), 1)), (x - centre) / scale], 1)
        weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
        shrink, b = np.array([1e-6, 0.5, 0.5]), np.zeros(3)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            step = z.T @ (weight * (y - p)) - shrink * b
            b = b + np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(shrink), step)
        self.line = (float(b[0] - (b[1:] * centre / scale).sum()), *(b[1:] / scale).tolist())

    def score(self, text: str | None) -> float:
        if not text or self.line is None:
            return self.share
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w * e for w, e in zip(self.line, (1.0, *self.evidence(text)), strict=True))))))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> CompressionScore:
    """Fits on a bounded sample of the documents of `docs` that have a quality label."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null")
    counts = {r[0]: r[1] for r in marks.groupBy("quality").count().collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("length(text) > 0")
    rows = []
    for q in (0, 1):
        chosen = marks.where(f"quality = {q}").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        some = texts.join(F.broadcast(chosen), "doc_id").withColumn("h", F.xxhash64("doc_id", "text")).orderBy("h").limit(sample).withColumn("text", F.substring("text", 1, LONGEST))
        upto = F.sum(F.length("text")).over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, 0))  # over `sample` rows
        rows.append([r["text"] for r in some.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_CHARS).orderBy("h").collect()])
    bad, good = rows
    if not good or not bad:
        model = CompressionScore(b" " * 8, b" " * 8)
        model.share = share
        return model
    model = CompressionScore(build_dictionary([t.encode() for t in good[::2]]), build_dictionary([t.encode() for t in bad[::2]]))
    other = [(t, 0) for t in bad[1::2] or bad] + [(t, 1) for t in good[1::2] or good]
    model.calibrate([t for t, _ in other], [y for _, y in other], share)
    return model


def score_quality(docs: DataFrame, model: CompressionScore, threshold: float = 0.3) -> DataFrame:
    """The documents with score (probability of label 1) and predicted (1 from `threshold` on, else 0)."""
    C.small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY bytes

    def make():
        model = held.value

        def run(texts):
            s = [model.score(t) for t in texts]
            return [s, [int(x >= threshold) for x in s]]

        return run

    return C.map_rows(docs, make, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
