"""Token ids in byte-aligned files of variable-length codes, with the lengths in control bytes of their own.

Ids are replaced by their rank in the corpus' frequencies, so that frequent ids need one byte. Four codes share a
control byte, two bits a code for its length less one; the codes' bytes follow in a stream apart. Decoding looks the
control bytes up in a table of lengths, and gathers all codes of a block at once.

A file set is a folder: `ranks` (one row: ids by rank) and `blocks` (Parquet rows of whole documents, ascending by doc_id
and cut at about BLOCK ids: first document's number, doc_ids, counts, ids before the block in its part file, ids in it, control
bytes, code bytes), written by range partitions.

Defined cases: null or empty text is its end id alone; null doc_id comes first; rows of equal doc_id keep rows of their
own, in the order of their text's hash; a document longer than a block makes a block of its own; an empty table writes no
blocks; other columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

END, BLOCK = 2, 1 << 18
#: Pages and row groups of the ids between the steps: what a writer holds back, in arrays that the JVM need not place alone.
SMALL = {"parquet.page.size": str(256 << 10), "parquet.block.size": str(8 << 20)}
#: Code lengths of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


#: Fixed value: the split into pieces of the files whose words may be encoded in lines.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What may follow a word of letters without changing its ids: ASCII signs and digits, no apostrophe.
TAIL = "".join(c for c in map(chr, range(33, 127)) if not c.isalpha() and c != "'")
LINE, MARKED = 5000, 1 << 40
#: Fixed value: the characters that stand for bytes in byte-level vocabularies: printable ones for themselves, white space stays.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)} | {b: b for b in _PRINTED} | {32: 32}


class WordIds:
    """word -> ids (little-endian, of the width the vocabulary needs) from the tokenizers library.

    Words are runs without ASCII white space, encoded once each. That is right for files that drop white space before
    they split into pieces, so others are refused. Where the split is the known one, a word of letters is one piece: its
    normal form (of many words at once) goes to the library's model as it is, and a tail of signs is encoded apart.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if len(self.tokenizer.encode("a \t a", add_special_tokens=False).ids) != 2 * len(self.tokenizer.encode(" a", add_special_tokens=False).ids):
            raise ValueError(f"{path} keeps white space: its texts cannot be encoded word by word")
        self.wide = "<u4" if self.tokenizer.get_vocab_size() > 1 << 16 else "<u2"
        self.table = C.WordTable(self.learn, self.wide)
        form = json.loads(self.tokenizer.to_str())
        normal = form["normalizer"] or {}
        # lower-cased ASCII letters are their own normal form
        self.plain = all(x["type"] in ("NFC", "Lowercase") or x.get("pattern") == {"Regex": "\\s+"} for x in normal.get("normalizers", [normal]) if x)
        steps = (form["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.letters = [x.get("type") for x in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"].get("Regex") == SPLIT and not (steps[1]["add_prefix_space"] or steps[1]["use_regex"])

    def _each(self, words: list[str]) -> tuple[list[int], list[int]]:
        ids, sizes = [], []
        for k in range(0, len(words), LINE):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(words[k : k + LINE], add_special_tokens=False)]
            ids += chain.from_iterable(found)
            sizes += map(len, found)
        return ids, sizes

    def _letters(self, words: list[str]) -> tuple[list[int], list[int]]:
        tokenize, normal, ids, sizes = self.tokenizer.model.tokenize, self.tokenizer.normalizer, [], []
        for k in range(0, len(words), LINE):
            some = words[k : k + LINE]
            line = " ".join(some)
            if normal and not (self.plain and line.isascii()):
                line = normal.normalize_str(line)
            if line.count(" ") != len(some) - 1 or not line.replace(" ", "").isalpha():  # a normal form that is not one piece
                more, n = self._each(some)
                ids += more
            else:
                found = list(map(tokenize, line.encode().decode("latin-1").translate(BYTE_CHARS).split(" ")))
                ids += [x.id for tokens in found for x in tokens]
                n = map(len, found)
            sizes += n
        return ids, sizes

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        plain, marked, others = {}, {}, {}  # what is encoded, numbered: letters of ASCII, other letters, the rest
        stems, tails = [], []
        for w in words:
            if self.letters and w.isalpha():  # ASCII
                stems.append(plain.setdefault(w.lower(), len(plain)))
                tails.append(-1)
                continue
            if self.letters and w.isascii() and (stem := w.rstrip(TAIL.encode())).isalpha():
                stems.append(plain.setdefault(stem.lower(), len(plain)))
                tails.append(others.setdefault(w[len(stem) :].decode(), len(others)))
                continue
            s = w.decode()
            stem = s.rstrip(TAIL)
            if self.letters and stem.isalpha() and (stem.isascii() or unicodedata.normalize("NFC", stem).lower().isalpha()):
                stems.append(plain.setdefault(stem.lower().encode(), len(plain)) if stem.isascii() else MARKED + marked.setdefault(stem, len(marked)))
                s = s[len(stem) :]
            else:
                stems.append(-1)
            tails.append(others.setdefault(s, len(others)) if s else -1)
        (ids, sizes), (more, n), (rest, m) = self._letters([w.decode() for w in plain]), self._letters(list(marked)), self._each(list(others))
        flat, size = np.array(ids + more + rest, np.int64), np.array(sizes + n + m + [0], np.int64)
        stems, tails = np.array(stems), np.array(tails)
        stems = np.where(stems >= MARKED, stems - MARKED + len(plain), stems)
        order = np.stack([stems, np.where(tails >= 0, tails + len(plain) + len(marked), -1)], 1).ravel()  # -1: nothing
        start = np.cumsum(size) - size
        return flat[C.ragged(start[order], size[order])], size[order].reshape(-1, 2).sum(1)

    def flat_ids(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where those of each text begin, with the total behind."""
        return self.table.look_up(bytes.split, texts)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian integers."""
        ids, at = self.flat_ids([C.text_bytes(t) for t in texts])
        return [ids[a:z].tobytes() for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


_LOADED: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    if path not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _LOADED[path] = WordIds(path)
    C.alone(_LOADED[path].table)
    return _LOADED[path]


def pack(codes: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and code bytes."""
    codes = codes.astype("<u4")
    size = 1 + (codes > 0xFF).astype(np.uint8) + (codes > 0xFFFF) + (codes > 0xFFFFFF)
    padded = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    padded[: len(codes)] = size - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    use = np.arange(4)[None] < size[:, None]
    return control.tobytes(), codes.view(np.uint8).reshape(-1, 4)[use].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(size) - size
    b = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    out = b[at]
    for k in range(1, int(size.max(initial=1))):
        out |= np.where(size > k, b[at + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return out


def write_tokens(docs: DataFrame, path: str, folder: str, end: int = END) -> None:
    """Encodes and writes the file set. Texts are encoded once, and their ids counted on the way; ids are sorted in the width
    that the vocabulary needs."""
    spark = docs.sparkSession
    C.small_batches(spark)
    tables = C.Scratch(spark, "ids")
    wide = encoder(path).wide if end < 1 << 16 else "<u4"

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).withColumn("tie", F.xxhash64("text"))
    kinds = {"doc_id": pa.int64(), "tie": pa.int64(), "ids": pa.binary(), "used": pa.list_(pa.int64()), "uses": pa.list_(pa.int64())}

    def encode(batches):
        """A row a document, and behind them one without ids: which ids the task gave, and how often."""
        tool, total = encoder(path), np.zeros(0, np.int64)
        for b in batches:
            ids, at = tool.flat_ids(b.column("text").to_pylist())
            ids = np.insert(ids.astype(wide), at[1:], end)
            at = at + np.arange(len(at))
            total = np.pad(total, (0, max(0, int(ids.max(initial=0)) + 1 - len(total))))
            total += np.bincount(ids, minlength=len(total))
            data, width = ids.tobytes(), ids.itemsize
            found = [data[a * width : z * width] for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            nothing = [None] * len(found)
            columns = [b.column("doc_id"), b.column("tie"), found, nothing, nothing]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((None, None, None, on, total[on]), kinds.values(), strict=True)], names=list(kinds))

    ids = tables.save(src.mapInArrow(encode, "doc_id long, tie long, ids binary, used array<long>, uses array<long>"), **SMALL)
    some = ids.where("used is not null").select(F.explode(F.arrays_zip("used", "uses")).alias("of"))
    counts = some.groupBy(F.col("of.used").alias("id")).agg(F.sum("of.uses").alias("n"))
    order = [r["id"] for r in counts.orderBy(F.desc("n"), "id").collect()]  # at most the vocabulary
    spark.createDataFrame([(order,)], "ids array<long>").coalesce(1).write.parquet(f"{folder}/ranks")
    rank = np.zeros(max(order, default=0) + 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    held = spark.sparkContext.broadcast(rank)

    def blocks(batches):
        C.alone()  # the words are not needed any more
        waiting, size, before = [], 0, 0

        def block():
            codes = held.value[np.concatenate([np.frombuffer(x, wide) for _, x in waiting])]
            control, data = pack(codes)
            docs_, lengths = [d for d, _ in waiting], [len(x) // np.dtype(wide).itemsize for _, x in waiting]
            long, longs = pa.int64(), pa.list_(pa.int64())
            values = {"first_doc": (docs_[0], long), "doc_ids": (docs_, longs), "counts": (lengths, longs), "before": (before, long), "total": (size, long), "control": (control, pa.binary()), "codes": (data, pa.binary())}
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values.values()], names=list(values))

        for b in batches:
            for doc, x in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                waiting.append((doc, x))
                size += len(x) // np.dtype(wide).itemsize
                if size >= BLOCK:
                    yield block()
                    waiting, size, before = [], 0, before + size
        if waiting:
            yield block()

    parts = max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = ids.where("ids is not null").select("doc_id", "ids", "tie").repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    ranged.mapInArrow(blocks, "first_doc long, doc_ids array<long>, counts array<long>, before long, total long, control binary, codes binary").write.parquet(f"{folder}/blocks")
    tables.drop(ids)


def read_tokens(spark, folder: str) -> DataFrame:
    """Reads a file set back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids, a row a document.

    A block says how many ids come before it in its part file, and part files are numbered in range order, so what is
    gathered is a row a file: no block is moved.
    """
    order = spark.read.parquet(f"{folder}/ranks").first()["ids"]
    held = spark.sparkContext.broadcast(np.array(order, np.uint32))
    blocks = spark.read.parquet(f"{folder}/blocks").withColumn("file", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long"))
    files = blocks.groupBy("file").agg(F.sum("total").alias("n")).orderBy("file").collect()
    bases, at = {}, 0
    for r in files:
        bases[r["file"]] = at
        at += r["n"]
    starts = spark.sparkContext.broadcast(bases)
    placed = blocks.select("file", "before", "doc_ids", "counts", "control", "codes")

    def read(batches):
        C.alone()
        ranks, bases = held.value, starts.value
        for b in batches:
            for file, before, docs_, counts, control, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                base = bases[file] + before
                ids = ranks[unpack(control, data, sum(counts))].astype("<u4")
                ends = np.cumsum(counts)
                parts = [ids[z - n : z].tobytes() for n, z in zip(counts, ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs_, pa.int64()), pa.array(base + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array([zlib.crc32(x) for x in parts], pa.int64()), pa.array(parts, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
