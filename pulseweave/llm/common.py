"""What the corpus operators share: words, rolling hashes, row maps and tables in the cluster's shared folder."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from itertools import chain, compress, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ODD = 0x9E3779B97F4A7C15
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of few rows, since texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; in a local session that names none, a temporary one of this session."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pulseweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage, outlive executors and can be dropped when done with."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}

    def save(self, df: DataFrame, **options: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")  # the shuffles that made a table go as soon as it is written
        try:
            df.write.options(**options).parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        for t in tables:
            if path := getattr(t, "_scratch_path", None):
                jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as no column has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc(col) -> F.Column:
    return F.crc32(col.cast("string").cast("binary"))


def text_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode()


#: Places of the distinct hashes that least_hashes() lets through, for each that is wanted.
SPARE = 4


def least_hashes(rows: DataFrame, n: int, by: list[str], groups: int | None = None) -> DataFrame:
    """Rows (with a column h, a 64-bit hash) that hold the n least hashes of each group, and few others: about SPARE * n
    hashes of a group at every size, so that what is ranked later is bounded. `groups`: only so many groups, those of most hashes."""
    count, wanted = F.approx_count_distinct("h"), SPARE * n + 100
    if not by:
        m = rows.agg(count).first()[0]
        return rows if m <= wanted else rows.where(F.col("h") <= -(1 << 63) + int(wanted / m * (1 << 64)))
    sizes = rows.groupBy(*by).agg(count.alias("m_"))
    if groups:
        sizes = sizes.orderBy(F.desc("m_"), *by).limit(groups)
    # the share of all hashes, from the least on; what is doubled lies within 2^62 of 0, since longs may not overflow
    most = ((F.lit(float(wanted)) / F.col("m_") * float(1 << 63)).cast("long") - F.lit(1 << 62)) * 2
    sizes = sizes.select(*by, F.when(F.col("m_") > wanted, most).otherwise(F.lit((1 << 63) - 1)).alias("most_"))
    return rows.join(F.broadcast(sizes), by).where("h <= most_").drop("most_")  # a row a group


def map_rows(df: DataFrame, make, fields: list[T.StructField], text: str = "text", drop: tuple[str, ...] = (), table: bool = False) -> DataFrame:
    """Appends `fields` to every row. make() runs once a task and gives f(texts) -> one list a field; `table` says that
    it has called alone() for the word table that it uses.

    Other columns go through unchanged; those named like a new field are replaced by it.
    """
    new = {f.name for f in fields}
    keep = [c for c in df.columns if c not in new]
    src = df.select(*[F.col(f"`{c}`") for c in keep])
    out = [src.schema[c] for c in keep if c not in drop]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in out] + fields)
    arrow = to_arrow_schema(T.StructType(fields))

    def run(batches):
        f = make()
        if not table:
            alone()
        for b in batches:
            cols = f(b.column(keep.index(text)).to_pylist())
            arrays = [b.column(i) for i, c in enumerate(keep) if c not in drop]
            arrays += [pa.array(v, type=t.type) for v, t in zip(cols, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[c for c in keep if c not in drop] + arrow.names)

    return src.mapInArrow(run, schema)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs that begin at `starts`, one run after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


#: Bytes that a worker's table may hold when a batch of texts begins, and about those of an entry beside the word's own.
TABLE_BYTES, ENTRY = 160 << 20, 200


class _Numbers(dict):
    def __missing__(self, word) -> int:
        n = self[word] = len(self)
        return n


class WordTable:
    """What a worker remembers from task to task: words numbered as they come, with the values (ids) of each.

    `learn` gives the values of new words, one word after the other, and how many each has. Before a batch, a table that
    has grown beyond its bytes forgets the half of its words that were used least.
    """

    every: list[WordTable] = []

    def __init__(self, learn, dtype, most: int = TABLE_BYTES):
        self.learn, self.dtype, self.most = learn, dtype, most
        self.clear()
        WordTable.every.append(self)

    def clear(self) -> None:
        self.words, self.bytes = _Numbers(), 0
        self.values, self.starts, self.sizes, self.uses = np.zeros(0, self.dtype), *np.zeros((3, 0), np.int64)

    def forget_half(self) -> None:
        most = np.sort(np.argpartition(-self.uses, len(self.uses) // 2)[: len(self.uses) // 2])
        keep = np.zeros(len(self.uses), bool)
        keep[most] = True
        left = list(compress(self.words, keep.tolist()))
        self.words, self.uses = _Numbers(zip(left, range(len(left)), strict=True)), self.uses[most] // 2
        self.bytes = sum(map(len, left)) + ENTRY * len(left)
        self.values, self.sizes = self.values[ragged(self.starts[most], self.sizes[most])], self.sizes[most]
        self.starts = np.cumsum(self.sizes) - self.sizes

    def look_up(self, split, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """The values of all words that split() finds in the texts, and where those of each begin, with the total behind."""
        on = gc.isenabled()
        gc.disable()  # very many small objects, none in a cycle
        try:
            return self._look_up([split(t) if t else [] for t in texts])
        finally:
            if on:
                gc.enable()

    def _look_up(self, cut: list[list]) -> tuple[np.ndarray, np.ndarray]:
        if self.bytes > self.most:
            self.forget_half()
        known, n = len(self.words), np.array([len(c) for c in cut], np.int64)
        at = np.fromiter(map(self.words.__getitem__, chain.from_iterable(cut)), np.int64, int(n.sum()))
        if fresh := list(islice(reversed(self.words), len(self.words) - known))[::-1]:
            values, sizes = self.learn(fresh)
            self.starts = np.concatenate([self.starts, len(self.values) + np.cumsum(sizes) - sizes])
            self.values, self.sizes = np.concatenate([self.values, values.astype(self.dtype)]), np.concatenate([self.sizes, sizes])
            self.uses = np.concatenate([self.uses, np.zeros(len(fresh), np.int64)])
            self.bytes += sum(map(len, fresh)) + ENTRY * len(fresh)
        self.uses += np.bincount(at, minlength=len(self.uses))
        sizes = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(n)])]
        return self.values[ragged(self.starts[at], sizes)], ends


def alone(*mine: WordTable) -> None:
    """Forgets what the operators that ran before in this worker remember, all tables but `mine`, and gives back the memory."""
    others = [t for t in WordTable.every if t.words and t not in mine]
    for t in others:
        t.clear()
    if others:
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (multiply and shift)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


#: Values of (place in word, byte) for the first places; later ones are mixed one by one. No byte of white space is in a word.
_PLACES = 64
_VALUES = mix(np.arange(1, _PLACES * 256 + 1, dtype=np.uint64) * np.uint64(ODD))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32  # A-Z
_SOLID = ~np.isin(np.arange(256), [32, *range(9, 14)])
_SLICE = 1 << 17  # bytes hashed at once


def _text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each begins; nulls are empty."""
    column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _hash_words(raw: np.ndarray, at: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    solid = _SOLID[raw]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(raw))]  # a word ends with its text
    begins[edges] = solid[edges]
    ends[edges - 1] = solid[edges - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    lengths = stops - starts
    out, done = np.empty(len(starts), np.uint64), np.cumsum(lengths)
    k = 0
    while k < len(starts):
        z = max(k + 1, int(np.searchsorted(done, (done[k - 1] if k else 0) + _SLICE, side="right")))
        size = lengths[k:z]
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum()), dtype=np.int32) - np.repeat(first, size).astype(np.int32)
        span = slice(starts[k], stops[z - 1])
        bytes_ = raw[span][solid[span]]
        if lower:
            bytes_ = _FOLD[bytes_]
        values = _VALUES[(np.minimum(place, _PLACES - 1) << 8) | bytes_]
        if (late := np.flatnonzero(place >= _PLACES)).size:
            values[late] = mix((place[late].astype(np.uint64) << np.uint64(8) | bytes_[late]) * np.uint64(ODD) + np.uint64(7))
        out[k:z] = np.add.reduceat(values, first)
        k = z
    return mix(out), np.searchsorted(starts, at)


def column_words(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts (runs without ASCII white space; A-Z lower-cased if asked for), and the
    number of each text's first word, with the total behind. Long texts are hashed in slices."""
    return _hash_words(*_text_buffers(column), lower)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The same of words without white space in them."""
    raw = np.frombuffer(b" ".join(words), np.uint8)
    return _hash_words(raw, np.array([0, len(raw)]), False)[0]


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(4096, 2 * n)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (ODD, pow(ODD, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words, from prefix sums if n is large; arithmetic is modulo 2^64."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    if n <= 8:
        return mix(sum(h[k : len(h) - n + 1 + k] * np.uint64(pow(ODD, k + 1, 1 << 64)) for k in range(n)))
    up, down = _powers(len(h))
    q = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * down)])
    return mix((q[n:] - q[:-n]) * up[: len(h) - n + 1])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


