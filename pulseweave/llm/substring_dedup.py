"""Removal of passages that an earlier document already has, by suffix automata of reference passages.

A window is WINDOW consecutive words; a word goes if a window over it also starts in a document with a smaller
doc_id. The reference is cut into shards by the document a repeated passage first stands in, each shard holding only
that document's repeated passages. A shard's suffix automaton is not sent to all executors, since the shards grow with
the corpus: the regions of later documents are brought to the shards they can match (found by sampled word runs, then
window hashes), a shard with many regions being copied to several tasks, and the automaton streams them for matching
statistics.

Steps: every window picks the run of GRAM words with the least hash (equal windows pick equal runs); runs seen under two
doc_ids mark the windows that may repeat; their window hashes give each window's first document by a map-side minimum;
automata then decide on the words themselves, so no hash collision can remove a word.

Defined cases: null text has no words; fewer than WINDOW words are kept whole; rows with equal doc_id never remove
each other; a null doc_id is neither a source nor trimmed; repeated rows each keep their row; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW, GRAM = 50, 20
#: Bytes of a shard's regions that one task streams, and bytes of regions whose spans it remembers.
TASK_BYTES, KNOWN_BYTES = 4 << 20, 16 << 20


class SuffixAutomaton:
    """All runs of symbols of the passages added; passages are kept apart by symbols of their own."""

    def __init__(self):
        self.next, self.link, self.len, self.last, self.cuts = [{}], [-1], [0], 0, 0

    def add(self, words) -> None:
        for w in words:
            self._extend(w)
        self.cuts += 1
        self._extend(("cut", self.cuts))

    def _extend(self, c) -> None:
        nxt, link, length = self.next, self.link, self.len
        cur, p = len(nxt), self.last
        nxt.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] != length[p] + 1:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[cur] = q
        self.last = cur

    def spans(self, words, least: int) -> list[tuple[int, int]]:
        """Maximal spans of words covered by common runs of `least` words or more, from the matching statistics."""
        nxt, link, length = self.next, self.link, self.len
        state = run = 0
        out: list[list[int]] = []
        for j, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                run = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                run += 1
            if run >= least:
                if out and out[-1][1] >= j + 1 - run:
                    out[-1] = [min(out[-1][0], j + 1 - run), j + 1]
                else:
                    out.append([j + 1 - run, j + 1])
        return [(a, b) for a, b in out]


def _anchors(h: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each window, the hash of its least run of `gram` words."""
    least = C.gram_hashes(h, gram)
    width, have = window - gram + 1, 1
    if len(least) < width:
        return np.zeros(0, np.uint64)
    while have < width:  # minima of runs twice as long each time
        step = min(have, width - have)
        least, have = np.minimum(least[:-step], least[step:]), have + step
    return least


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _survey(batches, window: int, gram: int):
    C.alone()
    for b in batches:
        h, at = C.column_words(b.column("text"))
        sha = [_sha((t or b"").split()) for t in b.column("text").cast(pa.binary()).to_pylist()]
        known = b.column("doc_id").is_valid().to_pylist()
        runs = [C.signed(np.unique(_anchors(h[a:z], window, gram))) if ok else [] for ok, a, z in zip(known, at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rid"), pa.array(np.diff(at), pa.int64()), pa.array(sha, pa.string()), pa.array(runs, pa.list_(pa.int64()))], names=["doc_id", "rid", "n_words", "sha", "runs"])


def _windows(batches, window: int, gram: int):
    """Hash and place of every window whose run was seen under two doc_ids."""
    for b in batches:
        h, at = C.column_words(b.column("text"))
        places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, z, runs in zip(at[:-1].tolist(), at[1:].tolist(), b.column("runs"), strict=True):
            on = np.flatnonzero(np.isin(_anchors(h[a:z], window, gram), runs.values.to_numpy().view(np.uint64)))
            hashes.append(C.signed(C.gram_hashes(h[a:z], window)[on]))
            places.append(on)
        n = np.array([len(x) for x in places[1:]], np.int64)
        docs, rids = (np.repeat(b.column(c).to_numpy(zero_copy_only=False).astype(np.int64), n) for c in ("doc_id", "rid"))
        yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(rids), pa.array(np.concatenate(places)), pa.array(np.concatenate(hashes))], names=["doc_id", "rid", "pos", "wh"])


def _regions(batches, window: int):
    """The texts of runs of neighbouring repeated windows with one first document."""
    for b in batches:
        out = {k: [] for k in ("first", "doc_id", "rid", "start", "words")}
        for doc, rid, text, hits in zip(*(b.column(c).to_pylist() for c in ("doc_id", "rid", "text", "hits")), strict=True):
            words = text.encode().split()
            runs: list[list[int]] = []
            open_: dict[int, list[int]] = {}
            for pos, first in sorted((x["pos"], x["first"]) for x in hits):
                if (r := open_.get(first)) and pos == r[1] + 1:
                    r[1] = pos
                else:
                    runs.append(r := [pos, pos, first])
                    open_[first] = r
            for a, z, first in runs:
                for k, v in zip(out, (first, doc, rid, a, b" ".join(words[a : z + window])), strict=True):
                    out[k].append(v)
        yield pa.RecordBatch.from_arrays([*(pa.array(out[k], pa.int64()) for k in ("first", "doc_id", "rid", "start")), pa.array(out["words"], pa.binary())], names=list(out))


def _match(batches, window: int):
    """Streams regions through the automaton of their shard. Rows come shard by shard, its passages (doc_id null) before
    the regions; spans of equal regions of a shard are found once."""
    key, automaton, known, size = None, None, {}, 0
    for b in batches:
        out = {k: [] for k in ("doc_id", "rid", "start", "end")}
        for first, salt, doc, rid, start, words in zip(*(b.column(c).to_pylist() for c in ("first", "salt", "doc_id", "rid", "start", "words")), strict=True):
            if key != (first, salt):
                key, automaton, known, size = (first, salt), SuffixAutomaton(), {}, 0
            if doc is None:
                automaton.add(words.split())
                continue
            if words not in known:
                if (size := size + len(words)) > KNOWN_BYTES:
                    known, size = {}, len(words)
                known[words] = automaton.spans(words.split(), window)
            for a, z in known[words]:
                for k, v in zip(out, (doc, rid, start + a, start + z), strict=True):
                    out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], names=list(out))


def _join_spans(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(z, out[-1][1])
        else:
            out.append([a, z])
    return out


def _cut(batches):
    for b in batches:
        n, sha, kept, where = [], [], [], []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
            words, left, at = text.encode().split(), [], 0
            merged = _join_spans((x["start"], x["end"]) for x in spans)
            for a, z in merged:
                left += words[at:a]
                at = z
            left += words[at:]
            n.append(len(words) - len(left))
            sha.append(_sha(left))
            kept.append(b" ".join(left).decode())
            where.append([{"start": a, "end": z} for a, z in merged])
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("rid"), pa.array(n, pa.int64()), pa.array(sha), pa.array(kept), pa.array(where, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            names=["doc_id", "rid", "removed", "cut_sha", "kept_text", "spans"],
        )


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """A row a document: doc_id, rid, n_words, n_removed, kept_sha256, spans (of removed words) and kept_text.

    kept_text and spans are null where nothing was removed: the words are then those of the text.
    """
    spark = docs.sparkSession
    C.small_batches(spark, 300)
    tables = C.Scratch(spark, "substrings")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("rid", F.xxhash64("doc_id", "text"))
    base = tables.save(docs.mapInArrow(partial(_survey, window=window, gram=gram), "doc_id long, rid long, n_words long, sha string, runs array<long>"))
    runs = base.select("doc_id", "rid", F.explode("runs").alias("run"))
    seen = tables.save(runs.groupBy("run").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("run"))
    marked = tables.save(runs.join(seen, "run").groupBy("doc_id", "rid").agg(F.collect_set("run").alias("runs")))
    suspects = tables.save(docs.join(marked, ["doc_id", "rid"]))
    tables.drop(seen, marked)
    windows = suspects.mapInArrow(partial(_windows, window=window, gram=gram), "doc_id long, rid long, pos long, wh long")  # worked out twice: cheaper than kept
    first = tables.save(windows.groupBy("wh").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("z")).where("first < z").select("wh", "first"))
    hits = windows.join(first, "wh").groupBy("doc_id", "rid").agg(F.collect_set(F.struct("pos", "first")).alias("hits"))
    hits = tables.save(hits)
    tables.drop(first)
    regions = tables.save(suspects.drop("runs").join(hits, ["doc_id", "rid"]).mapInArrow(partial(_regions, window=window), "first long, doc_id long, rid long, start long, words binary"))
    tables.drop(hits)
    later = regions.where("doc_id > first")
    shards = later.groupBy("first").agg(F.ceil(F.sum(F.length("words")) / TASK_BYTES).alias("salts"))
    shards = tables.save(shards)
    passages = regions.where("doc_id = first").select("first", "words").distinct().join(shards, "first")
    passages = passages.select("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("rid"), F.lit(0).cast("long").alias("start"), "words")
    later = later.join(shards, "first").select("first", F.pmod(F.xxhash64("rid"), F.col("salts")).alias("salt"), "doc_id", "rid", "start", "words")
    rows = passages.union(later).repartition("first", "salt").sortWithinPartitions("first", "salt", F.col("doc_id").isNotNull())
    spans = rows.mapInArrow(partial(_match, window=window), "doc_id long, rid long, start long, end long")
    spans = tables.save(spans.groupBy("doc_id", "rid").agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    tables.drop(regions, shards)
    cut = suspects.drop("runs").join(spans, ["doc_id", "rid"]).mapInArrow(_cut, "doc_id long, rid long, removed long, cut_sha string, kept_text string, spans array<struct<start:long,end:long>>")
    cut = cut.dropDuplicates(["doc_id", "rid"])
    return base.join(cut, ["doc_id", "rid"], "left").select(
        "doc_id", "rid", "n_words", F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("cut_sha", "sha").alias("kept_sha256"), "spans", "kept_text"
    )
