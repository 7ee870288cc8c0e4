"""Near-duplicate documents: b-bit MinHash signatures joined by a multi-index over signature distance.

A document is the set of its distinct shingles of `size` words (A-Z lower-cased). Its signature holds HASHES values of
BITS bits. CHUNKS chunks cut the signature; if two signatures differ in at most 2 * CHUNKS - 1 values, one chunk holds
at most one difference (pigeonhole), so keying every chunk once for each value left out finds all such pairs. A linked
pair has two differences or more in every chunk, and is then missed, with a probability of (1 - s^6 - 6 (1 - s) s^5)^12
at similarity s: 1.5e-8 at 0.85 and 2.8e-6 at 0.8, less above. Links are confirmed on the full sets of shingles.

Equal sets are folded into one node first. Buckets are never expanded into pairs: a node meets the least node (pivot) of
each of its buckets, and is confirmed against the one of them that it shares most keys with, which links most of a
group. A pair is not looked at if the signatures differ in more than FAR values (below 1e-8 for linked pairs) or the
sets' sizes exclude a link. Components that share a bucket form a candidate group, unless they share only buckets of two
nodes that are such a pair; a group's nodes outside its largest component are compared with the group's nodes in blocks
of BLOCK nodes and about SHINGLES shingles, a task holding two blocks, and only links that join two components are
emitted. Every pair that shares a key is thus confirmed, excluded or already connected.

Defined cases: null, empty or blank text has no shingles and links to nothing; fewer words than `size` make one shingle;
a null doc_id has a null component and is kept; repeated rows share one result each; of different texts under one
doc_id the one of the least hash is compared, and its component is that of all these rows; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import connected, jumped

HASHES, CHUNKS, BITS, FAR = 72, 12, 16, 36
BLOCK, SHINGLES, SLICE = 256, 1_000_000, 1 << 16
_SEEDS = C.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(C.ODD)) | np.uint64(1)


def shingle_set(text: str | None, size: int) -> frozenset:
    words = C.text_bytes(text).lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def hash_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes."""
    h, at = C.column_words(texts, lower=True)
    n, g = np.diff(at), C.gram_hashes(h, size)
    return [np.unique(g[a : a + k - size + 1] if k >= size else C.gram_hashes(h[a : a + k], int(k))) if k else h[:0] for a, k in zip(at[:-1].tolist(), n.tolist(), strict=True)]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row a set (none may be empty): HASHES minima, their low BITS bits."""
    out = np.empty((len(sets), HASHES), np.uint64)
    lengths = np.array([len(x) for x in sets])
    done, k = np.cumsum(lengths), 0
    while k < len(sets):  # slices that stay in a core's cache
        z = max(k + 1, int(np.searchsorted(done, (done[k - 1] if k else 0) + SLICE, side="right")))
        flat, first = np.concatenate(sets[k:z]), np.cumsum(lengths[k:z]) - lengths[k:z]
        for i, seed in enumerate(_SEEDS):
            x = flat * seed
            x ^= x >> np.uint64(29)
            out[k:z, i] = np.minimum.reduceat(x, first)
        k = z
    return (C.mix(out) & np.uint64((1 << BITS) - 1)).astype("<u2")


def chunk_keys(sigs: np.ndarray) -> np.ndarray:
    """For each signature and chunk, one key for each value of it that is left out."""
    per = HASHES // CHUNKS
    parts = sigs.reshape(len(sigs), CHUNKS, per).astype(np.uint64)
    keys = np.empty((len(sigs), CHUNKS, per), np.uint64)
    for gap in range(per):
        key = np.broadcast_to(C.mix(np.arange(CHUNKS, dtype=np.uint64) * np.uint64(per) + np.uint64(gap + 1)), (len(sigs), CHUNKS))
        for i in range(per):
            if i != gap:
                key = C.mix(key ^ (parts[:, :, i] + np.uint64(1)) * np.uint64(C.ODD))
        keys[:, :, gap] = key
    return C.signed(keys.reshape(len(sigs), -1))


def _sketch(batches, size: int):
    C.alone()
    for b in batches:
        sets = hash_sets(b.column("text"), size)
        n = np.array([len(s) for s in sets], np.int64)
        sigs = signatures([s for s in sets if len(s)]) if n.any() else np.zeros((0, HASHES), "<u2")
        keys = chunk_keys(sigs)
        rows = iter(sigs)
        at = np.concatenate([[0], np.cumsum(np.where(n > 0, keys.shape[1], 0))])
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"),
                b.column("th"),
                pa.array(n),
                pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets], pa.string()),
                pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys.ravel())),
            ],
            names=["doc_id", "th", "n_shingles", "digest", "sig", "keys"],
        )


def _apart(batches):
    """Edges with the number of values in which the two signatures differ."""
    for b in batches:
        u, v = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, HASHES) for c in ("sig", "other_sig"))
        keep = [b.column(c) for c in ("node", "pivot", "n", "other_n", "c", "alone")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array((u != v).sum(1), pa.int64())], names=["node", "pivot", "n", "other_n", "c", "alone", "d"])


def _confirm(batches, size: int, percent: int):
    """Pairs whose full sets are similar enough; b repeats from row to row, so its set is kept."""
    key, held = None, frozenset()
    for batch in batches:
        us, vs = [], []
        for u, v, tu, tv in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "text_u", "text_v")), strict=True):
            if v != key:
                key, held = v, shingle_set(tv, size)
            s = shingle_set(tu, size)
            both = len(s & held)
            if 100 * both >= percent * (len(s) + len(held) - both):
                us.append(u)
                vs.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def _links(rows: list[dict], size: int, percent: int) -> list[tuple[int, int]]:
    """Pairs of linked components of two blocks, enough to join them; open nodes are compared with all nodes at once, on full sets."""
    sets = hash_sets(pa.array([r["text"] for r in rows], pa.string()), size)
    lengths = np.array([len(x) for x in sets])
    starts = np.cumsum(lengths) - lengths
    names, place = np.unique(np.concatenate(sets), return_inverse=True)
    root = {r["root"]: r["root"] for r in rows}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out, mark = [], np.zeros(len(names), np.int64)
    for i, r in enumerate(rows):
        if not r["open"]:
            continue
        own = place[starts[i] : starts[i] + lengths[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[place], starts)
        mark[own] = 0
        for j in np.flatnonzero(100 * both >= percent * (lengths + lengths[i] - both)).tolist():
            if (a := find(r["root"])) != (b := find(rows[j]["root"])):
                root[a] = b
                out.append((r["root"], rows[j]["root"]))
    return out


def _blocks(batches, size: int, percent: int):
    """Sorted rows of (group, i, j); yields the links of each such task."""
    key, held = None, []
    names = ("group", "i", "j", "node", "root", "open", "text")

    def batch(rows):
        found = _links(rows, size, percent)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    for b in batches:
        for values in zip(*(b.column(c).to_pylist() for c in names), strict=True):
            if values[:3] != key:
                if len(held) > 1:
                    yield batch(held)
                key, held = values[:3], []
            held.append(dict(zip(names, values, strict=True)))
    if len(held) > 1:
        yield batch(held)


def _placed(nodes: DataFrame, parts: DataFrame, name: str) -> DataFrame:
    """Adds each node's least node in parts (u, v), itself if it has none."""
    named = parts.select(F.col("u").alias("node"), F.col("v").alias("least_"))
    return nodes.join(named, "node", "left").withColumn(name, F.coalesce("least_", "node")).drop("least_")


def link_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """A row a document: doc_id, n_shingles, component_id (least doc_id linked to it, directly or not), kept."""
    spark = docs.sparkSession
    C.small_batches(spark, 300)
    tables = C.Scratch(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    sketch = tables.save(docs.mapInArrow(partial(_sketch, size=size), "doc_id long, th long, n_shingles long, digest string, sig binary, keys array<long>"))
    sets = sketch.where("doc_id is not null and digest is not null")
    several = tables.save(sets.groupBy("doc_id").agg(F.min(F.struct("th", "digest")).alias("first"), F.max("th").alias("z")).where("first.th < z").select("doc_id", F.col("first.th").alias("own_th"), F.col("first.digest").alias("own_digest")))

    def chosen(rows: DataFrame) -> DataFrame:
        return rows.join(several.select("doc_id", "own_th"), "doc_id", "left").where("own_th is null or th = own_th").drop("own_th")

    sets = chosen(sets)
    nodes = tables.save(sets.groupBy("digest").agg(F.min("doc_id").alias("node"), F.min("n_shingles").alias("n")))
    keyed = sets.select("digest", F.col("doc_id").alias("node"), "keys", "sig").join(nodes, ["digest", "node"])
    keys = keyed.select("node", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("z"), F.count("*").alias("c")).where("pivot < z")
    shared = tables.save(shared.select("key", "pivot", (F.col("c") == 2).alias("alone")))
    met = tables.save(keys.join(shared, "key").where("node > pivot").groupBy("node", "pivot").agg(F.count("*").alias("c"), F.min("alone").alias("alone")))
    tables.drop(shared)
    members = tables.save(met.select("node").union(met.select("pivot")).distinct())
    sigs = tables.save(keyed.select("node", "n", "sig").join(members, "node").dropDuplicates(["node"]))
    others = sigs.select(F.col("node").alias("pivot"), F.col("n").alias("other_n"), F.col("sig").alias("other_sig"))
    edges = met.join(sigs, "node").join(others, "pivot").select("node", "pivot", "n", "other_n", "c", "alone", "sig", "other_sig")
    edges = edges.mapInArrow(_apart, "node long, pivot long, n long, other_n long, c long, alone boolean, d long")
    edges = tables.save(edges.withColumn("possible", (F.col("d") <= FAR) & (100 * F.least("n", "other_n") >= percent * F.greatest("n", "other_n"))).drop("d", "other_n"))
    texts = docs.join(members.select(F.col("node").alias("doc_id")).hint("merge"), "doc_id")
    texts = tables.save(chosen(texts).select(F.col("doc_id").alias("node"), "text").dropDuplicates(["node"]))
    best = edges.where("possible").groupBy("node").agg(F.max(F.struct("c", (-F.col("pivot")).alias("w"))).alias("best"))
    near = best.select(F.col("node").alias("u"), (-F.col("best.w")).alias("v")).join(texts.select(F.col("node").alias("u"), F.col("text").alias("text_u")), "u")
    near = near.join(texts.select(F.col("node").alias("v"), F.col("text").alias("text_v")), "v").select("u", "v", "text_u", "text_v")
    first = jumped(tables.save(near.mapInArrow(partial(_confirm, size=size, percent=percent), "u long, v long")), tables)  # each node hangs on one smaller node
    roots = tables.save(_placed(sigs.select("node", "n"), first, "root"))  # groups are sought between roots, as nodes of one root are linked
    sides = edges.where("possible or not alone").select("node", "pivot").join(roots.select("node", "root"), "node")
    sides = sides.join(roots.select(F.col("node").alias("pivot"), F.col("root").alias("other")), "pivot").where("root <> other")
    groups = connected(sides.select(F.col("root").alias("u"), F.col("other").alias("v")).distinct(), tables)
    held = tables.save(roots.join(groups.select(F.col("u").alias("root"), F.col("v").alias("group")), "root"))
    sizes = held.groupBy("group", "root").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("n") / SHINGLES))
    largest = sizes.groupBy("group").agg(F.max(F.struct("c", "root", "n")).alias("top"), F.sum("c").alias("all"), F.sum("n").alias("all_n")).where("top.c < all")
    left = F.greatest(F.ceil((F.col("all") - F.col("top.c")) / BLOCK), F.ceil((F.col("all_n") - F.col("top.n")) / SHINGLES))
    largest = largest.withColumn("opens", left).select("group", "opens", F.col("top.root").alias("top"), F.col("top.c").alias("c"), F.col("top.n").alias("n"))
    largest = tables.save(largest.select("group", "top", "opens", (F.col("opens") + blocks).alias("blocks")))
    todo = held.join(largest, "group").withColumn("open", F.col("root") != F.col("top"))
    spread = F.pmod(F.xxhash64("node"), F.when(F.col("open"), F.col("opens")).otherwise(F.col("blocks") - F.col("opens")))
    todo = todo.withColumn("b", spread + F.when(F.col("open"), F.lit(0)).otherwise(F.col("opens")))
    todo = todo.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("open"), F.col("blocks")).otherwise(F.col("opens")) - 1)))
    todo = todo.select("group", F.least("b", "k").alias("i"), F.greatest("b", "k").alias("j"), "node", "root", "open")
    todo = todo.join(texts, "node")
    more = todo.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "node").select("group", "i", "j", "node", "root", "open", "text")
    more = tables.save(more.mapInArrow(partial(_blocks, size=size, percent=percent), "u long, v long"))
    parts = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
    if not more.isEmpty():
        parts = _placed(parts.select(F.col("u"), F.col("v").alias("node")), connected(more, tables), "top").select("u", F.col("top").alias("v"))
    ends = nodes.join(parts.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    ends = tables.save(ends)
    whole = sketch.select("doc_id", "n_shingles", "digest").join(several.select("doc_id", "own_digest"), "doc_id", "left")
    whole = whole.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("own_digest", "digest")).alias("digest"))
    tables.drop(largest, texts, met, members, sigs, edges, more, held, roots, nodes)
    out = whole.join(ends, "digest", "left").withColumn("component_id", F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
