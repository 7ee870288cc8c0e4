"""Benchmark passages in documents: CGK random-walk embedding, bit-sampling LSH, exact edit verification.

Documents and items are word sequences (lower case, punctuation dropped). A CGK walk reads a sequence with a pointer
that stays or moves on by a random bit for each step and word, so that few edits leave most of the walk's outputs
equal: edit distance becomes Hamming distance. Each of REPEATS tables samples SAMPLED steps of its own walk; a place in
a document whose sampled outputs equal those of a piece of an item (an item has up to PIECES pieces of LEAST words,
begun at its words that fewest items use) makes the item-sized window there a candidate. Tables are read as tries, so a
walk stops at the first output that no item has.

Walks may miss a passage: all begin at a piece's exact first word, and short items have one piece or few. The exact way
beside them: every item is cut, from its first word to its last, into one part more than the edits allowed, so one part
of every passage within the limit is unedited; each place where a part's words (LEAST at most) stand is a candidate, too.
So no hit is lost for a similarity above 0, and the walks alone find none that the parts do not. A candidate counts if the edit distance in words between item and best window is at most 1 - SIMILARITY of the item.

Items are taken in blocks of BLOCK, each in tasks of its own, so what a worker holds is bounded (it keeps the index of the
last block); documents are never joined or shuffled.

Defined cases: null or empty text or item has no hit; items shorter than the least piece are walked with a group of
their own length; several hits of one item in a document count once, with the least distance and its first place;
equal items are reported each; an empty table gives an empty result; other columns of the documents go through.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

REPEATS, SAMPLED, PIECES, LEAST, SIMILARITY, BLOCK = 10, 6, 8, 12, 0.8, 20_000
_TO_SPACE = bytes(32 if c < 48 or 57 < c < 97 or 122 < c < 128 else c for c in range(256))
PAD = np.uint64(0)


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_TO_SPACE).split()


def _bits(h: np.ndarray, repeat: int) -> np.ndarray:
    """A word's bits for the steps of one walk."""
    return C.mix(h ^ np.uint64(pow(C.ODD, repeat + 1, 1 << 64)))


def _plan(piece: int) -> list[list[int]]:
    """Sampled steps of each repeat after the first word: one in each stretch of twice the piece (the pointer moves at half the steps)."""
    rng = np.random.default_rng(7)
    cuts = np.linspace(0, min(60, 2 * piece - 2), SAMPLED)
    return [sorted({int(rng.integers(int((a + 2 * z) / 3), int(z) + 1)) for a, z in zip(cuts, cuts[1:], strict=False)}) for _ in range(REPEATS)]


def walk(h: np.ndarray, bits: np.ndarray, at: np.ndarray, step: int, to: int) -> np.ndarray:
    """Moves pointers from one step to another; beyond the end they read PAD and stay."""
    n = len(h) - 1  # h ends with PAD, bits with 0
    for t in range(step, to):
        at = np.minimum(at + ((bits[at] >> np.uint64(t)) & np.uint64(1)).astype(np.int64), n)
    return at


def edit_place(item: list, words: list) -> tuple[int, int]:
    """Least edit distance of the item to any run of the words, and the first end of such a run (bit-parallel)."""
    m, masks = len(item), {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, (m, 0)
    for j, w in enumerate(words):
        eq = masks.get(w, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        plus = down | (full & ~(zero | up))
        minus = up & zero
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(zero | plus)), plus & zero
        if score < best[0]:
            best = (score, j + 1)
    return best


def _table(found: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """A set of hashes, with a bitmap of their low bits."""
    full = np.sort(np.fromiter(found, np.uint64, len(found)))
    quick = np.zeros(1 << 16, bool)
    quick[(full & np.uint64(0xFFFF)).astype(np.int64)] = True
    return quick, full


def _among(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    quick, full = table
    on = np.flatnonzero(quick[(keys & np.uint64(0xFFFF)).astype(np.int64)])
    return on[full[np.minimum(np.searchsorted(full, keys[on]), len(full) - 1)] == keys[on]]


class ItemIndex:
    """The items' tries: by piece length, the start words of pieces and for each repeat the prefix hashes and pieces; by length, the hashes of their parts."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY):
        self.items = {k: normal_words(t) for k, t in items}
        self.allowed = {k: int((1 - similarity) * len(w) + 1e-9) for k, w in self.items.items()}
        self.sets = {k: set(w) for k, w in self.items.items()}
        use = Counter(x for w in self.items.values() for x in set(w))
        by_piece: dict[int, list] = {}
        for k, w in self.items.items():
            if w:
                piece = min(len(w), LEAST)
                rarest = sorted(range(len(w) - piece + 1), key=lambda i: (use[w[i]], i))
                by_piece.setdefault(piece, []).append((k, rarest[:PIECES]))
        self.groups = []
        for piece, chosen in sorted(by_piece.items()):
            plan = _plan(piece)
            levels: list[list[set]] = [[set() for _ in steps] for steps in plan]
            ends: list[dict] = [{} for _ in plan]
            heads: set[int] = set()
            for k, starts in chosen:
                h = np.append(C.word_hashes(self.items[k]), PAD)
                heads.update(h[starts].tolist())
                for r, steps in enumerate(plan):
                    bits = np.append(_bits(h[:-1], r), PAD)
                    at, step, key = np.array(starts), 0, h[starts]
                    for d, to in enumerate(steps):
                        at, step = walk(h, bits, at, step, to), to
                        key = C.mix(key ^ h[at])
                        levels[r][d].update(key.tolist())
                    for s, x in zip(starts, key.tolist(), strict=True):
                        ends[r].setdefault(x, []).append((k, s))
            self.groups.append((_table(heads), [(r, steps, [_table(x) for x in levels[r]], ends[r]) for r, steps in enumerate(plan)]))
        parts: dict[int, dict[int, list]] = {}
        for k, w in self.items.items():
            if w:
                h = C.word_hashes(w)
                n = min(self.allowed[k] + 1, len(w))
                cuts = [len(w) * i // n for i in range(n + 1)]
                for a, z in zip(cuts, cuts[1:], strict=False):
                    size = min(z - a, LEAST)
                    parts.setdefault(size, {}).setdefault(int(C.gram_hashes(h[a : a + size], size)[0]), []).append((k, a))
        self.parts = [(size, _table(set(ends)), ends) for size, ends in sorted(parts.items())]

    def candidates(self, h: np.ndarray) -> set[tuple[int, int]]:
        """(item, place where it would start); PAD in h ends a document."""
        out: set[tuple[int, int]] = set()
        for heads, tries in self.groups:
            begin = _among(heads, h)
            for r, steps, tables, ends in tries:
                start = at = begin
                step, key = 0, h[begin]
                for table, to in zip(tables, steps, strict=True):
                    for t in range(step, to):  # bits only of the words that are read
                        here = h[at]
                        at = at + ((_bits(here, r) >> np.uint64(t)) & np.uint64(1) & (here != PAD)).astype(np.int64)
                    step = to
                    key = C.mix(key ^ h[at])
                    on = _among(table, key)
                    start, at, key = start[on], at[on], key[on]
                    if not len(on):
                        break
                for s, x in zip(start.tolist(), key.tolist(), strict=True):
                    out.update((k, s - off, s) for k, off in ends[x])
        for size, table, ends in self.parts:
            grams = C.gram_hashes(h, size)
            on = _among(table, grams)
            for s, x in zip(on.tolist(), grams[on].tolist(), strict=True):
                out.update((k, s - off, s) for k, off in ends[x])
        return out

    def hits(self, texts: list[str | None]) -> list[list[dict]]:
        """For each text the items found in it. Texts are walked together, which costs fewer calls."""
        words = [normal_words(t) for t in texts]
        ends = np.cumsum([len(w) + 1 for w in words])
        h = np.zeros(int(ends[-1]) if len(words) else 0, np.uint64)
        h[np.setdiff1d(np.arange(len(h)), ends - 1, assume_unique=True)] = C.word_hashes([x for w in words for x in w])
        found = list(self.candidates(h)) if self.groups else []
        best: list[dict[int, tuple[int, int]]] = [{} for _ in words]
        docs = np.searchsorted(ends, [s for _, _, s in found], side="right").tolist()
        for k, place, d in sorted({(k, place, d) for (k, place, _), d in zip(found, docs, strict=True)}):
            if best[d].get(k, (1, 0))[0] == 0:  # places ascend: no later one is better
                continue
            item, allowed, w = self.items[k], self.allowed[k], words[d]
            s = place - int(ends[d]) + 1 + len(w)
            lo = max(0, s - allowed)
            window = w[lo : max(0, s + len(item) + allowed)]
            if len(self.sets[k].intersection(window)) < len(self.sets[k]) - allowed:  # each missing word costs an edit
                continue
            distance, end = edit_place(item, window)
            if distance <= allowed and (k not in best[d] or (distance, lo + end) < best[d][k]):
                best[d][k] = (distance, lo + end)
        return [[{"item_id": k, "distance": x, "word_end": e, "item_words": len(self.items[k])} for k, (x, e) in sorted(b.items())] for b in best]


_LOADED: dict[tuple, ItemIndex] = {}


def loaded(rows: list[tuple[int, str]], similarity: float) -> ItemIndex:
    """A worker's index, kept from task to task; only the last one is."""
    key = (similarity, hashlib.sha256(repr(rows).encode()).digest())
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ItemIndex(rows, similarity)
    return _LOADED[key]


def _blocks(benchmark: DataFrame, block: int):
    rows = []
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null").orderBy("item_id").toLocalIterator():
        rows.append((row[0], row[1]))
        if len(rows) == block:
            yield rows
            rows = []
    if rows:
        yield rows


HITS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("item_id", "distance", "word_end", "item_words")]))


def find_items(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """The documents with a column `hits`: the items found in each, with distance and place."""
    C.small_batches(docs.sparkSession, 300)
    columns, more = [c for c in docs.columns if c != "hits"], C.free_name(docs, "new_hits")
    out = docs.select(*columns).withColumn("hits", F.array().cast(HITS))
    tables, any_before = C.Scratch(docs.sparkSession, "items"), False
    for rows in _blocks(benchmark, block):

        def make(rows=rows):
            index = loaded(rows, similarity)
            return lambda texts: [index.hits(texts)]

        if any_before:  # each block in tasks of its own
            out = tables.save(out)
        any_before = True
        out = C.map_rows(out, make, [T.StructField(more, HITS)]).withColumn("hits", F.concat("hits", more)).drop(more)
    return out
