"""Byte-level BPE by merge replay over a corpus of distinct words, and decoding.

A task's texts are cut into words; the distinct ones that the worker has not met are encoded together, with the ranks of
all their pairs side by side. A wave applies to every word the merge of its least rank at its first place, and only the
pairs beside the merges get new ranks. Words do not touch, so each sees the merges in the order of ranks. Long words,
whose merges are many, are replayed by an inverted index from rank to places: the least rank is merged at all its
places, and only the pairs beside them go into the index. Ids of all words lie in one array, from which a batch of texts
gathers its own; decoding gathers the tokens' bytes likewise.

Defined cases: null text is empty; empty text has no ids and the digests of no bytes; a vocabulary lacking a single
byte is refused; words met keep their ids in a table of bounded bytes; other columns go through, those named like an
output are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common as C

#: No rank; bytes of a word that is replayed place by place; words replayed together; pairs remembered.
NONE, LONG, TOGETHER, PAIRS = 1 << 40, 128, 20_000, 250_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeReplay:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if missing := [i for i in range(256) if bytes([i]) not in ranks]:
            raise ValueError(f"the vocabulary lacks the bytes {missing[:5]}")
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {i: t for t, i in ranks.items()}
        self.bytes_ = np.array([ranks[bytes([i])] for i in range(256)])
        self.doubles = np.array([ranks.get(bytes([a, b]), NONE) for a in range(256) for b in range(256)])
        # all pairs that merge, sorted, with their ranks
        found = sorted((a << 32 | b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None)
        self.pair_keys, self.pair_ranks = np.array(found + [(1 << 62, NONE)], np.int64).T.copy()
        # bytes of all tokens, one after the other
        lengths = np.zeros(max(self.tokens) + 1, np.int64)
        lengths[list(self.tokens)] = [len(t) for t in self.tokens.values()]
        self.token_length, self.token_start = lengths, np.cumsum(lengths) - lengths
        self.token_bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(len(lengths))), np.uint8)
        self.pairs: dict[tuple[int, int], int | None] = {}
        self.table = C.WordTable(self.learn, "<u4", C.TABLE_BYTES // 2)  # new words cost little here

    def merged(self, pair: tuple[int, int]) -> int | None:
        if pair not in self.pairs:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[pair] = self.ranks.get(self.tokens[pair[0]] + self.tokens[pair[1]])
        return self.pairs[pair]

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def waves(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words (none empty), one word after the other, and how many each has.

        All words are replayed together: a wave merges in every word the leftmost pair of its least rank, and looks up
        only the pairs beside it. Words do not touch each other, so that is the order of ranks for each of them.
        """
        flat = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words])
        ids, word = self.bytes_[flat], np.repeat(np.arange(len(words)), size)
        rank = np.full(len(flat), NONE)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self.doubles[flat[inner].astype(np.int64) << 8 | flat[inner + 1]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(rank, first)
            size = np.diff(first, append=len(ids))
            over = np.repeat(least == NONE, size)
            if over.any():
                done.append((word[over], ids[over]))
                ids, word, rank = ids[~over], word[~over], rank[~over]
                size, least = size[least != NONE], least[least != NONE]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            at = at[np.diff(word[at], prepend=-1) != 0]
            ids[at] = least
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, word, rank = ids[keep], word[keep], rank[keep]
            at -= np.arange(len(at))  # where they are now
            for left in (at, at - 1):
                left = left[(left >= 0) & (left + 1 < len(ids))]
                left = left[word[left] == word[left + 1]]
                rank[left] = self.pair_rank(ids[left], ids[left + 1])
            last = at[(at + 1 == len(ids)) | (word[np.minimum(at + 1, len(ids) - 1)] != word[at])]
            rank[last] = NONE
        word, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """The same for long words, whose merges are many and in few words: an index from rank to places, and a heap of ranks."""
        if not words:
            return []
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ends = np.cumsum([len(w) for w in words])
        starts = [0, *ends[:-1].tolist()]
        right, left = np.arange(1, len(flat) + 1), np.arange(-1, len(flat) - 1)
        filled = ends[np.diff(ends, prepend=0) > 0]
        right[filled - 1], left[filled[:-1]] = -1, -1
        ids, after, before = self.bytes_[flat].tolist(), right.tolist(), left.tolist()
        # the index: rank of the merge -> left places
        at = np.flatnonzero(right >= 0)
        ranks = self.doubles[flat[at] * 256 + flat[at + 1]]
        at, ranks = at[ranks < NONE], ranks[ranks < NONE]
        order = np.argsort(ranks, kind="stable")
        heads, first = np.unique(ranks[order], return_index=True)
        heap = heads.tolist()  # sorted, so a heap
        where: dict[int, list[int]] = {r: x.tolist() for r, x in zip(heap, np.split(at[order], first[1:]), strict=True)} if heap else {}
        merged = self.merged

        def put(i: int, j: int) -> None:
            if (rank := merged((ids[i], ids[j]))) is not None:
                places = where.get(rank)
                if places is None:
                    where[rank] = [i]
                    heapq.heappush(heap, rank)
                else:
                    places.append(i)

        while heap:
            rank = heapq.heappop(heap)
            places = sorted(where.pop(rank))  # left to right, as equal ranks are merged
            for k, i in enumerate(places):
                if heap and heap[0] < rank:  # a merge just done made a pair of lower rank: that comes first
                    where[rank] = places[k:] + where.get(rank, [])
                    heapq.heappush(heap, rank)
                    break
                j = after[i]
                if ids[i] < 0 or j < 0 or merged((ids[i], ids[j])) != rank:
                    continue  # a neighbour has taken part in another merge
                ids[i], ids[j] = rank, -1
                after[i] = j = after[j]
                if j >= 0:
                    before[j] = i
                    put(i, j)
                if (j := before[i]) >= 0:
                    put(j, i)
        out = []
        for s, w in zip(starts, words, strict=True):
            got, i = [], s if w else -1
            while i >= 0:
                got.append(ids[i])
                i = after[i]
            out.append(got)
        return out

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode() for w in words]
        size = np.array([len(w) for w in raw])
        short, long = np.flatnonzero(size <= LONG), np.flatnonzero(size > LONG).tolist()
        parts = [self.waves([raw[i] for i in short[k : k + TOGETHER].tolist()]) for k in range(0, len(short), TOGETHER)]
        others = self.replay([raw[i] for i in long])
        for part, n in parts:
            size[short[: len(n)]], short = n, np.roll(short, -len(n))
        size[long] = [len(x) for x in others]
        start, out = np.cumsum(size) - size, np.empty(int(size.sum()), np.int64)
        if parts:
            out[C.ragged(start[short], size[short])] = np.concatenate([x for x, _ in parts])
        for i, x in zip(long, others, strict=True):
            out[start[i] : start[i] + len(x)] = x
        return out, size

    def flat_ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where those of each text begin, with the total behind."""
        return self.table.look_up(self.pattern.findall, texts)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian integers."""
        ids, at = self.flat_ids(texts)
        return [ids[a:z].tobytes() for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def flat_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids, and how many each has."""
        size = self.token_length[ids]
        if (size == 0).any():
            raise ValueError("an id that is not in the vocabulary")
        return self.token_bytes[C.ragged(self.token_start[ids], size)], size

    def decode(self, ids: bytes) -> bytes:
        return self.flat_bytes(np.frombuffer(ids, "<u4"))[0].tobytes()


_LOADED: dict[tuple, MergeReplay] = {}


def loaded(path: str, pattern: str) -> MergeReplay:
    """A worker's encoder, kept from task to task."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = MergeReplay(load_ranks(path), pattern)
    bpe = _LOADED[path, pattern]
    C.alone(bpe.table)
    return bpe


def encode_documents(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """The documents with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (binary)."""
    C.small_batches(docs.sparkSession)
    want_ids = ids

    def make():
        bpe = loaded(path, pattern)

        def run(texts):
            ids, at = bpe.flat_ids(texts)
            cols: list[list] = [np.diff(at).tolist(), [], [], []]
            data, size = bpe.flat_bytes(ids)
            ends = np.concatenate([[0], np.cumsum(size)])[at].tolist()
            ids, data = ids.tobytes(), memoryview(data)
            for a, z, x, y in zip(*(v[k:] if k else v[:-1] for v in (at.tolist(), ends) for k in (0, 1)), strict=True):
                cols[1].append(hashlib.sha256(ids[4 * a : 4 * z]).hexdigest())
                cols[2].append(hashlib.sha256(data[x:y]).hexdigest())
                if want_ids:
                    cols[3].append(ids[4 * a : 4 * z])
            return cols if want_ids else cols[:3]

        return run

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return C.map_rows(docs, make, fields + [T.StructField("ids", T.BinaryType())] * ids, table=True)
