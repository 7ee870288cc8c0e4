"""The operators against brute force, exact round trips and the libraries they stand in for."""

import base64
import hashlib
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulseweave.llm import bpe, common, decontaminate, jpeg, media, near_dedup, secrets, substring_dedup, token_counts, token_files
from pulseweave.llm.common import shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def same(found, expected):
    assert Counter(found) == Counter(expected)


def test_substring_dedup(docs, rows, empty):
    first, expected = {}, []
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - 49):
            if d is not None:
                k = tuple(w[i : i + 50])
                first[k] = min(first.get(k, d), d)
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = {j for i in range(len(w) - 49) if d is not None and first[tuple(w[i : i + 50])] < d for j in range(i, i + 50)}
        expected.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    out = substring_dedup.dedup_substrings(docs)
    same([tuple(r) for r in out.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()], expected)
    assert all(sha(r["kept_text"]) == r["kept_sha256"] for r in out.where("n_removed > 0").collect())
    assert sum(n for _, _, n, _ in expected) > 1000
    assert substring_dedup.dedup_substrings(empty).count() == 0


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), max_size=4), st.lists(st.sampled_from("abc"), max_size=20), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_suffix_automaton(passages, words, least):
    automaton = substring_dedup.SuffixAutomaton()
    for p in passages:
        automaton.add(p)
    runs = {tuple(p[i : i + least]) for p in passages for i in range(len(p) - least + 1)}
    covered = {j for i in range(len(words) - least + 1) if tuple(words[i : i + least]) in runs for j in range(i, i + least)}
    assert {j for a, z in automaton.spans(words, least) for j in range(a, z)} == covered


def brute_components(rows, size, percent):
    sets = {}
    for d, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        s = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
        sets.setdefault(d, []).append(s)
    parent = {d: d for d in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(set)
    for d, many in sets.items():
        for s in many:
            for g in s:
                holders[g].add(d)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a is not None and b is not None and a < b}
    for a, b in pairs:
        s, u = sets[a][0], sets[b][0]
        if 100 * len(s & u) >= percent * len(s | u):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return [(d, len(sets[d][0]) if d is not None else len({tuple(x) for x in near_dedup.shingle_set(t, size)}), root(d) if d is not None else None, d is None or root(d) == d) for d, t in rows]


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_dedup(docs, rows, empty, size, percent):
    expected = brute_components(rows, size, percent)
    same([tuple(r) for r in near_dedup.link_components(docs, size, percent).collect()], expected)
    assert any(c != d for d, _, c, _ in expected)
    assert near_dedup.link_components(empty, size, percent).count() == 0


def test_near_dedup_chain(spark):
    """Neighbours of a chain are linked though its ends are not, and a large group of near copies is one component."""
    words = [f"v{i}" for i in range(400)]
    chain = [(k, " ".join([*(f"n{k}_{i}" for i in range(0)), *words[12 * k : 12 * k + 300]])) for k in range(9)]
    group = [(1000 + k, " ".join([f"u{k}", *(f"g{i}" for i in range(120)), f"t{k % 7}"])) for k in range(300)]
    rows = chain + group
    found = near_dedup.link_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    same([tuple(r) for r in found.collect()], brute_components(rows, 3, 85))


def test_secrets(docs, rows):
    model = secrets.train(docs)
    found = secrets.scan_secrets(docs, model).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans").collect()
    expected, seen = [], {}
    for d, t in rows:
        t, spans = t or "", []
        for k, (name, p, least, group) in enumerate([("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2), ("access", r"AKIA[A-Z0-9]+", 20, 0), ("hex", r"[0-9a-f]+", 24, 0)]):
            spans += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(p, t) if len(m[group]) >= least]
        names = [x[2].split(":")[0] for x in spans]
        base = ",".join(x[2] for x in sorted(spans))
        expected.append((d, names.count("assign"), names.count("access"), names.count("hex"), sha(base)))
        seen[d, t] = {x[2] for x in spans}
    same([tuple(r)[:5] for r in found], expected)
    assert all(set(filter(None, r["spans"].split(","))) >= seen[r["doc_id"], t or ""] for r in found for d, t in rows if d is not None and d == r["doc_id"])
    assert model.secret("q7Zx91LmPq84TrWn02Vb") and not model.secret("internationalisation") and not model.secret("enunglichschverieein")
    text = "key q7Zx91LmPq84TrWn02Vb and internationalisation"
    assert [k for _, _, k in secrets.find_spans(text, model)[1]] == ["model"]


def test_redact(docs, rows, empty):
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    assert kept[100000] is None and "hunter22" not in kept[100050] and "deadbeef" not in kept[100051] and kept[100003] == "one"
    assert secrets.redact(empty).count() == 0


def test_edit_place():
    rng = np.random.default_rng(1)
    for _ in range(500):
        a, b = (rng.integers(0, 4, rng.integers(1, n)).tolist() for n in (12, 25))
        last = [0] * (len(b) + 1)
        for i, x in enumerate(a):
            now = [i + 1]
            for j, y in enumerate(b):
                now.append(min(last[j + 1] + 1, now[j] + 1, last[j] + (x != y)))
            last = now
        assert decontaminate.edit_place(a, b)[0] == min(last)


def test_decontaminate(spark, docs, rows, empty):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()] + [(900, None), (901, ""), (902, "one two"), (None, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.find_items(docs, bench, block=25)
    found = {(r["doc_id"], h["item_id"]): h["distance"] for r in out.collect() for h in r["hits"]}
    for d, t in rows:
        words = decontaminate.normal_words(t)
        for k, x in items:
            item = decontaminate.normal_words(x)
            if not item or k is None:
                continue
            allowed = int(0.2 * len(item) + 1e-9)
            distance = decontaminate.edit_place(item, words)[0] if set(item) & set(words) else len(item)
            assert ((d, k) in found) == (distance <= allowed), (d, k, distance)
            if (d, k) in found:
                assert found[d, k] == distance
    assert len(found) > 3
    assert decontaminate.find_items(empty, bench).count() == 0


def test_decontaminate_recall():
    """Items edited at random within the threshold, in other text."""
    rng = np.random.default_rng(2)
    items = [(i, " ".join(f"k{x}" for x in rng.integers(0, 900, rng.integers(15, 60)))) for i in range(150)]
    index, texts = decontaminate.ItemIndex(items), []
    for _, t in items:
        w = t.split()
        for _ in range(int(0.12 * len(w))):
            at, kind = int(rng.integers(len(w))), rng.random()
            w[at : at + 1] = [] if kind < 0.3 else ["new"] if kind < 0.7 else [w[at], "more"]
        texts.append(" ".join([*(f"f{x}" for x in rng.integers(0, 900, 80)), *w, *(f"f{x}" for x in rng.integers(0, 900, 80))]))
    hits = index.hits(texts)
    assert sum(any(h["item_id"] == i for h in found) for i, found in enumerate(hits)) >= 0.97 * len(items)
    assert all(h["item_id"] == i for i, found in enumerate(hits) for h in found)


def edited(words: list[str], edits: int, rng, first: int | None = None) -> list[str]:
    """The words after so many edits: anywhere, or at the words before place `first`."""
    out = list(words)
    for i in range(edits):
        at, kind = int(rng.integers(len(out) if first is None else max(1, first - i))), rng.random()
        out[at : at + 1] = [] if kind < 0.3 else ["new"] if kind < 0.7 else [out[at], "more"]
    return out


def assert_all_found(items: list[tuple[int, str]], rng) -> None:
    """Items with all the edits that the limit allows, in other text: distance and place as by brute force, none lost."""
    index = decontaminate.ItemIndex(items)
    texts = []
    for k, t in items:
        w, fill = t.split(), [f"f{x}" for x in rng.integers(0, 900, 60)]
        cut = len(w) // 5  # the first fifth gone, rewritten or edited, then edits anywhere
        for body in (w[cut:], ["new"] * cut + w[cut:], edited(w, index.allowed[k], rng, first=max(1, cut)), edited(w, index.allowed[k], rng)):
            texts.append((k, " ".join([*fill[:30], *body, *fill[30:]])))
    hits = index.hits([t for _, t in texts])
    for (k, t), found in zip(texts, hits, strict=True):
        distance, end = decontaminate.edit_place(index.items[k], decontaminate.normal_words(t))
        assert distance <= index.allowed[k]
        assert {"item_id": k, "distance": distance, "word_end": end, "item_words": len(index.items[k])} in found, (k, t)


def test_decontaminate_whole_item(spark):
    """Long items are searched by all their words: real ones and ones whose words are equally rare."""
    rng = np.random.default_rng(4)
    real = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").orderBy("item_id").collect()]
    assert_all_found([(k, " ".join(w.decode() for w in decontaminate.normal_words(t))) for k, t in real], rng)
    assert_all_found([(i, " ".join(f"k{i}x{j}" for j in range(n))) for i, n in enumerate(range(13, 130))], rng)


def test_decontaminate_short_items():
    """Items of few words, also with the first words edited, and parts of common words that several items share."""
    rng = np.random.default_rng(6)
    assert_all_found([(i, " ".join(f"s{i}x{j}" for j in range(1 + i % 14))) for i in range(280)], rng)
    assert_all_found([(i, " ".join(f"c{x}" for x in rng.integers(0, 40, 5 + i % 10))) for i in range(200)], rng)


def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, rows, empty):
    own, expected = tiktoken_encoding(), []
    for d, t in rows:
        ids = own.encode_ordinary(t or "")
        expected.append((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t or "")))
    out = bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    same([tuple(r) for r in out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()], expected)
    assert bpe.encode_documents(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


@given(st.lists(st.text(max_size=40), max_size=5))
@settings(max_examples=300, deadline=None)
def test_bpe_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    tool = bpe.loaded(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    own = test_bpe_any_text.__dict__.setdefault("own", None) or tiktoken_encoding()
    test_bpe_any_text.own = own
    codes = tool.encode(texts)
    assert [np.frombuffer(c, "<u4").tolist() for c in codes] == [own.encode_ordinary(t) for t in texts]
    assert [tool.decode(c) for c in codes] == [t.encode() for t in texts]


@given(st.lists(st.binary(min_size=1, max_size=12), max_size=6), st.integers(0, 60), st.randoms())
@settings(max_examples=200, deadline=None)
def test_merge_replay_of_any_ranks(words, merges, rng):
    """Ranks in any order: a merge may make a pair of lower rank than its own."""
    words = [bytes(c % 3 + 97 for c in w) for w in words]
    ranks = {bytes([i]): i for i in range(256)}
    longer = ["".join(x).encode() for n in (2, 3, 4) for x in __import__("itertools").product("abc", repeat=n)]
    rng.shuffle(longer)
    for t in longer[:merges]:
        ranks[t] = len(ranks)
    tool = bpe.MergeReplay(ranks, ".+")

    def alone(word):
        parts = [bytes([c]) for c in word]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                return [ranks[p] for p in parts]
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    expected = [alone(w) for w in words]
    assert tool.replay(words) == expected
    if words:
        ids, sizes = tool.waves(words)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == expected
    assert [np.frombuffer(x, "<u4").tolist() for x in tool.encode([w.decode() for w in words])] == expected


def test_bpe_long_words():
    """Words on both sides of the length from which merges are replayed place by place, and a table that forgets."""
    tool, own, rng = bpe.MergeReplay(bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN), tiktoken_encoding(), random.Random(3)
    texts = ["".join(rng.choices("abcdetnoé", k=k)) for k in (1, bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, 4000)] + ["a" * 3000, "é" * 300, " " * 500]
    for _ in range(3):
        assert [np.frombuffer(x, "<u4").tolist() for x in tool.encode(texts)] == [own.encode_ordinary(t) for t in texts]
        tool.table.forget_half()


def test_word_hashes():
    """Hashes of a column's words: equal for equal words only, whatever stands around them."""
    rng = random.Random(5)
    texts = ["".join(rng.choices("abAB \t\n\u00a0é", k=rng.randint(0, 40))) for _ in range(500)] + [None, "", " ", "q" * 500 + " " + "q" * 499, "x" * 70 + "y", "x" * 70 + "z"]
    for lower in (False, True):
        for column in (pa.array(texts), pa.array(texts).slice(3, 200), pa.array(texts, pa.large_string())):
            h, at = common.column_words(column, lower)
            names: dict = {}
            for t, a, z in zip(column.to_pylist(), at[:-1], at[1:]):
                words = (t or "").encode()
                words = (words.lower() if lower else words).split()
                assert len(words) == z - a
                assert all(names.setdefault(w, x) == x for w, x in zip(words, h[a:z].tolist()))
            assert len(set(names.values())) == len(names)


def test_token_files(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    folder = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    token_files.write_tokens(docs, P.path("word_bpe_49k.json"), folder)
    found = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r["start"])
    ids = {t: [*tool.encode(t or "", add_special_tokens=False).ids, 2] for _, t in rows}
    same([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found], [(d, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())) for d, t in rows])
    at = 0
    for r in found:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    order = [r["doc_id"] for r in found]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    token_files.write_tokens(empty, P.path("word_bpe_49k.json"), folder + "-empty")
    assert token_files.read_tokens(spark, folder + "-empty").count() == 0


def test_token_file_starts(spark, monkeypatch):
    """Starts come from the blocks and a row a part file: also with many blocks a task, cut into several files, and
    without moving any block."""
    monkeypatch.setattr(token_files, "BLOCK", 20)
    texts = spark.range(300).selectExpr("id as doc_id", "repeat('some words ', cast(id % 9 as int)) as text").repartition(5)
    folder = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "2")
    try:
        token_files.write_tokens(texts, P.path("word_bpe_49k.json"), folder)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    blocks = spark.read.parquet(f"{folder}/blocks")
    assert blocks.count() > 40 and len({f.rsplit("/", 1)[1].split("-")[1] for f in blocks.inputFiles()}) < len(blocks.inputFiles())
    back = token_files.read_tokens(spark, folder)
    assert "Exchange" not in back._jdf.queryExecution().executedPlan().toString()
    at = 0
    for i, r in enumerate(sorted(back.collect(), key=lambda r: r["doc_id"])):
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (i, at, 2 * (i % 9) + 1)
        at += r["n_tokens"]


@given(st.lists(st.text(st.sampled_from("aBéΣİ²ß1.!'<|> s\u0301"), max_size=30), max_size=4))
@settings(max_examples=200, deadline=None)
def test_word_ids(texts):
    tool = token_files.encoder(P.path("word_bpe_49k.json"))
    tool.table.clear()
    found = [np.frombuffer(x, tool.wide).tolist() for x in tool.encode(texts)]
    assert found == [tool.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
@settings(max_examples=200, deadline=None)
def test_codes(codes):
    control, data = token_files.pack(np.array(codes, np.uint32))
    assert token_files.unpack(control, data, len(codes)).tolist() == codes


def test_token_counts(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path, cache = P.path("byte_bpe_50k.json"), f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    tool = Tokenizer.from_file(path)
    expected = [(d, len((t or "").encode()), n := len(tool.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t in rows]
    for _ in range(2):  # the second run finds all counts in the cache
        out = token_counts.count_tokens(docs, path, cache)
        same([tuple(r) for r in out.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()], expected)
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in rows})
    assert token_counts.count_tokens(empty, path, cache + "-empty").count() == 0


def test_sentencepiece_counts():
    import sentencepiece

    texts = ["", "a b", " lead  two\n"]
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert token_counts.counter(P.path("piece_bpe_32k.model")).counts(texts) == [len(model.encode(t)) for t in texts]


def test_media(docs, rows, empty):
    out = media.media_features(docs).collect()
    expected = []
    for d, t in rows:
        data = (t or "").encode()
        padded = data + b" " * (192 - len(data) if len(data) < 192 else -len(data) % 192)
        expected.append((d, len(data), len(padded), sha(padded), zlib.crc32(padded[-16:])))
    same([(r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in out], expected)
    files = media.clip_rows(media.encode_media(docs)).collect()
    same([(len(r["media"]), sha(bytes(r["media"]))) for r in files], [(r["media_bytes"], r["media_sha256"]) for r in out])
    assert all(media.restore(bytes(r["media"])) == media.payload(r["text"]) for r in files)
    assert all(sum(c["frames"] for c in r["clips"]) == len(media.payload(r["text"])) // 192 for r in files)
    assert media.media_features(empty).count() == 0


def test_media_reading():
    frames = np.random.default_rng(3).integers(0, 256, (5, 192)).astype(np.uint8)
    coded = jpeg.write_frames(frames)
    for f, samples in zip(coded, frames, strict=True):  # the general reader sees uniform blocks of the samples
        pixels = jpeg.read_luma(f)
        assert pixels.shape == (96, 128)
        assert (pixels == np.kron(samples.reshape(12, 16), np.ones((8, 8), int))).all()
    whole = media.write_avi(coded, 128, 96)
    assert media.read_avi(whole)[1] == coded
    assert media.read_avi(whole[: whole.index(b"idx1")])[1] == coded  # no index
    assert media.read_avi(whole[:900])[1] == coded[:1]  # cut short
    with pytest.raises(ValueError):
        media.read_avi(b"RIFFnope")


def test_shots():
    dark, light = np.full(192, 20, np.uint8), np.full(192, 200, np.uint8)
    data = media.write_avi(jpeg.write_frames(np.array([dark] * 4 + [light] * 5 + [dark] * 2)), 128, 96)
    found = media.clips(data)
    assert [(c["first"], c["frames"], c["start_ms"], c["end_ms"], c["level"]) for c in found] == [(0, 4, 0, 160, 20), (4, 5, 160, 360, 200), (9, 2, 360, 440, 20)]


def test_clashing_names(spark):
    """Extra columns named like those that operators use on the way go through unchanged."""
    docs = spark.createDataFrame([(1, "token=abcdefgh one", "a", "b", "c")], "doc_id long, text string, content string, Original_Text string, new_hits string")
    bench = spark.createDataFrame([(1, "other words")], "item_id long, text string")
    folder = f"{shared_dir(spark)}/clash-{uuid.uuid4().hex}"
    for out in (secrets.redact(docs), decontaminate.find_items(docs, bench), token_counts.count_tokens(docs, P.path("byte_bpe_50k.json"), folder)):
        assert tuple(out.select("content", "Original_Text", "new_hits").first()) == ("a", "b", "c")
