"""Queries over documents against brute force, on a table with every awkward case."""

import base64
import hashlib
import random
import re
import string
import struct
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tessella.llm import bpe, chunking, language, media, minhash, packing, queries, suffix, tokens


def rows(df):
    return [r.asDict() for r in df.collect()]


def same(found, wanted):
    assert Counter(map(repr, found)) == Counter(map(repr, wanted))


def repeated_mask(texts, length):
    count = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        m = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                m[i : i + length] = True
        out.append(m)
    return out


def characters_left(text, mask):
    at, left = 0, []
    for c in text:
        n = len(c.encode())
        if not mask[at : at + n].all():
            left.append(c)
        at += n
    return "".join(left)


def test_op1_query(spark, folder, corpus_rows):
    found = rows(queries.queries()["op1_suffix_dedup"](spark, folder))
    texts = [(t or "").encode() for _, t in corpus_rows]
    wanted = []
    for (i, t), b, m, p in zip(corpus_rows, texts, repeated_mask(texts, 400), repeated_mask(texts, suffix.PASSAGE), strict=True):
        kept = bytes(np.frombuffer(b, np.uint8)[~m])
        wanted.append({"doc_id": i, "n_bytes": len(b), "n_removed": int(m.sum()), "n_spans": int((np.diff(np.concatenate([[0], m])) == 1).sum()), "kept_sha256": hashlib.sha256(kept).hexdigest(), "passage_bytes": int(p.sum()), "text": characters_left(t or "", p)})
    same(found, wanted)


@pytest.mark.parametrize("group", [suffix.GROUP, 2])
def test_op1(spark, folder, corpus_rows, group):
    docs = suffix.keyed(spark.read.parquet(f"{folder}/documents.parquet"))
    found = rows(suffix.removed(docs, suffix.repeated_spans(docs, group=group)).drop("rid", "kept"))
    texts = [(t or "").encode() for _, t in corpus_rows]
    wanted = []
    for (i, _), b, m in zip(corpus_rows, texts, repeated_mask(texts, 400), strict=True):
        kept = bytes(np.frombuffer(b, np.uint8)[~m])
        wanted.append({"doc_id": i, "n_bytes": len(b), "n_removed": int(m.sum()), "n_spans": int((np.diff(np.concatenate([[0], m])) == 1).sum()), "kept_sha256": hashlib.sha256(kept).hexdigest()})
    assert sum(w["n_removed"] for w in wanted) > 10_000
    same(found, wanted)


def test_op1_short_lengths(spark):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("ab"), 90)) for _ in range(25)] + ["ab" * 60, "ab" * 61, "a" * 80]
    docs = suffix.keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for length, group in ((40, 1000), (40, 1)):
        got = {r["doc_id"]: r["n_removed"] for r in suffix.removed(docs, suffix.repeated_spans(docs, (length,), group), length).collect()}
        assert got == {i: int(m.sum()) for i, m in enumerate(repeated_mask([t.encode() for t in texts], length))}


def test_op1_stage(spark, folder, corpus_rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = suffix.stage(spark, docs, folder)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    texts = [(t or "").encode() for _, t in corpus_rows]
    wanted = Counter()
    for (i, t), m in zip(corpus_rows, repeated_mask(texts, suffix.PASSAGE), strict=True):
        left = characters_left(t or "", m)
        if not t or left:
            wanted[i, None if t is None else left] += 1
    assert got == wanted
    # passages of 130 words that 20 documents share are gone, what stands around them stays
    assert all(0 < len(t) < 1100 for i, t in got if i is not None and 200 <= i < 220)


def test_op2(spark, folder, corpus_rows):
    found = rows(queries.queries()["op2_content_chunks"](spark, folder))
    place, where = [], defaultdict(list)
    for i, t in corpus_rows:
        b = (t or "").encode()
        ends, _ = chunking.cut(np.array([0, len(b)]), np.frombuffer(b, np.uint8))
        own = list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)) if len(ends) else []
        assert not own or own[-1][1] == len(b)
        place.append(own)
        for a, e in own:
            where[b[a:e]].append((i is None, i if i is not None else 0, b, a))
    got = defaultdict(list)
    for r in found:
        got[r["doc_id"]].append((r["n_bytes"], r["n_repeated"], r["n_removed"]))
    by_text = {}
    for (i, t), own in zip(corpus_rows, place, strict=True):
        b = (t or "").encode()
        run, runs = [], []
        for a, e in own:
            if len(where[b[a:e]]) > 1:
                if run and run[-1][1] != a:
                    runs.append(run)
                    run = []
                run.append((a, e))
        runs = [r for r in [*runs, run] if r and r[-1][1] - r[0][0] >= chunking.RUN]
        by_text.setdefault(i, []).append((len(b), sum(e - a for r in runs for a, e in r)))
    assert {k: sorted(x[:2] for x in v) for k, v in got.items()} == {k: sorted(v) for k, v in by_text.items()}
    # passages of 130 words that 20 documents share are found and stay in one of them
    passage = [got[200 + k][0] for k in range(20)]
    assert all(r[1] > 400 for r in passage) and sum(r[2] > 300 for r in passage) == 19
    assert all(r[1] == 0 for k in range(3, 60) for r in got[k])
    copies = [got[100 + k][0][2] for k in range(3)] + [got[110 + k][0][2] for k in range(3)]
    assert copies[3:] == [got[110 + k][0][0] for k in range(3)] and copies[:3] == [0, 0, 0]


def test_op2_moves_with_insertions():
    rng = np.random.default_rng(1)
    b = rng.integers(97, 123, 5000, dtype=np.uint8).tobytes()

    def pieces(x):
        ends = chunking.cut(np.array([0, len(x)]), np.frombuffer(x, np.uint8))[0].tolist()
        return {x[a:e] for a, e in zip([0, *ends[:-1]], ends, strict=True)}

    moved = b[:2000] + b"inserted" + b[2000:]
    assert len(pieces(b) - pieces(moved)) <= 4


def test_op4(spark, folder, corpus_rows):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = []
    for i, x in corpus_rows:
        ids = t.encode_ordinary(x or "")
        wanted.append({"doc_id": i, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), "decoded_sha256": hashlib.sha256((x or "").encode()).hexdigest()})
    same(rows(queries.queries()["op4_byte_bpe"](spark, folder)), wanted)


def test_op4_long_pieces():
    """Pieces whose rows merge many pairs a round, pieces that are cut, and a table in which a merge makes a pair of lesser rank."""
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    rng = random.Random(3)
    odd = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"cd": 301, b"abcd": 299, b"abab": 302, b"ba": 310, b"bcd": 305, b"aa": 303, b"aaaa": 298, b"aab": 297, b"dab": 296}
    for table, name in ((ranks, "multi"), (odd, "odd")):
        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
        if table is odd:
            with tempfile.NamedTemporaryFile("w", suffix=".tiktoken", delete=False) as f:
                f.write("".join(f"{base64.b64encode(a).decode()} {b}\n" for a, b in odd.items()))
                path = f.name
        c = bpe.Coder(path, public_tokenizers.PATTERN)
        t = tiktoken.Encoding(name, pat_str="(?s).+", mergeable_ranks=table, special_tokens={})
        alphabet = string.ascii_letters + string.digits + "+/"
        texts = ["ab" * 100, "x" * 250, "x" * 4001, "é" * 900, "the" * 700, "aab" * 500, "日本語" * 300]
        texts += ["".join(rng.choices(alphabet, k=n)) for n in (257, 700, 5000, 30000)] + ["".join(rng.choices("abcd", k=n)) for n in (40, 255, 400, 3000) for _ in range(5)]
        for x in texts:
            assert c.encode_pieces([x])[x] == np.array(t.encode_ordinary(x), "<u4").tobytes(), (name, x[:50], len(x))


def test_op6(spark, folder, corpus_rows):
    texts = [(i, (t or "").encode().lower().split()) for i, t in corpus_rows]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []) for _, w in texts]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if texts[a][0] is not None and texts[b][0] is not None and sets[a] and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(texts[a][0]), find(texts[b][0])))
                top[y] = x
    found = rows(queries.queries()["op6_minhash"](spark, folder))
    assert len(found) == len(texts)
    named = [(i, len(s), find(i), find(i) == i) for (i, _), s in zip(texts, sets, strict=True) if i is not None]
    same([(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found if r["doc_id"] is not None], named)
    assert len({n[2] for n in named}) < len({n[0] for n in named}) - 10


def test_op6_many_near_copies(spark):
    """A list longer than a task's run of partners, with texts that link through others only."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(500):
        w = list(base)
        for at in rng.choice(120, 2, replace=False):
            w[at] = f"u{k}x{at}"
        texts.append(" ".join(w))
    chain = list(base)
    for k in range(30):  # each differs from the one before by a word
        chain = list(chain)
        chain[4 * k] = f"c{k}"
        texts.append(" ".join(chain))
    found = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["component_id"] for r in found} == {0}


@pytest.mark.parametrize("block", [1, 3, minhash.BLOCK])
def test_op6_open_pairs(spark, monkeypatch, block):
    """Pairs of lists dealt in blocks are all pairs that could unite two components."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    own = {rep: (rep % 5 if rep % 3 else 0) for rep in range(24)}  # components of lists: a large one and others
    entries = [(v, rep, 40 + rep % 4, 1 + (rep + v) % 6) for v in range(4) for rep in own if rep % (v + 1) == 0]
    wanted = set()
    for v, a, n, at in entries:
        mine = [own[r] for w, r, *_ in entries if w == v]
        major = max((mine.count(c), c) for c in mine)[1]
        for w, b, m, be in entries:
            near = (1 + min(n - at, m - be)) * 175 >= (n + m) * 75
            if v == w and own[a] != own[b] and own[b] != major and (own[a] == major or a < b) and near:
                wanted.add((a, b))
    found = minhash.open_pairs(spark.createDataFrame(entries, "v long, rep long, n long, at long"), spark.createDataFrame(list(own.items()), "id long, component_id long")).collect()
    assert len(found) == len(wanted) > 50 and {(r["hub"], r["b"]) for r in found} == wanted


def test_op7(spark, folder, corpus_rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    order = sorted(corpus_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    wanted, at = [], 0
    for i, x in order:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        wanted.append({"doc_id": i, "start": at, "n_tokens": len(ids), "ids_crc32": zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))})
        at += len(ids)
    same(rows(queries.queries()["op7_wavelet_tokens"](spark, folder)), wanted)


def test_op7_words_as_whole_texts(corpus_rows):
    """Parts that are encoded by themselves give what whole texts give, also when the table of parts starts anew."""
    coder = tokens.Words(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["", " ", " a", "a ", "a  b", "x\n y", "x \ny", "<|endoftext|> a <|endoftext|>", "don't  it's  'll x", "é é  b", "a\u3000 b a \u3000b", "日本 語 x\t y", "1 22 333,a b.c \x1c d", " é\x85 b", "a\x1c b", "à la à\xa0 la \xa0"]
    for room in (0, 1, 0):
        strings = odd + [t or "" for _, t in corpus_rows]
        raw = [s.encode() for s in strings]
        got = coder.encode(strings, np.concatenate([[0], np.cumsum([len(b) for b in raw])]), np.frombuffer(b"".join(raw), np.uint8))
        assert [x.tolist() for x in got] == [x.tolist() for x in coder.whole(strings)]
        if room:
            coder._clear()


def swapped(n):
    """Two words of n bytes that polynomials modulo a power of two can't tell apart for large n: each letter of one stands for the other in the other."""
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [8, 16, 64, 128, 512, 1024, 4096])
def test_words_that_simple_hashes_confuse(spark, n):
    one, two = swapped(n)
    coder = tokens.Words(public_tokenizers.path("byte_bpe_50k.json"))
    strings = [f"x {one} y", f"x {two} y", f"{two} {one} <|endoftext|> b", f"a {two}"]
    raw = [s.encode() for s in strings]
    got = coder.encode(strings, np.concatenate([[0], np.cumsum([len(b) for b in raw])]), np.frombuffer(b"".join(raw), np.uint8))
    assert [x.tolist() for x in got] == [x.tolist() for x in coder.whole(strings)]
    texts = [f"{one} p q r s", f"{two} p q r s"]
    if n == 1024:
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert [r["component_id"] for r in minhash.near_duplicates(docs).orderBy("doc_id").collect()] == [0, 1]
        assert {r["n_repeated"] for r in chunking.deduplicated(suffix.keyed(docs), chunking.repeated_chunks(suffix.keyed(docs))).collect()} == {0}
        removed = suffix.removed(suffix.keyed(docs), suffix.repeated_spans(suffix.keyed(docs)))
        assert [r["n_removed"] for r in removed.orderBy("doc_id").collect()] == [int(m.sum()) for m in repeated_mask([t.encode() for t in texts], 400)]


def test_wavelet_queries():
    rng = np.random.default_rng(0)
    for n, top in ((1, 1), (1000, 7), (tokens.SUPER * 3, 50_000), (5000, 3)):
        ids = rng.integers(0, top, n)
        w = tokens.Wavelet.load(tokens.Wavelet.build(ids).dump())[0]
        assert (w.ids() == ids).all()
        assert [w.access(i) for i in range(0, n, 37)] == ids[::37].tolist()
        for v in {*ids[:5].tolist(), top + 5}:
            assert w.count(v) == (ids == v).sum() and w.occurrences(v) == np.flatnonzero(ids == v).tolist()
            assert w.count(v, n // 3, n // 2) == (ids[n // 3 : n // 2] == v).sum()


def test_op9(spark, folder, corpus_rows):
    found = rows(queries.queries()["op9_avi_mjpeg"](spark, folder))
    by_text = defaultdict(set)
    wanted = []
    for i, t in corpus_rows:
        b = (t or "").encode()
        p = b + b"\xff" * (max(-(-len(b) // 576), 1) * 576 - len(b))
        wanted.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    same([(r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in found], wanted)
    for r in found:
        by_text[r["payload_sha256"], r["n_bytes"]].add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by_text.values())


def test_media_pieces(spark):
    rng = np.random.default_rng(0)
    frames = np.concatenate([np.full((30, 24, 24), 10, np.uint8) + rng.integers(0, 3, (30, 24, 24), dtype=np.uint8), np.full((20, 24, 24), 200, np.uint8), rng.integers(0, 256, (4, 24, 24), dtype=np.uint8)])
    images = media.jpegs(frames)
    assert media.images_of(media.avi(images)) == images
    assert (media.frames_of(images) == frames).all()
    start, _, _, codes = media._parse(images[-1])
    slow = media._slow(images[-1][start:-2].replace(b"\xff\x00", b"\xff"), 576, codes).reshape(24, 24)
    slow[0, 0] += 128
    slow[:, 0] = np.cumsum(slow[:, 0])
    assert (np.cumsum(slow, axis=1) == frames[-1]).all()
    assert media.cuts(media.histograms(frames))[:3] == [0, 30, 50]
    df = spark.createDataFrame([(7, bytearray(media.avi(images)))], "doc_id long, media binary")
    clip = media.clips(df).orderBy("clip").collect()
    assert [(c["start_ms"], c["end_ms"]) for c in clip[:2]] == [(0, 1200), (1200, 2000)]
    assert b"".join(bytes(c["samples"]) for c in clip) == frames.tobytes()


def test_op8_rejects_only_texts_without_language(spark, folder, corpus_rows):
    found = rows(queries.queries()["op8_language_id"](spark, folder))
    assert len(found) == len(corpus_rows)
    gone = {r["doc_id"] for r in found if not r["accepted"]}
    assert {300, 301, 302} <= gone and not gone & {*range(2, 60), *range(100, 220)}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = language.stage(spark, docs, folder)
    assert out.columns == docs.columns and out.where("doc_id IN (300, 301, 302)").count() == 0


def test_op8_held_out(spark):
    """Half of the labelled rows fit the model; the other half is told apart, also with priors and declarations."""
    import random

    from .conftest import prose

    rng = random.Random(1)
    kinds = {"xx": ("ta", "ko", "mi", "ra"), "yy": ("schl", "ung", "ei", "ver"), "zz": ("ción", "os", "ar", "que")}
    data = [(k, prose(rng, 30 if k % 10 else 2, kinds[lang]), lang, f"host{lang}{k % 4}") for k, lang in enumerate(rng.choices(list(kinds), k=600))]
    df = spark.createDataFrame(data, "id long, text string, label string, host string")
    model = language.fit(df.where("id % 2 = 0"))
    held = df.where("id % 2 = 1").withColumnRenamed("label", "declared")
    for declared in (None, "declared"):
        got = language.identify(held, model, ["host"], declared).join(held, "id").select("lang", "declared").collect()
        assert np.mean([r["lang"] == r["declared"] for r in got]) > 0.99


def test_op10(spark, folder, corpus_rows):
    found = rows(queries.queries()["op10_length_buckets"](spark, folder))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [x or "" for _, x in corpus_rows]
    ids = [t.encode(x, add_special_tokens=False).ids for x in texts]
    n = [len(x) for x in ids]
    same([(r["doc_id"], r["n_tokens"]) for r in found], [(i, k) for (i, _), k in zip(corpus_rows, n, strict=True)])
    assert all(r["n_tokens"] <= r["pad_to"] for r in found)
    batches = defaultdict(list)
    for r in found:
        batches[r["bucket"], r["batch"]].append(r)
    for (bucket, _), own in batches.items():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert len(own) == 1 or len(own) * own[0]["pad_to"] <= packing.BUDGET
    for bucket in {b for b, _ in batches}:  # all batches but the last are full
        sizes = [len(batches[bucket, k]) for k in range(sum(b == bucket for b, _ in batches))]
        assert len(set(sizes[:-1])) <= 1
    # the buckets are the optimal ones, and every row is in its bucket
    lengths, counts = np.unique(n, return_counts=True)
    cuts = packing.boundaries(lengths, counts, packing.BUCKETS)
    assert {(r["n_tokens"], r["bucket"], r["pad_to"]) for r in found} == {(int(k), int(np.searchsorted(cuts, k)), cuts[int(np.searchsorted(cuts, k))]) for k in lengths}
    # formed batches hold each document's ids in its place
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    made = rows(packing.formed(packing.pack(packing.encoded(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), True))))
    held = Counter()
    for b in made:
        m = np.frombuffer(b["ids"], "<u4").reshape(len(b["doc_ids"]), b["pad_to"])
        assert (m[np.arange(b["pad_to"]) >= np.array(b["lengths"])[:, None]] == packing.PAD).all()
        for i, k, x in zip(b["doc_ids"], b["lengths"], m, strict=True):
            held[i, tuple(x[:k].tolist())] += 1
    assert held == Counter((i, tuple(x)) for (i, _), x in zip(corpus_rows, ids, strict=True))
    out = rows(queries.queries()["packed_batches"](spark, folder))
    assert sum(r["n_rows"] for r in out) == len(n) and sum(r["n_tokens"] for r in out) == sum(n) and all(r["padding"] == r["n_rows"] * r["pad_to"] - r["n_tokens"] for r in out)


def test_boundaries_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(0)
    for _ in range(40):
        lengths = np.unique(rng.integers(1, 60, rng.integers(1, 9)))
        counts = rng.integers(1, 20, len(lengths))
        for buckets in (1, 2, 3, 5):
            cost = lambda cuts: sum(int(c) * (min(x for x in cuts if x >= n) - int(n)) for n, c in zip(lengths, counts, strict=True))
            best = min(cost([*pick, int(lengths[-1])]) for k in range(buckets) for pick in combinations(lengths[:-1].tolist(), k))
            got = packing.boundaries(lengths, counts, buckets)
            assert cost(got) == best and len(got) <= buckets


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op2_content_chunks", "op4_byte_bpe", "op6_minhash", "op7_wavelet_tokens", "op8_language_id", "op9_avi_mjpeg", "op10_length_buckets", "pipeline"])
def test_empty_tables(spark, nothing, name):
    assert queries.queries()[name](spark, nothing).count() == 0


def test_pipeline(spark, folder, corpus_rows):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language identification", "near-duplicates", "repeated strings", "packing"]
    found = rows(corpus_pipeline.run(spark, folder))
    ids = {r["doc_id"] for r in found}
    assert set(range(3, 60)) <= ids and not ids & {300, 301, 302, 110, 111, 112}
    # the stages written out; languages are held against their fusion elsewhere
    from tokenizers import Tokenizer

    docs, model = language._documents(spark.read.parquet(f"{folder}/documents.parquet"))
    accepted = {(r["id"], r["rid"]) for r in language.identify(docs, model, language.LEVELS, "declared", ("id", "rid")).where("accepted").collect()}
    named = {(r["id"], r["text"]): (r["id"], r["rid"]) for r in docs.collect()}
    left = [(i, t) for i, t in corpus_rows if named[i, t] in accepted]
    top = components(left)
    left = [(i, t) for i, t in left if i is None or top.get(i, i) == i]
    masks = repeated_mask([t.encode() for _, t in left], suffix.PASSAGE)
    left = [(i, characters_left(t, m)) for (i, t), m in zip(left, masks, strict=True)]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    same([(r["doc_id"], r["n_tokens"]) for r in found], [(i, len(t.encode(x, add_special_tokens=False).ids)) for i, x in left if x])


def components(corpus_rows):
    """Each id's least reachable one."""
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    texts = [(i, (t or "").encode().lower().split()) for i, t in corpus_rows]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []) for _, w in texts]
    for a in range(len(sets)):
        for b in range(a):
            if texts[a][0] is not None and texts[b][0] is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(texts[a][0]), find(texts[b][0])))
                top[y] = x
    return {i: find(i) for i, _ in texts if i is not None}


@pytest.mark.parametrize("name", ["page_languages", "op8_language_id"])
def test_languages_by_the_fusion_written_out(spark, tmp_path, name):
    """Text, markup and the suffix-domain-host hierarchy on small tables, against the fusion written out. Documents have the page as text and the host as source."""
    d = str(tmp_path)
    words = {"de": "der hund und die katze sind nicht im haus", "en": "the dog and the cat are not in this house", "fr": "le chien et le chat ne sont pas dans la maison"}
    rng = random.Random(8)
    spark.createDataFrame([(k, " ".join(rng.sample(w.split(), 8)), x, "s", 40) for k, (x, w) in enumerate(list(words.items()) * 20)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    hosts = {"www.a.de": "de", "news.a.de": "de", "b.de": "en", "x.c.fr": "fr", "d.com": "en", "e.d.com": "de"}
    pages = [(i, f"http://{h}/{i}", f"<html lang='{rng.choice([x, 'fr', 'xx'])}'><style>the the</style><p>{' '.join(rng.sample(words[x].split(), 5))}</p></html>") for i, (h, x) in enumerate(list(hosts.items()) * 6)]
    # a word of all languages: only markup and address decide; no declaration, no text, no URL, nothing at all
    pages += [(100 + k, f"http://{h}/z", f"<html{say}><p>alp</p></html>") for k, (h, say) in enumerate((h, say) for h in hosts for say in ("", " lang=en", ' lang="FR-be"'))]
    pages += [(200, "http://b.de/", ""), (201, None, "<p>the cat</p>"), (202, None, None), (None, "http://new.a.de/q", "<p>katze</p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(f"{d}/pages.parquet")
    of_documents = name == "op8_language_id"
    if of_documents:
        pages = [(i, url, html) for i, url, html in pages if i != 202]
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        same_rows = [(k, " ".join(rng.sample(w.split(), 8)), x, "s", 40) for k, (x, w) in enumerate(list(words.items()) * 20, 1000)]
        own = [(i, html, None, url.split("/")[2].upper() if url else None, 1) for i, url, html in pages]
        pages += [(k, f"http://{s}/", t) for k, t, _, s, _ in same_rows]
        d += "/own"
        spark.createDataFrame(same_rows + own, schema).repartition(3).write.parquet(f"{d}/documents.parquet")
    key = "doc_id" if of_documents else "page_id"
    got = {r[key]: r for r in queries.queries()[name](spark, d).collect()}

    _, model = language._documents(spark.read.parquet(f"{d}/documents.parquet"))
    names = model.languages
    plain = lambda html: (html or "") if of_documents else re.sub(r"<[^>]*>", " ", re.sub(r"<style>.*?</style>", " ", html or ""))
    seen = {}
    for i, url, html in pages:
        b = plain(html).encode()
        code, ok = language.trigrams(np.array([0, len(b)]), np.frombuffer(b, np.uint8))
        n = int(ok.sum())
        ll = model.table[:, code[ok]].astype(float).mean(1) * min(n, language.TEMPER) if n else np.zeros(len(names))
        host = url.split("/")[2] if url else ""  # no URL: an empty host
        keys = [tuple(".".join(host.split(".")[-m:]) if m else host for m in (1, 2, 0)[: depth + 1]) for depth in range(3)] if url is not None else [(None,) * (depth + 1) for depth in range(3)]
        said = re.search(r"lang=[\"']?([a-zA-Z]+)", html or "")
        seen[i] = (n, ll, keys, said[1].lower() if said else None)
    norm = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    posts = [(keys, norm(ll)) for n, ll, keys, _ in seen.values() if n]
    base = (sum(p for _, p in posts) + 1) / (len(posts) + len(names))
    assert len(got) == len(pages)
    for i, (n, ll, keys, said) in seen.items():
        prior = base
        for depth in range(3):
            own = [p for k, p in posts if k[depth] == keys[depth]]
            prior = (sum(own) + language.KAPPA * prior) / (len(own) + language.KAPPA) if own else prior
        markup = np.array([language.DECLARED if x == said else (1 - language.DECLARED) / (len(names) - 1) for x in names]) if said in names else np.ones(len(names))
        post = norm(ll + np.log(prior) + np.log(markup))
        r = got[i]
        assert r["n_evidence"] == n and (r["lang"] is None) == (n == 0)
        if n:
            assert r["lang"] == names[int(post.argmax())] and abs(r["posterior"] - post.max()) < 1e-6
    assert len({got[100 + k]["lang"] for k in range(18)}) > 1
    if of_documents:
        docs = spark.read.parquet(f"{d}/documents.parquet")
        kept = {r["doc_id"]: r["lang"] for r in language.stage(spark, docs, d).collect()}
        assert kept == {i: r["lang"] for i, r in got.items() if r["accepted"]} and 200 not in kept and None in kept
