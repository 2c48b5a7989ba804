"""Suffix-array and substring deduplication against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from rostrum.llm import common, hashing, repeats, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, runs int, names string"


def corpus(seed=5, n=60):
    """Passages shared in many ways, runs of one word, short and empty texts, nulls, repeated rows."""
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choices("abcdefé", k=rnd.randint(1, 7))) for _ in range(300)]
    passages = [[rnd.choice(vocab) for _ in range(rnd.randint(20, 90))] for _ in range(8)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rnd.randint(1, 5)):
            kind = rnd.random()
            if kind < 0.35:
                p = rnd.choice(passages)
                a = rnd.randrange(len(p))
                words += p[a:] if kind < 0.1 else p
            elif kind < 0.45:
                words += [rnd.choice("xy")] * rnd.randint(1, 80)
            elif kind < 0.5:
                words += ["p", "q"] * rnd.randint(1, 60)
            else:
                words += rnd.choices(vocab, k=rnd.randint(1, 120))
        rows.append((i * 3 % 101, rnd.choice([" ", "  ", "\n"]).join(words)))
    rows += [(500, ""), (501, None), (502, "short"), (None, rows[0][1]), (None, rows[0][1]), rows[3], rows[3], (503, "z" * 400), (504, "z" * 90 + "w"), (505, "  \t\n ")]
    return [(i, t, "en", "s", 1, "k", 7, "m") for i, t in rows]


def brute_bytes(rows, length):
    least, none = {}, 1 << 62
    for i, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            least[w] = min(least.get(w, none), none if i is None else i)
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < (none if i is None else i):
                gone[p : p + length] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def brute_words(rows, length):
    seen = Counter()
    split = [[w for w in (t or "").encode().split()] for _, t, *_ in rows]
    for ws in split:
        seen.update(tuple(ws[p : p + length]) for p in range(len(ws) - length + 1))
    out = []
    for (i, *_), ws in zip(rows, split, strict=True):
        gone = [False] * len(ws)
        for p in range(len(ws) - length + 1):
            if seen[tuple(ws[p : p + length])] > 1:
                gone[p : p + length] = [True] * length
        out.append((i, len(ws), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(ws, gone, strict=True) if not g)).hexdigest()))
    return out


def same(df, expected):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("parts", [1, 5])
def test_bytes(spark, parts):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    same(suffix_dedup.dedup_bytes(docs), brute_bytes(rows, 50))


@pytest.mark.parametrize("parts", [1, 5])
def test_words(spark, parts):
    rows = corpus(9)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    same(substring_dedup.dedup_words(docs), brute_words(rows, 35))


@pytest.mark.parametrize("op", [suffix_dedup.dedup_bytes, substring_dedup.dedup_words, suffix_dedup.dedup_texts, substring_dedup.dedup_texts])
def test_empty(spark, op):
    assert op(spark.createDataFrame([], SCHEMA)).collect() == []


def test_real_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    same(suffix_dedup.dedup_bytes(docs), brute_bytes(rows, 50))
    same(substring_dedup.dedup_words(docs), brute_words(rows, 35))


def test_texts_lose_repeats(spark):
    line = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, "alpha " + line), (2, line + " omega")], "doc_id long, text string")
    assert dict(map(tuple, substring_dedup.dedup_texts(docs).collect())) == {1: "alpha", 2: "omega"}
    left = dict(map(tuple, suffix_dedup.dedup_texts(docs).collect()))
    assert left[1] == "alpha " + line and left[2] == " omega"


def test_recompression_names_agree_inside():
    """Symbols whose stretch lies in a shared window are the same wherever the window stands."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        core = rng.integers(0, 4, 35).astype(np.uint64)
        sides = [rng.integers(0, 4, rng.integers(0, 9)).astype(np.uint64) for _ in range(4)]
        found = []
        for a, b in ((sides[0], sides[1]), (sides[2], sides[3])):
            tokens = np.r_[a, core, b].astype(np.uint64)
            name, spans, low, high = substring_dedup.recompressed(tokens, np.array([0, len(tokens)]), 2)
            at = np.r_[0, np.cumsum(spans)[:-1]] - len(a)
            assert (np.diff(low) >= 0).all() and (np.diff(high) >= 0).all()
            found.append([(n, p, s) for n, p, s, x, y in zip(name, at, spans, low - len(a), high - len(a), strict=True) if x >= 0 and y <= 35])
        assert found[0] == found[1]


def test_words_and_windows():
    texts = ["a bb  ccc\n", "", " bb a", "a bb"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    h, s, e, firsts = hashing.words(data, offsets)
    assert [data[a:b].tobytes() for a, b in zip(s, e, strict=True)] == [b"a", b"bb", b"ccc", b"bb", b"a", b"a", b"bb"]
    assert firsts.tolist() == [0, 3, 3, 5, 7] and h[0] == h[4] == h[5] and h[1] == h[3] == h[6]
    assert [(a, b) for a, b in common.chunks(offsets, 9)] == [(0, 1), (1, 4)]


def test_words_over_blocks(monkeypatch):
    """Words that blocks cut keep their names, starts and ends, whatever the block."""
    rnd = random.Random(2)
    texts = ["".join(rnd.choices("aB \n", k=rnd.randint(0, 40))) for _ in range(60)] + ["x" * 300, " " * 50, "", "y" * 90 + " z"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    whole = hashing.words(data, offsets, lower=True)
    for block in (1, 3, 7, 64):
        monkeypatch.setattr(hashing, "BLOCK", block)
        assert all((x == y).all() for x, y in zip(whole, hashing.words(data, offsets, lower=True), strict=True))
    assert [len(t.split()) for t in texts] == np.diff(whole[3]).tolist()


def hot_rows():
    """One passage of 70 bytes and 40 words in many contexts, so that its edges make very many units of one anchor."""
    rnd = random.Random(8)
    phrase = " ".join(f"k{i}" for i in range(40))
    word = lambda: "".join(rnd.choices("abcdef", k=rnd.randint(2, 6)))
    rows = [(i, " ".join([*(word() for _ in range(20)), phrase, *(word() for _ in range(20))])) for i in range(150)]
    return rows + [(1000 + i, f"{word()} {word()} k7 k8 k9 k10 k11 k12 k13 {word()} {word()} {word()} {word()} {word()} {word()} {word()}") for i in range(150)]


@pytest.mark.parametrize("parts", [1, 4])
def test_hot_anchors(spark, monkeypatch, parts):
    """Windows of hot anchors are dealt by content; the result stays the same."""
    rows = hot_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    for batch, task in ((3, 1 << 30), (1 << 30, 5), (2, 2)):
        monkeypatch.setattr(repeats, "HOT_BATCH", batch)
        monkeypatch.setattr(repeats, "HOT_TASK", task)
        batches = docs.select("doc_id", "text", (docs.doc_id + 7).alias("key")).toArrow().to_batches(max_chunksize=40)
        for scheme, brute, kept in ((suffix_dedup.scheme(), brute_bytes(rows, 50), 2), (substring_dedup.scheme(), brute_words(rows, 35), 2)):
            lost = local(scheme, batches, 5)
            got = {k - 7: sum(b - a for a, b in repeats.covered(v, scheme.length)) for k, v in lost.items()}
            assert {i: got.get(i, 0) for i, _ in rows} == {r[0]: r[kept] for r in brute}


def local(scheme, batches, buckets):
    """What the Spark side does, on one list of batches: key and runs."""
    dealt = lambda made: [pa.Table.from_batches([b for b in made]).filter(pc.equal(pc.field("route"), r)).to_batches() for r in range(buckets)]
    told = [x for part in dealt(list(repeats._send_names(scheme, buckets)(iter(batches)))) for x in repeats._judge_names(scheme, buckets)(iter(part))]
    fates = pa.Table.from_batches([x for part in dealt(told) if part for x in repeats._gather_fates(iter(part))])
    rows = pa.Table.from_batches(batches).join(fates, "key", join_type="inner")
    sent = list(repeats._send_windows(scheme, buckets)(iter(rows.combine_chunks().to_batches(max_chunksize=40))))
    lost = {}
    for part in dealt(sent):
        for x in repeats._judge_windows(scheme)(iter(part)):
            for k, v in zip(x.column("key").to_pylist(), x.column("runs").to_pylist(), strict=True):
                lost.setdefault(k, []).append(v)
    return lost


def test_long_texts_in_segments(spark, monkeypatch):
    """Texts longer than a segment give the same result."""
    monkeypatch.setattr(hashing, "BLOCK", 120)
    monkeypatch.setattr(substring_dedup, "SEGMENT", 50)
    monkeypatch.setattr(common.chunks, "__defaults__", (120,))
    rows = [(i if i is not None else 5000 + k, t or "") for k, (i, t, *_) in enumerate(corpus(11, 40))]
    rows = [(k, i, t) for k, (i, t) in enumerate(rows)]
    batches = pa.table({"key": [k for k, _, _ in rows], "doc_id": [i for _, i, _ in rows], "text": [t for *_, t in rows]}).to_batches(max_chunksize=9)
    for scheme, brute in ((suffix_dedup.scheme(), brute_bytes([(i, t) for _, i, t in rows], 50)), (substring_dedup.scheme(), brute_words([(i, t) for _, i, t in rows], 35))):
        lost = local(scheme, batches, 3)
        assert [sum(b - a for a, b in repeats.covered(lost.get(k), scheme.length)) for k, _, _ in rows] == [r[2] for r in brute]


def test_very_long_texts(spark):
    """Texts of 50 MB: a later one that holds a copy of the first loses just that."""
    words = " ".join(f"{i:07d}" for i in range(6_500_000))
    docs = spark.createDataFrame([(1, words), (2, "start " + words[: 30_000_000] + " end")], "doc_id long, text string")
    assert len(words) > 50_000_000
    got = {r.doc_id: r for r in suffix_dedup.dedup_bytes(docs).collect()}
    assert got[1].n_removed == 0 and got[2].n_bytes == 30_000_010 and got[2].n_spans == 1 and 30_000_000 <= got[2].n_removed <= 30_000_002
    got = {r.doc_id: r for r in substring_dedup.dedup_words(docs).collect()}
    assert got[1].n_words == 6_500_000 and got[1].n_removed == got[2].n_removed == 30_000_000 // 8
