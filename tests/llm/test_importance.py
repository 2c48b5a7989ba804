"""Importance resampling against its SQL and a plain version."""

import hashlib
import math
import re
import sys
import tracemalloc
import zlib

import numpy as np
import pytest

from rostrum.llm import importance as im

sys.path.insert(0, __file__.rsplit("/", 1)[0] + "/..")
from oracle import rows as plain, tables  # noqa: E402

SCHEMA = "doc_id long, text string, score int, `meta.url` string, rank string"


def brute(docs, target, orders=(1, 1), buckets=10_000, least=20, percent=10, seed=2024):
    def found(text):
        small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)
        grams = [" ".join(words[i : i + n]) for n in range(orders[0], orders[1] + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(g.encode()) % buckets for g in grams]

    own, aim = [found(t) for _, t in docs], [found(t) for t in target]
    s, t = (np.bincount(sum((b for _, b in x), [0]), minlength=buckets) for x in (own, aim))
    s[0] -= 1
    t[0] -= 1
    big, small = int(s.sum()) + buckets, int(t.sum()) + buckets
    gain = [math.floor(1000 * math.log((int(b) + 1.0) * big / ((int(a) + 1.0) * small))) for a, b in zip(s, t, strict=True)]
    out = []
    for (i, _), (n, b) in zip(docs, own, strict=True):
        weight, score = math.floor(sum(gain[x] for x in b) / len(b)) if b else 0, None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(b), weight, score, None, n])
    able = sorted((r for r in out if r[5] >= least and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def texts(n=160, seed=1):
    rng = np.random.default_rng(seed)
    words = ["Alpha", "beta9", "GAMMA", "délta", "ÉTÉ", "x", "ζ", "naïve", "__", "o'clock", "\x00", "\t\n", "a-b", "😀"]
    docs = [(i * 7 % 300, str(rng.choice([" ", "; ", "  "])).join(rng.choice(words, int(rng.integers(0, 60))))) for i in range(n)]
    docs += [(400, None), (401, ""), (402, " .,; "), (None, "alpha " * 30), docs[0], docs[0], (docs[1][0], "beta9 " * 25)]
    return docs, [" ".join(rng.choice(words[:4], 12)) for _ in range(9)] + [None, ""]


@pytest.mark.parametrize("options", [{}, {"orders": (1, 3), "buckets": 70_000, "percent": 35, "least": 5, "seed": 7}, {"orders": (2, 2), "buckets": 50}])
def test_against_brute_force(spark, options):
    docs, target = texts()
    frame = spark.createDataFrame([(i, t, 1, "u", "r") for i, t in docs], SCHEMA).repartition(3)
    aim = spark.createDataFrame([(i, t, "q") for i, t in enumerate(target)], "item_id long, text string, doc_id string")
    got = im.resampled(frame, aim, **options)
    assert [t for _, t in got.dtypes] == ["bigint"] * 5
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, target, **options)


def test_empty_tables(spark):
    docs, target = texts(30)
    frame = spark.createDataFrame([(i, t, 1, "u", "r") for i, t in docs], SCHEMA)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    assert im.resampled(frame.limit(0), aim).count() == 0
    assert sorted(map(tuple, im.resampled(frame, aim.limit(0)).collect()), key=str) == brute(docs, [])


def test_drawn(spark):
    docs = [(i, f"word{i} " * 30) for i in range(40)]
    frame = spark.createDataFrame([(i, t, 1, "u", "r") for i, t in docs], SCHEMA)
    got = im.drawn(frame, spark.createDataFrame([("word3 word4",)], "text string")).orderBy("draw_rank").collect()
    want = sorted((r[4], r[0]) for r in brute(docs, ["word3 word4"]) if r[4])
    assert [(r["draw_rank"], r["doc_id"]) for r in got] == want and all(r["text"] == dict(docs)[r["doc_id"]] for r in got)


def test_query_against_sql(spark):
    d = "/root/testdata/sf0.001"
    assert plain(im.op13_importance_resampling(spark, d).toPandas()) == plain(tables(d).sql(im.OP13_SQL).df())


def test_slabs(monkeypatch):
    text = "Aé, b c. " * 40 + "x" * 90 + " y"
    patterns = {n: im.ngram_pattern(n) for n in (1, 2, 3)}
    whole = im.buckets_of(text, patterns, 1000)
    monkeypatch.setattr(im, "SLAB", 7)
    n, found = im.buckets_of(text, patterns, 1000)
    assert (n, sorted(found)) == (whole[0], sorted(whole[1])) and len(list(im.slabs(text))) > 20


def test_very_long_text():
    tracemalloc.start()
    n, found = im.buckets_of("Word " * 4_000_000 + "x" * 1_000_000, {1: im.ngram_pattern(1)}, 10_000)
    assert n == len(found) == 4_000_001 and tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()
