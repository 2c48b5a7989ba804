"""Near duplicates and components against brute force."""

import random
import re

import numpy as np
import pytest

from rostrum.llm import hashing, minhash_dedup
from rostrum.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, sketch int"


def shingle_set(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute(rows):
    sets = [shingle_set(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[find(parent, i)] = find(parent, j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        r = find(parent, i)
        if d is not None and sets[i]:
            least[r] = min(least.get(r, d), d)
    out = []
    for i, (d, *_) in enumerate(rows):
        c = least.get(find(parent, i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d is not None and d == c))
    return out


def corpus(seed=1):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    for _ in range(12):
        base = rnd.choices(vocab, k=rnd.choice([3, 5, 30, 120, 300]))
        for _ in range(rnd.randint(1, 9)):
            words = base[:]
            for _ in range(rnd.choice([0, 0, 1, 2, len(base) // 40 + 1, len(base) // 30 + 1])):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            rows.append((k * 7 % 211, rnd.choice([" ", "\n ", "\t"]).join(w.upper() if rnd.random() < 0.1 else w for w in words)))
            k += 1
    rows += [(900, ""), (901, None), (902, "  \n"), (903, "One two"), (904, "one TWO "), (None, rows[0][1]), rows[2], rows[2], (None, "alone here"), (905, "É a b c d"), (906, "é a b c d")]
    return [(d, t, "en", "s", 1, "k", 3) for d, t in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = corpus(seed)
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)


def test_empty(spark):
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_real_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, minhash_dedup.near_duplicates(docs).collect())) == sorted(brute(rows))


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, x) for x in range(201, 260)] + [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(70)] + [(5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(parent, x) for x in parent if x != 5}


def test_registers_and_estimate():
    x = np.array([1, 2**63, 2**62 + 2**61, 5], np.uint64)
    assert [int(v) >> 10 for v in minhash_dedup.compressed(x)] == [63, 0, 1, 61]
    rng = np.random.default_rng(0)
    for share in (0.0, 0.5, 0.8):
        got = []
        for _ in range(40):
            both = rng.integers(0, 2**63, int(1000 * share), dtype=np.uint64)
            a, b = (hashing.mixed(np.r_[both, rng.integers(0, 2**63, 1000 - len(both), dtype=np.uint64)]) for _ in range(2))
            got.append(minhash_dedup.estimate(minhash_dedup.registers(a, np.array([0])), minhash_dedup.registers(b, np.array([0])))[0])
        assert abs(np.mean(got) - share / (2 - share)) < 0.03
