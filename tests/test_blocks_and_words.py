"""Blocks of similar names lose no pair; senses of several words at once equal those of each word alone."""

from difflib import SequenceMatcher

import numpy as np
import pytest

from rostrum.operators import cluster, enrich


def noisy_names(seed, n=150):
    rng = np.random.default_rng(seed)
    base = ["".join(rng.choice(list("abcçdeéıİ o"), int(rng.integers(1, 14)))) for _ in range(n // 3)]
    out = set(base)
    for b in base:
        for _ in range(2):
            at = int(rng.integers(len(b)))
            out.add(str(rng.choice([b[:at] + b[at + 1 :], b[:at] + "x" + b[at:], b.upper(), b[::-1]])))
    return sorted(x for x in out if x)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9, 1.0])
def test_similar_names_share_a_block(spark, threshold):
    names = noisy_names(int(threshold * 10))
    found = enrich.letter_blocks(spark.createDataFrame([(n,) for n in names], "n string"), "n", threshold).collect()
    blocks = {}
    for r in found:
        blocks.setdefault(r["n"], set()).add(r["block"])
    lower = dict(zip(names, [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").selectExpr("lower(n)").collect()], strict=True))
    near = [(a, b) for a in names for b in names if a < b and SequenceMatcher(None, lower[a], lower[b], autojunk=False).ratio() >= threshold]
    assert len(near) > 10 and all(blocks[a] & blocks[b] for a, b in near)


def test_fuzzy_party_equals_all_pairs(spark):
    names = [n for n in noisy_names(7) if n.strip()]
    members = [(t, n, f"p{i}") for i, n in enumerate(names[::2]) for t in (i % 3,)]
    said = [(i % 3, n) for i, n in enumerate(names)]
    got = {(r["term"], r["speech_giver"]): r["party"] for r in enrich.fuzzy_party(spark.createDataFrame(said, "term int, speech_giver string"), spark.createDataFrame(members, "term int, mp_name string, party string"), 0.7).collect()}
    for t, n in said:
        own = [(SequenceMatcher(None, m.lower(), n.lower()).ratio(), m, p) for u, m, p in members if u == t]
        exact = [p for _, m, p in own if m == n]
        best = max((x for x in own if x[0] >= 0.7), default=None)
        assert got[t, n] == (exact[0] if exact else best[2] if best else None)


def test_words_are_folded_apart(spark):
    rng = np.random.default_rng(5)
    rows = [(w, t, 1, c, rng.normal(size=4).tolist(), int(rng.integers(1, 9))) for w in ("a", "b", "c") for t in range(4) for c in range(3)]
    schema = "word string, term int, year int, cluster long, centroid array<double>, size long"
    every = {(r["word"], r["term"], r["cluster"]): r["global_id"] for r in cluster.align(spark.createDataFrame(rows, schema), 0.5, 6, 2, ["word"]).collect()}
    for w in ("a", "b", "c"):
        known, limit, want = [], 2, {}
        for t in range(4):
            limit = 6 if known else 2
            for _, _, _, c, v, size in sorted((r for r in rows if r[0] == w and r[1] == t), key=lambda r: (-r[5], r[3])):
                u = np.array(v) / np.linalg.norm(v)
                sims = [float(k @ u) for k in known]
                at = int(np.argmax(sims)) if sims else -1
                if at < 0 or sims[at] < 0.5:
                    at = len(known) if len(known) < limit else -1
                    if at >= 0:
                        known.append(u)
                want[w, t, c] = at
        assert {k: v for k, v in every.items() if k[0] == w} == want
        alone = cluster.align(spark.createDataFrame([r for r in rows if r[0] == w], schema), 0.5, 6, 2)
        assert {(w, r["term"], r["cluster"]): r["global_id"] for r in alone.collect()} == want
