"""Chains of cores in two blocks against a plain search, and what they need."""

import tracemalloc

import numpy as np
import pyarrow as pa

from rostrum.operators import cluster


def blocks(v, core):
    n = len(v)
    second = np.arange(n) >= n // 2
    return pa.table({"k": np.arange(n)[::-1] * 3, "v": pa.array(list(v)), "i": np.zeros(n, int), "j": np.ones(n, int), "second": second, "core": core})


def test_chains_and_borders():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(120, 4))
    v /= np.linalg.norm(v, axis=1)[:, None]
    core = rng.random(120) < 0.6
    near = v @ v.T >= 0.9
    near[:60, :60] = near[60:, 60:] = False  # a task looks at pairs of both blocks only
    keys = np.arange(120)[::-1] * 3
    root = keys.copy()
    for _ in range(120):
        root = np.array([min([root[i], *root[near[i] & core]]) if core[i] else root[i] for i in range(120)])
    want = {(int(keys[i]), int(root[i]), False) for i in range(120) if core[i]}
    want |= {(int(keys[i]), int(keys[near[i] & core].min()), True) for i in range(120) if not core[i] and (near[i] & core).any()}
    got = cluster._chains([], "k", 0.1)(blocks(v, core))
    assert set(zip(*[got.column(c).to_pylist() for c in ("k", "other", "border")], strict=True)) == want
    assert any(b for _, _, b in want) and any(a != b for a, b, border in want if not border)


def test_chains_hold_links_not_all_pairs():
    """Two full blocks with few links: no table of whole numbers for all pairs (32 MB and more)."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(4096, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    table = blocks(v, np.ones(4096, bool))
    run = cluster._chains([], "k", 0.6)
    run(table)
    tracemalloc.start()
    run(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6
