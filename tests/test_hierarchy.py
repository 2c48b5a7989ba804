"""Hierarchical density clusters against a plain version that merges one edge after the other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.operators import hierarchy as hi


def plain_forest(keys, v, k):
    d = np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2)), 9)
    core = np.sort(d, axis=1)[:, min(k, len(keys)) - 1]
    m = np.maximum(np.maximum(d, core[:, None]), core[None])
    edges = sorted((m[i, j], min(keys[i], keys[j]), max(keys[i], keys[j])) for i in range(len(keys)) for j in range(i))
    group, out = {x: {x} for x in keys}, []
    for w, a, b in edges:
        if group[a] is not group[b]:
            out.append((w, a, b))
            both = group[a] | group[b]
            group.update(dict.fromkeys(both, both))
    return out


def plain_labels(keys, merges, size, eps=0.0):
    """Clusters as objects of a tree, grown from the bottom and chosen from the leaves up."""
    comp = {x: ({x}, None) for x in keys}
    made = []
    for w, a, b in merges:
        (sa, ca), (sb, cb) = comp[a], comp[b]
        lam, both = 1 / max(w, 1e-12), sa | sb
        if ca and cb:
            for c in (ca, cb):
                c["top"] = w
            new = {"parts": [ca, cb], "mass": [(len(both), lam)]}
            made.append(new)
        elif ca or cb:
            new = ca or cb
            new["mass"].append((len(sb if ca else sa), lam))
        elif len(both) >= size:
            new = {"parts": [], "mass": [(len(both), lam)]}
            made.append(new)
        else:
            new = None
        if new:
            new["all"] = both
        comp.update(dict.fromkeys(both, (both, new)))
    picked = []

    def score(c):
        excess, parts = sum(n * (lam - 1 / max(c["top"], 1e-12)) for n, lam in c["mass"]), [score(p) for p in c["parts"]]
        below = sum(s for s, _ in parts)
        return (excess, [c]) if round(excess, 9) >= round(below, 9) else (below, [x for _, xs in parts for x in xs])

    parent = {id(p): c for c in made for p in c["parts"]}
    for root in [c for c in made if "top" not in c]:
        for p in root["parts"]:
            picked += score(p)[1]
    label = dict.fromkeys(keys, -1)
    for c in picked:
        while c["top"] < eps and "top" in parent[id(c)]:
            c = parent[id(c)]
        label.update(dict.fromkeys(c["all"], min(c["all"])))
    return label


def groups(seed, n=220, dims=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims)) * 4
    v = np.concatenate([c + rng.normal(size=(n // 8, dims)) * rng.choice([0.2, 0.6]) for c in centres] + [rng.normal(size=(n // 8, dims)) * 5])
    v = np.concatenate([v, v[:5], v[:2]])
    return [int(k) for k in rng.permutation(5 * len(v))[: len(v)]], v


def frame(spark, keys, v):
    return spark.createDataFrame([(k, x.tolist()) for k, x in zip(keys, v, strict=True)], "k long, v array<double>").repartition(3)


@pytest.fixture(params=[(2048, 1 << 20), (32, 50)])
def bounds(request, monkeypatch):
    for name, value in zip(("BLOCK", "LEVEL"), request.param, strict=True):
        monkeypatch.setattr(hi, name, value)


def test_forest_and_labels(spark, bounds):
    keys, v = groups(1)
    rows = frame(spark, keys, v)
    want = plain_forest(keys, v, 4)
    forest = hi.stored(hi.forest_of(rows, "k", "v", 4))
    assert sorted(map(tuple, forest.select("d", "a", "b").collect())) == want
    for size, eps in ((8, 0.0), (5, 1.5)):
        got = {r["k"]: r["cluster"] for r in hi._labelled(rows, "k", forest, size, eps).collect()}
        assert got == plain_labels(keys, want, size, eps)
    assert len({c for c in got.values() if c >= 0}) > 2


def test_sweep_equals_separate_runs(spark):
    keys, v = groups(2, 120)
    rows = frame(spark, keys, v)
    got = {(r["min_cluster_size"], r["min_samples"]): r for r in hi.density_sweep(rows, "k", "v", [4, 9], [2, 6]).collect()}
    assert len(got) == 4
    for (size, points), r in got.items():
        label = plain_labels(keys, plain_forest(keys, v, points), size)
        own = {k: c for k, c in label.items() if c >= 0}
        assert r["clusters"] == len(set(own.values())) and r["outliers"] == len(keys) - len(own)
        assert (r["silhouette"] is None) == (len(set(own.values())) < 2) and abs(r["silhouette"] or 0) <= 1


def test_cosine_and_odd_rows(spark):
    keys, v = groups(3, 90)
    rows = frame(spark, keys, v).withColumn("more", F.lit("x"))
    odd = spark.createDataFrame([(10_001, None), (10_002, [1.0, None, 1.0, 1.0, 1.0]), (10_003, [float("nan")] * 5), (10_004, [])], "k long, v array<double>").withColumn("more", F.lit("y"))
    got = {r["k"]: r["cluster"] for r in hi.density_hierarchy(rows.union(odd), "k", "v", 5, 3, metric="cosine").collect()}
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    assert got == plain_labels(keys, plain_forest(keys, unit, 3), 5) | dict.fromkeys(range(10_001, 10_005), -1)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_small_tables(spark, n):
    rows = frame(spark, list(range(n)), np.eye(3)[:n]) if n else spark.createDataFrame([], "k long, v array<double>")
    assert sorted(map(tuple, hi.density_hierarchy(rows, "k", "v", 5, 3).collect())) == [(i, -1) for i in range(n)]


def test_bundles_hand_on_trees(spark, monkeypatch):
    """Tasks meet all blocks of two bundles; what they hand on has one tree's edges, not one for each pair of blocks."""
    for name, value in (("BLOCK", 8), ("BUNDLES", 3), ("EDGES", 40)):
        monkeypatch.setattr(hi, name, value)
    keys, v = groups(4, 130)
    blocks = hi.Blocks(frame(spark, keys, v), "k", "v")
    bounds = blocks.bounds()
    assert blocks.wide > 3
    found = hi.stored(hi.spanning_forest(blocks, bounds, hi.core_distances(blocks, bounds, 4)))
    assert sorted(map(tuple, found.select("d", "a", "b").collect())) == plain_forest(keys, v, 4)


def test_tree_of_edges():
    rng = np.random.default_rng(8)
    for n, m in ((1, 0), (2, 1), (40, 60), (40, 400)):
        pairs = sorted({tuple(sorted(map(int, rng.choice(n, 2, replace=False)))) for _ in range(m)})
        edges = [(float(rng.integers(5)), a, b) for a, b in pairs]
        group, want = {x: {x} for x in range(n)}, []
        for w, a, b in sorted(edges):
            if group[a] is not group[b]:
                want.append((w, a, b))
                both = group[a] | group[b]
                group.update(dict.fromkeys(both, both))
        d, a, b = zip(*edges, strict=True) if edges else ((), (), ())
        got = hi.tree_of_edges(hi.pa.table({"a": np.array(a, np.int64), "b": np.array(b, np.int64), "d": np.array(d, np.float64)}))
        assert sorted(zip(*[got.column(c).to_pylist() for c in ("d", "a", "b")], strict=True)) == want


def test_lists_leave_few_components(spark, monkeypatch):
    """What follows from lists of neighbours is not met again: tasks hand on an edge for two components, and the lists are
    made once for all min_points of a sweep."""
    keys, v = groups(5, 900)
    rows, handed, lists = frame(spark, keys, v), [], []
    met, near = hi.Blocks.met, hi.near_lists
    monkeypatch.setattr(hi.Blocks, "met", lambda self, pairs, run, schema, extra=None: handed.append(hi.stored(met(self, pairs, run, schema, extra))) or handed[-1])
    monkeypatch.setattr(hi, "near_lists", lambda *a: lists.append(1) or near(*a))
    blocks = hi.Blocks(rows, "k", "v")
    bounds = blocks.bounds()
    found = hi.stored(hi.spanning_forest(blocks, bounds, hi.core_distances(blocks, bounds, 3)))
    assert sorted(map(tuple, found.select("d", "a", "b").collect())) == plain_forest(keys, v, 3)
    assert sum(h.count() for h in handed if "d" in h.columns) < len(keys) / 4
    lists.clear()
    hi.density_sweep(rows, "k", "v", [5], [2, 3])
    assert len(lists) == 1


@pytest.mark.parametrize("few", [1, 1024])
def test_groups_of_copies_and_ties(spark, monkeypatch, few):
    """Groups that fill their lists with themselves are joined by the rounds that meet blocks, few components or many."""
    monkeypatch.setattr(hi, "FEW", few)
    monkeypatch.setattr(hi, "BLOCK", 40)
    rng = np.random.default_rng(6)
    v = np.concatenate([np.repeat(rng.integers(0, 3, (9, 3)).astype(float) * 7, 15, axis=0), rng.integers(0, 4, (40, 3)).astype(float)])
    keys = [int(k) - 60 for k in rng.permutation(3 * len(v))[: len(v)]]
    for points in (1, 2, 14):
        found = hi.forest_of(frame(spark, keys, v), "k", "v", points)
        assert sorted(map(tuple, found.select("d", "a", "b").collect())) == plain_forest(keys, v, points)


@pytest.mark.parametrize("wide", [1 << 16, 7])
def test_silhouette_by_blocks(spark, monkeypatch, wide):
    """The evaluator's figure, without going through all clusters for each row."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    monkeypatch.setattr(hi, "WIDE", wide)
    keys, v = groups(7, 160)
    rows = frame(spark, keys, v).select(F.col("k").alias("key"), (F.col("k") % 23).alias("cluster"), "v")
    want = ClusteringEvaluator(featuresCol="f", predictionCol="c").evaluate(rows.select(F.col("cluster").cast("int").alias("c"), array_to_vector("v").alias("f")))
    assert abs(hi.silhouette(rows, 23) - want) < 1e-9
