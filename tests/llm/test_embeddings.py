"""Vector links and components against brute force."""

import numpy as np
import pytest

from rostrum.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int, class string, m int"


def brute(rows):
    units = []
    for _, v, *_ in rows:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        u = np.array(v, np.float32).astype(float) if ok else None
        units.append(u / np.linalg.norm(u) if ok else None)
    near = [[i != j and a is not None and b is not None and len(a) == len(b) and a @ b >= 0.9 for j, b in enumerate(units)] for i, a in enumerate(units)]
    out = []
    for i, (d, *_) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            x = todo.pop()
            for y in np.flatnonzero(near[x]):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        ids = [rows[x][0] for x in seen if rows[x][0] is not None]
        c = min(ids) if ids else None
        out.append((d, sum(near[i]), c, d is not None and d == c))
    return out


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for _ in range(40):
        base = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 8))):
            rows.append((k * 5 % 601, (base + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.2])).tolist()))
            k += 1
    base = rng.normal(size=16)
    rows += [(1000 + i, (base + rng.normal(size=16) * 0.1).tolist()) for i in range(60)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [None] + [1.0] * 15), (2005, [1.0, 2.0]), (2006, [1.0, 2.1]), (2007, [float("inf")] * 16)]
    rows += [rows[0], rows[0], (None, rows[3][1]), (None, [5.0] * 15 + [-9.0])]
    return [(d, v, 1, "c", 2) for d, v in rows]


@pytest.mark.parametrize("block", [512, 7])
def test_links(spark, monkeypatch, block):
    monkeypatch.setattr(ed, "BLOCK", block)
    rows = vectors(block)
    got = sorted(map(tuple, ed.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), target=1.0).collect()), key=str)
    want = sorted(brute(rows), key=str)
    found, true = sum(r[1] for r in got), sum(r[1] for r in want)
    assert found <= true and found >= 0.99 * true
    if found == true:
        assert got == want


def test_empty(spark):
    assert ed.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_traversal_is_nearest_first():
    rng = np.random.default_rng(1)
    grid = ed.Grid(rng.normal(size=(6, 4)), rng.normal(size=(6, 4)))
    x = rng.normal(size=(20, 8))
    sums = (((x[:, None, :4] - grid.left) ** 2).sum(-1)[:, :, None] + ((x[:, None, 4:] - grid.right) ** 2).sum(-1)[:, None, :]).reshape(20, -1)
    for n in (1, 5, 36):
        cells = grid.visits(x, n)
        assert (np.take_along_axis(sums, cells, 1) == np.sort(sums, axis=1)[:, :n]).all() or np.allclose(np.take_along_axis(sums, cells, 1), np.sort(sums, axis=1)[:, :n])
        assert (grid.ranks(x[0], cells[0]) == np.arange(1, len(cells[0]) + 1)).all()


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [tuple(r) for r in df.select("vec_id", "embedding").collect()]
    got, want = (sorted(x) for x in (map(tuple, ed.near_vectors(df).collect()), brute(rows)))
    assert sum(r[1] for r in got) >= 0.9 * sum(r[1] for r in want)


def test_rare_pairs(spark, monkeypatch):
    """Few near copies among vectors without structure: a sample of queries would hardly see one."""
    monkeypatch.setattr(ed, "BLOCK", 100)
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 64)))]
    for i in range(12):
        a = np.array(rows[i * 100][1])
        b = rng.normal(size=64)
        b -= (a @ b) / (a @ a) * a
        rows.append((5000 + i, (a / np.linalg.norm(a) + np.tan(np.arccos(0.9 + 0.005 * (i + 1))) * b / np.linalg.norm(b)).tolist()))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in ed.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(n for n, _ in got.values()) == 24
    assert all(got[5000 + i] == (1, i * 100) for i in range(12))


def test_permitted_cells_hold_all_partners():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 16)) + 2 * rng.normal(size=(6, 16))[rng.integers(0, 6, 300)]
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.25])
    x /= np.linalg.norm(x, axis=1)[:, None]
    grid = ed.Grid(ed.kmeans(x[:, :8], 6), ed.kmeans(x[:, 8:], 6))
    homes = grid.homes(x)
    found = set(zip(*(c.tolist() for c in grid.permitted(x, 0.9)), strict=True))
    q, b = np.nonzero(x @ x.T >= 0.9)
    assert set(zip(q.tolist(), homes[b].tolist(), strict=True)) <= found and len(found) < 0.7 * len(x) * 36


@pytest.mark.parametrize("seed", [5, 6])
def test_ranges_prune_and_keep_all_links(spark, monkeypatch, seed):
    """Vectors in groups: a vector is sent to less than a tenth of the ranges, and no link is lost."""
    monkeypatch.setattr(ed, "BLOCK", 50)
    monkeypatch.setattr(ed, "CELL", 4)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, 24))
    v = np.concatenate([centres[rng.integers(0, 40, 2000)] + 0.3 * rng.normal(size=(2000, 24)), centres[:1] + 0.05 * rng.normal(size=(300, 24))])
    rows = [(int(k), x.tolist()) for k, x in zip(rng.permutation(len(v)), v, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    classes = spark.createDataFrame([(i, 1, x.tobytes()) for i, x in enumerate(unit)], "class long, m long, unit binary")
    grid = ed.fit_grid(classes, len(v))
    ranges = ed.ranges_of(grid, classes)
    placed = classes.mapInArrow(ed._placed(grid, ranges, 0.9), ed.PLACED)
    assert grid.k == 24 and ranges.max() > 30
    assert placed.count() - len(v) < 0.1 * len(v) * (ranges.max() + 1) / 2
    got = {r["vec_id"]: tuple(r) for r in ed.near_vectors(df).collect()}
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    root = np.array([r[0] for r in rows])
    while True:
        new = np.minimum(root, np.where(near, root, len(v)).min(axis=1))
        if (new == root).all():
            break
        root = new
    assert near.sum() > 1000
    assert got == {r[0]: (r[0], int(n), int(c), r[0] == int(c)) for r, n, c in zip(rows, near.sum(axis=1), root, strict=True)}


def test_traversal_stops_at_the_bound():
    """Every cell under the bound is visited and no other, for rows turned to the principal axes too."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 10)) * np.linspace(3, 0.2, 10)
    x /= np.linalg.norm(x, axis=1)[:, None]
    grid = ed.Grid(ed.kmeans(x[:, :5], 7), ed.kmeans(x[:, 5:], 7))
    for cosine in (0.99, 0.9, -1.0):
        least = ed._to_borders(x[:, :5], grid.left)[:, :, None] + ed._to_borders(x[:, 5:], grid.right)[:, None, :]
        row, i, j = np.nonzero(least <= 2 - 2 * cosine + ed.SLACK)
        got = list(zip(*(c.tolist() for c in grid.permitted(x, cosine)), strict=True))
        assert len(got) == len(set(got)) and set(got) == set(zip(row.tolist(), (i * 7 + j).tolist(), strict=True))


def test_vectors_between_centroids(spark, monkeypatch):
    """Vectors of few whole numbers lie on borders and their codebooks repeat centroids."""
    monkeypatch.setattr(ed, "BLOCK", 20)
    monkeypatch.setattr(ed, "CELL", 1)
    rng = np.random.default_rng(9)
    rows = [(i, rng.choice([-1.0, 0.0, 1.0], 7, p=[0.1, 0.6, 0.3]).tolist(), 1, "c", 2) for i in range(400)]
    got = ed.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))
