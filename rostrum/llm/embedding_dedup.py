"""Embedding near-dedup over an inverted multi-index.

Vectors are scaled to length 1 in double precision; equal ones form a class and travel on as one. They are turned to the
sample's principal axes, dealt to the two halves in turn, so that both halves carry their share of the length. Two
independent codebooks, one for each half, form a grid of cells. A vector's home is its nearest cell. It visits the cells of
the product nearest first, both codebooks' lists sorted by the distance to the cell's border, until no further cell can
hold a partner: the recall reached is 1. Of these, empty cells and those whose farthest row is too far are passed over.
Candidates are verified by their cosine.

Cells that follow each other make ranges of up to a block of rows, and a vector is sent once to each range that has a cell
to visit, so it never travels more often than in a comparison of all blocks with all. Of two homes in different ranges the
lesser is visited, so a pair comes by once. A range's rows are dealt into blocks, so that no task holds more than two
blocks, and within a block pair links are counted and joined into components without listing them. Where the vectors have
no structure that the borders could use, this is a comparison of all with all.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do
vectors of different length; repeated rows count as vectors of their own; a null vec_id never names a component that has
another; an empty table gives an empty result; columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

COSINE = 0.9
#: Expected size of the sample the codebooks are fitted on.
SAMPLE = 8192
#: Most centroids of a codebook; rows of a block; expected classes of a cell.
CENTROIDS, BLOCK, CELL = 256, 4096, 256
#: Rows of a block that are compared at a time; what rounding may add to a squared distance; the least distance of two
#: centroids whose border counts; squared distances that rounding may swap.
STRIP, SLACK, APART, TIE = 256, 1e-6, 1e-6, 1e-9


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units: list[bytes | None] = []
        for x in batch.column("embedding"):
            values = x.values.to_numpy(zero_copy_only=False).astype(np.float64) if x.is_valid and len(x.values) else np.zeros(0)
            most = np.abs(values).max() if len(values) else 0.0
            if not np.isfinite(most) or most == 0 or (x.values.null_count if x.is_valid else 0):
                units.append(None)
                continue
            values = values / most
            units.append((values / np.sqrt(values @ values) + 0.0).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(units, pa.binary())], ["vec_id", "unit"])


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        near = _distances(points, centers).argmin(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=k)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1), 0)


class Grid:
    """Two codebooks and the traversal of their product; `axes` turns vectors first, `radius` is how far from its centroids
    a cell's rows reach (-inf if it has none), where known."""

    def __init__(self, left: np.ndarray, right: np.ndarray, axes: np.ndarray | None = None):
        self.left, self.right, self.k, self.half, self.axes = left, right, len(left), left.shape[1], axes
        self.radius: np.ndarray | None = None

    def turned(self, x: np.ndarray) -> np.ndarray:
        return x if self.axes is None else x @ self.axes

    @property
    def dim(self) -> int:
        return self.half + self.right.shape[1]

    def visits(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n cells nearest to each row, nearest first: what multi-sequence traversal yields. In its order, the i-th
        and j-th nearest centroids come after at least (i + 1) * (j + 1) - 1 other cells, so only few need a look."""
        n = min(n, self.k * self.k)
        pairs = np.array([(i, j) for i in range(min(n, self.k)) for j in range(min(n // (i + 1), self.k))])
        sides = [_distances(x[:, : self.half], self.left), _distances(x[:, self.half :], self.right)]
        order = [s.argsort(axis=1, kind="stable") for s in sides]
        near = [np.take_along_axis(s, o, axis=1) for s, o in zip(sides, order, strict=True)]
        sums = near[0][:, pairs[:, 0]] + near[1][:, pairs[:, 1]]
        best = sums.argsort(axis=1, kind="stable")[:, :n]
        rows = np.arange(len(x))[:, None]
        return order[0][rows, pairs[best, 0]] * self.k + order[1][rows, pairs[best, 1]]

    def ranks(self, query: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The place of each cell in the query's traversal."""
        left, right = _distances(query[None, : self.half], self.left)[0], _distances(query[None, self.half :], self.right)[0]
        sums = np.sort((left[:, None] + right).ravel())
        return np.searchsorted(sums, left[cells // self.k] + right[cells % self.k], "right")

    def homes(self, x: np.ndarray) -> np.ndarray:
        return _distances(x[:, : self.half], self.left).argmin(axis=1) * self.k + _distances(x[:, self.half :], self.right).argmin(axis=1)

    def permitted(self, x: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """row, cell: the cells that can be home to a vector of this cosine or more to the row (all of length 1).

        A row's traversal goes along both lists of border distances, nearest first; the cells before its stop are, for
        each entry of the left list, a first part of the right one."""
        limit = 2 - 2 * cosine + SLACK
        rows, cells, step = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], max(1, (1 << 21) // (self.k * self.k))
        for at in range(0, len(x), step):
            part = x[at : at + step]
            sides = [_to_borders(part[:, : self.half], self.left), _to_borders(part[:, self.half :], self.right)]
            left, right = order = [d.argsort(axis=1, kind="stable") for d in sides]
            near = [np.take_along_axis(d, o, axis=1) for d, o in zip(sides, order, strict=True)]
            # All rows' right lists in one, each in a stretch of values of its own; what can't be reached lies at its end.
            own = np.arange(len(part))[:, None] * 16.0
            reach = np.where(near[0] <= limit, limit - near[0], -1.0)
            upto = np.searchsorted((np.minimum(near[1], 8) + own).ravel(), (reach + own).ravel(), "right") - np.repeat(np.arange(len(part)) * self.k, self.k)
            row, i = np.divmod(np.repeat(np.arange(upto.size), upto), self.k)
            j = np.arange(len(row)) - np.repeat(np.cumsum(upto) - upto, upto)
            i, j = left[row, i], right[row, j]
            cell = i * self.k + j
            if self.radius is not None:
                away = np.sqrt(_distances(part[:, : self.half], self.left)[row, i] + _distances(part[:, self.half :], self.right)[row, j])
                near = away - self.radius[cell] <= np.sqrt(limit) + SLACK
                row, cell = row[near], cell[near]
            rows.append(row + at)
            cells.append(cell)
        return np.concatenate(rows), np.concatenate(cells)


def _to_borders(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """For each row and centroid, at most the squared distance to the points nearest to that centroid: the farthest of the
    planes half-way to another centroid that lie between."""
    d, apart = _distances(x, centers), np.sqrt(_distances(centers, centers))
    inverse = np.where(apart > APART, 0.5 / np.maximum(apart, APART), 0)
    return ((d[:, :, None] - d[:, None, :]) * inverse).max(axis=2) ** 2


def fit_grid(classes: DataFrame, n: int) -> Grid | None:
    """Codebooks for the most frequent vector length, from a bounded sample; None without vectors."""
    lengths = classes.groupBy(F.length("unit").alias("bytes")).count().orderBy(F.desc("count"), "bytes").limit(1).collect()
    if not lengths or lengths[0]["bytes"] < 16:
        return None
    share = min(1.0, SAMPLE / n)
    drawn = classes.where((F.length("unit") == lengths[0]["bytes"]) & (F.pmod(F.xxhash64("class"), F.lit(1 << 30)) < int(share * (1 << 30)))).select("unit").collect()
    points = np.frombuffer(b"".join(sorted(bytes(r["unit"]) for r in drawn)), np.float64).reshape(len(drawn), lengths[0]["bytes"] // 8)
    k = int(min(CENTROIDS, len(points), max(1, round((n / CELL) ** 0.5))))
    if k < 1:
        return None
    axes = np.linalg.eigh(np.cov(points, rowvar=False, bias=True))[1][:, ::-1]
    axes = np.concatenate([axes[:, ::2], axes[:, 1::2]], axis=1)
    points, half = points @ axes, (points.shape[1] + 1) // 2
    books = [kmeans(side, k) for side in (points[:, :half], points[:, half:])]
    left, right = (book[book[:, 0].argsort(kind="stable")] for book in books)  # in order along the main axis
    return Grid(left, right, axes)


def _fitting(grid: Grid | None, units: list[bytes]) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """The places of units of other lengths; and, in strips, the places of the grid's and their turned vectors."""
    fits = np.array([grid is not None and len(u) == grid.dim * 8 for u in units], bool)
    rows = np.flatnonzero(fits)
    parts = (rows[at : at + STRIP] for at in range(0, len(rows), STRIP))
    return np.flatnonzero(~fits), ((part, grid.turned(np.frombuffer(b"".join(units[i] for i in part), np.float64).reshape(len(part), -1))) for part in parts)


def _homes(grid: Grid):
    """home, n, away: a task's rows by cell, and the largest squared distance to its centroids. Where rounding could send
    a row to another cell next time, its distance counts for each of these cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far, counts = np.full((grid.k, grid.k), -1.0), np.zeros(grid.k * grid.k, np.int64)
        for batch in batches:
            for _, x in _fitting(grid, batch.column("unit").to_pylist())[1]:
                left, right = _distances(x[:, : grid.half], grid.left), _distances(x[:, grid.half :], grid.right)
                home, away = left.argmin(axis=1) * grid.k + right.argmin(axis=1), left.min(axis=1) + right.min(axis=1)
                counts += np.bincount(home, minlength=len(counts))
                np.maximum.at(far.reshape(-1), home, away)
                close = [side <= side.min(axis=1)[:, None] + TIE for side in (left, right)]
                for row in np.flatnonzero((close[0].sum(axis=1) > 1) | (close[1].sum(axis=1) > 1)).tolist():
                    cells = np.ix_(close[0][row], close[1][row])
                    far[cells] = np.maximum(far[cells], away[row])
        held = np.flatnonzero(far.reshape(-1) >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held]), pa.array(far.reshape(-1)[held])], ["home", "n", "away"])

    return run


def ranges_of(grid: Grid | None, classes: DataFrame) -> np.ndarray:
    """The range of each cell: cells in order, up to BLOCK rows together; one with more has a range of its own. Tells the
    grid its radii. Of the table only count and radius of at most CENTROIDS squared cells reach the driver."""
    if grid is None:
        return np.zeros(0, np.int64)
    counts, grid.radius = np.zeros(grid.k * grid.k, np.int64), np.full(grid.k * grid.k, -np.inf)
    homes = classes.select("unit").mapInArrow(_homes(grid), "home long, n long, away double")
    for home, n, away in homes.groupBy("home").agg(F.sum("n").alias("n"), F.max("away").alias("away")).collect():
        counts[home], grid.radius[home] = n, np.sqrt(away)
    out, at, held = np.zeros(len(counts), np.int64), 0, 0
    for cell, n in enumerate(counts.tolist()):
        if held and held + n > BLOCK:
            at, held = at + 1, 0
        out[cell], held = at, held + n
    return out


PLACED = "cell long, class long, m long, home long, is_home boolean, unit binary"


def _placed(grid: Grid | None, ranges: np.ndarray, cosine: float):
    """Each vector in the range of its home and in the lesser ranges with cells that it visits; `cell` and `home` are ranges."""
    names = [c.split()[0] for c in PLACED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, m, units = batch.column("class").to_numpy(), batch.column("m").to_numpy(), batch.column("unit").to_pylist()
            others, strips = _fitting(grid, units)
            for i in others.tolist():  # other lengths share one cell for each length
                home = -1 - len(units[i]) // 8
                yield pa.RecordBatch.from_arrays([pa.array([home]), pa.array(own[i : i + 1]), pa.array(m[i : i + 1]), pa.array([home]), pa.array([True]), pa.array([units[i]], pa.binary())], names)
            for part, x in strips:
                homes = ranges[grid.homes(x)]
                row, cell = grid.permitted(x, cosine)
                row, cell = np.divmod(np.unique(row * len(ranges) + ranges[cell]), len(ranges))
                lesser = cell < homes[row]
                row, cell = np.r_[np.arange(len(part)), row[lesser]], np.r_[homes, cell[lesser]]
                for k in range(0, len(row), 1 << 14):
                    r, c = row[k : k + (1 << 14)], cell[k : k + (1 << 14)]
                    yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(own[part[r]]), pa.array(m[part[r]]), pa.array(homes[r]), pa.array(c == homes[r]), pa.array([units[i] for i in part[r]], pa.binary())], names)

    return run


def _linked(cosine: float):
    big = np.iinfo(np.int64).max

    def run(group: pa.Table) -> pa.Table:
        base = group.filter(group.column("side"))
        query = group.filter(pa.compute.invert(group.column("side")))
        b_own, q_own, b_m, q_m, q_home = base.column("class").to_numpy(), query.column("class").to_numpy(), base.column("m").to_numpy(), query.column("m").to_numpy(), query.column("home").to_numpy()
        if not len(b_own) or not len(q_own):
            return pa.table({"class": pa.array([], pa.int64()), "root": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        cell = group.column("cell")[0].as_py()
        b, q = (np.frombuffer(b"".join(t.column("unit").to_pylist()), np.float64).reshape(t.num_rows, -1) for t in (base, query))
        strips = [slice(at, at + STRIP) for at in range(0, len(q), STRIP)]
        near = np.zeros((len(q), len(b)), bool)
        for part in strips:
            near[part] = (q[part] @ b.T >= cosine) & (q_own[part, None] != b_own)
        # Each ordered pair of one home comes by once; a pair of two homes once for both its directions.
        away = q_home != cell
        n_q, n_b = np.zeros(len(q), np.int64), np.zeros(len(b), np.int64)
        root_q, root_b = q_own.copy(), b_own.copy()
        linked = [part for part in strips if near[part].any()]
        for part in linked:
            n_q[part] = near[part] @ b_m
            n_b += (near[part] & away[part, None]).T @ q_m[part]
        while linked:
            new_q, new_b = root_q.copy(), root_b.copy()
            for part in linked:
                new_q[part] = np.minimum(root_q[part], np.where(near[part], root_b, big).min(axis=1))
                new_b = np.minimum(new_b, np.where(near[part], new_q[part, None], big).min(axis=0))
            if (new_q == root_q).all() and (new_b == root_b).all():
                break
            root_q, root_b = new_q, new_b
        some_q, some_b = near.any(axis=1), near.any(axis=0)
        own, root, n = (np.r_[x[some_q], y[some_b]] for x, y in ((q_own, b_own), (root_q, root_b), (n_q, n_b)))
        return pa.table({"class": own, "root": root, "n": n.astype(np.int64)})

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, target: float = 1.0) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding). Every pair is found, whatever the
    target (least recall) asks for."""
    units = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_units, "vec_id long, unit binary")
    own = F.when(F.col("unit").isNotNull(), F.xxhash64("unit", F.lit(1)))
    units = common.settled(units.withColumn("class", own), "units")
    valid = units.where("class is not null")
    classes = common.settled(valid.groupBy("class").agg(F.first("unit").alias("unit"), F.count("*").alias("m"), F.min("vec_id").alias("least")), "vectors")
    n = max(1, classes.count())
    grid = fit_grid(classes, n)
    ranges = ranges_of(grid, classes)
    placed = classes.select("class", "m", "unit").mapInArrow(_placed(grid, ranges, cosine), PLACED)
    placed = common.settled(placed, "placed")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count_if("is_home") / BLOCK).alias("bases"), F.ceil(F.count("*") / BLOCK).alias("queries"), F.count("*").alias("rows")).where("bases > 0 and rows > 1")
    dealt = placed.join(sizes, "cell")
    block = lambda n, salt: F.pmod(F.xxhash64("class", F.lit(salt)), F.col(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ["cell", "base_block", "query_block", "class", "m", "home", "unit", "side"]
    bases = dealt.where("is_home").withColumn("base_block", block("bases", 1)).withColumn("query_block", upto("queries")).withColumn("side", F.lit(True)).select(*columns)
    queries = dealt.withColumn("query_block", block("queries", 2)).withColumn("base_block", upto("bases")).withColumn("side", F.lit(False)).select(*columns)
    found = bases.unionByName(queries).groupBy("cell", "base_block", "query_block").applyInArrow(_linked(cosine), "class long, root long, n long")
    found = common.settled(found, "vector-links")
    roots = components(found.select(F.col("class").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "class")
    degrees = found.groupBy("class").agg(F.sum("n").alias("n"))
    per_class = classes.select("class", "m", "least").join(degrees, "class", "left").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    names = per_class.groupBy("root").agg(F.min("least").alias("component_id"))
    per_class = per_class.join(names, "root").select("class", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    out = valid.select("vec_id", "class").join(common.settled(per_class, "vector-classes"), "class").select("vec_id", "n_links", "component_id")
    alone = units.where("class is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(common.table(spark, sf_dir, "embeddings"))
