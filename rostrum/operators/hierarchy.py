"""Hierarchical density clusters: core distances, the minimum spanning forest of mutual reachability, the condensed tree.

Vectors are dealt into blocks of neighbours (cells round sampled pivots). Blocks are met once for every vector's list of
nearest neighbours, by products in single precision as a sieve. Boruvka rounds follow the lists' edges: what a list leaves
out comes after its last entry, so a component's least listed edge is its least of all if it comes before the last entries of
all its members. The few components left are met once more, by vectors that can still have a shorter link than the listed
edges give. No pair of vectors is listed. A task has the blocks of two bundles and hands on one list for each vector, or one
edge for two components, so what travels grows with the bundles, not the blocks.

The forest's edges in rising order are the merges of a single-linkage hierarchy. They are worked off LEVEL at a time, each
level in one bounded task, which carries on sizes and open clusters and decides by excess of mass which clusters stay; the
way from a point up to its cluster is found by pointer jumping.

Edges are ordered by (distance, lesser key, greater key), distances rounded to PLACES, so every result is determined, ties
included. Keys are longs. Rows without key or vector, or with null, NaN or infinite entries, are noise; so is every row of a
table with fewer than min_size others. Keys have to be distinct.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostrum.functions.vectors import scaled
from rostrum.operators import nearest
from rostrum.operators.cluster import quality
from rostrum.operators.order import numbered
from rostrum.sources.store import stored

#: Vectors of a block at most (about), and pivots at most; merges of a level; decimals of a distance.
BLOCK, PIVOTS, LEVEL, PLACES = 2048, 4096, 1 << 20, 9
#: Vectors of a bundle of blocks at most (about), bundles at least, and edges that a task gathers before it thins them out.
WIDE, BUNDLES, EDGES = 1 << 16, 8, 1 << 20
#: Neighbours in a list at least, and components at most for which a task is told the limits of all pairs.
LISTED, FEW = 10, 1024
#: The least distance that a density is taken of.
LEAST = 1e-12
EDGE = "a long, b long, d double"


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)


def _valid(points: DataFrame, key: str, vector: str, metric: str) -> DataFrame:
    rows = points.select(F.col(key).cast("long").alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where("key is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return rows.withColumn("v", scaled(F.col("v"))) if metric == "cosine" else rows


class Blocks:
    """Vectors in packed blocks (block, keys, body, centre, radius), a row each, and the bounds between them."""

    def __init__(self, points: DataFrame, key: str, vector: str, metric: str = "euclidean"):
        rows = stored(_valid(points, key, vector, metric), "hierarchy-vectors")
        self.spark, self.n = rows.sparkSession, rows.count()
        first = rows.select(F.size("v").alias("dims")).limit(1).collect()
        self.dims = dims = first[0]["dims"] if first else 1
        cells = min(PIVOTS, -(-self.n // BLOCK))
        pivots = np.array([r["v"] for r in rows.orderBy(F.xxhash64("key"), "key").limit(cells).collect()], np.float64).reshape(-1, dims)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = batch.column("v").flatten().to_numpy().reshape(-1, dims)
                cell = ((pivots * pivots).sum(axis=1) - 2 * v @ pivots.T).argmin(axis=1) if len(v) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(cell.astype(np.int32))], ["key", "body", "cell"])

        in_cells = stored(rows.mapInArrow(placed, "key long, body binary, cell int"), "hierarchy-cells")
        sizes = in_cells.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
        starts = sizes.withColumn("start", F.coalesce(F.sum("parts").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        dealt = in_cells.join(F.broadcast(starts), "cell").select("key", "body", (F.col("start") + F.pmod(F.xxhash64("key"), F.col("parts"))).cast("int").alias("block"))

        def packed(table: pa.Table) -> pa.Table:
            table = table.sort_by("key")
            v = _matrix(table.column("body"), dims)
            centre = v.mean(axis=0)
            radius = float(np.sqrt(((v - centre) ** 2).sum(axis=1).max()))
            return pa.table({"block": table.column("block")[:1], "keys": pa.array([table.column("key").to_numpy().tobytes()], pa.binary()), "body": pa.array([v.tobytes()], pa.binary()), "centre": pa.array([centre.tolist()]), "radius": [radius]})

        self.table = stored(dealt.groupBy("block").applyInArrow(packed, "block int, keys binary, body binary, centre array<double>, radius double"), "hierarchy-blocks")
        self.wide = self.bundle()

    def bounds(self) -> DataFrame:
        """i <= j and low, the least distance that vectors of both blocks can have."""
        own = self.table.select("block", "centre", "radius")
        one, two = own.toDF("i", "ci", "ri"), own.toDF("j", "cj", "rj")
        apart = F.sqrt(F.aggregate(F.zip_with("ci", "cj", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
        low = F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.greatest(F.lit(0.0), apart - F.col("ri") - F.col("rj") - 1e-9))
        return stored(one.join(two, F.col("i") <= F.col("j")).select("i", "j", low.alias("low")), "hierarchy-bounds")

    def bundle(self) -> int:
        """How many blocks make a bundle."""
        blocks = self.table.count()
        return max(1, min(-(-blocks // BUNDLES), blocks * WIDE // max(self.n, 1)))

    def met(self, pairs: DataFrame, run, schema: str, extra: DataFrame | None = None) -> DataFrame:
        """run over the rows of the blocks of two bundles (by block: keys, vectors, packed further columns that extra gives
        a block) and their pairs of blocks."""
        rows = self.table.select("block", "keys", "body")
        rows = rows.join(extra, "block") if extra is not None else rows
        wide, dims = F.lit(self.wide), self.dims
        of = stored(pairs.select(F.floor(F.col("i") / wide).alias("one"), F.floor(F.col("j") / wide).alias("two"), "i", "j"), "hierarchy-pairs")
        wanted = of.select(F.col("one").alias("p"), F.col("two").alias("q"), F.explode(F.array("i", "j")).alias("block")).distinct()
        both = rows.join(F.broadcast(wanted), "block")
        more = [c for c in rows.columns if c not in ("block", "keys", "body")]

        def whole(table: pa.Table, listed: pa.Table) -> pa.Table:
            of = {}
            for s, block in enumerate(table.column("block").to_pylist()):
                keys = np.frombuffer(table.column("keys")[s].as_buffer(), np.int64)
                of[block] = (keys, _matrix(table.column("body")[s : s + 1], dims), *[table.column(c)[s].as_buffer() for c in more])
            return run(of, sorted(zip(listed.column("i").to_pylist(), listed.column("j").to_pylist(), strict=True)))

        return both.groupBy("p", "q").cogroup(of.groupBy("one", "two")).applyInArrow(whole, schema)


def near_lists(blocks: Blocks, bounds: DataFrame, many: int) -> DataFrame:
    """block, keys, far, others (packed, in the order of its keys): distances and keys of each vector's nearest others, of
    equals the lesser keys. A block is met by itself first; then only by blocks that can hold something nearer."""
    k = min(max(many - 1, LISTED), blocks.n - 1)

    def least(of: dict, pairs: list) -> pa.Table:
        sieve = nearest.Sieve({b: x[1] for b, x in of.items()})
        far = {b: np.full((len(x[0]), k), np.inf) for b, x in of.items()}
        others = {b: np.full((len(x[0]), k), -1) for b, x in of.items()}
        limit = {b: np.frombuffer(x[2], np.float64).copy() if len(x) > 2 else np.full(len(x[0]), np.inf) for b, x in of.items()}

        def learned(b: int, r: np.ndarray, other: np.ndarray, d: np.ndarray) -> None:
            good = d <= limit[b][r]
            if good.any():
                nearest.merge(far[b], others[b], r[good], other[good], d[good])
                limit[b] = np.minimum(limit[b], far[b][:, -1])

        for i, j in pairs:
            (one, v), (two, w) = of[i][:2], of[j][:2]
            for at in range(0, len(one), nearest.STRIP):
                rows = slice(at, at + nearest.STRIP)
                for r, c in sieve.within(i, rows, j, limit[i][rows], limit[j] if i != j else np.full(len(two), -1.0), k + 1):
                    real = one[r] != two[c]
                    r, c = r[real], c[real]
                    d = nearest.euclidean(v[r], w[c], PLACES)
                    learned(i, r, two[c], d)
                    if i != j:
                        learned(j, c, one[r], d)
        return _lists({b: (of[b][0], far[b], others[b]) for b in of})

    def merged(table: pa.Table) -> pa.Table:
        best = None
        for keys, x, y in zip(*[table.column(c) for c in ("keys", "far", "others")], strict=True):
            keys, far, others = (np.frombuffer(c.as_buffer(), t) for c, t in ((keys, np.int64), (x, np.float64), (y, np.int64)))
            far, others = far.reshape(-1, k).copy(), others.reshape(-1, k).copy()
            if best is not None:
                r, c = np.nonzero(np.isfinite(best[1]))
                nearest.merge(far, others, r, best[2][r, c], best[1][r, c])
            best = keys, far, others
        return _lists({table.column("block")[0].as_py(): best})

    schema = "block int, keys binary, far binary, others binary, most double"
    if k < 1:
        return blocks.spark.createDataFrame([], schema)
    own = stored(blocks.met(bounds.where("i = j"), least, schema), "hierarchy-near")
    most = own.select("block", "most")
    wanted = bounds.where("i <> j").join(most.toDF("i", "mi"), "i").join(most.toDF("j", "mj"), "j").where("low <= greatest(mi, mj)").select("i", "j")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [np.frombuffer(x.as_buffer(), np.float64).reshape(-1, k)[:, -1].tobytes() for x in batch.column("far")]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(ends, pa.binary())], ["block", "limit"])

    found = own.unionByName(blocks.met(wanted, least, schema, own.mapInArrow(last, "block int, limit binary")))
    return stored(found.groupBy("block").applyInArrow(merged, schema), "hierarchy-near")


def _lists(of: dict) -> pa.Table:
    packed = [pa.array([x[c].tobytes() for x in of.values()], pa.binary()) for c in range(3)]
    most = [float(x[1][:, -1].max()) if x[1].size else 0.0 for x in of.values()]
    return pa.table([pa.array(list(of), pa.int32()), *packed, pa.array(most, pa.float64())], ["block", "keys", "far", "others", "most"])


def core_distances(blocks: Blocks, bounds: DataFrame, min_points: int, lists: DataFrame | None = None) -> DataFrame:
    """The rows of near_lists with core (packed): distances to the min_points-th nearest vector, itself included."""
    k = min(min_points, blocks.n)

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for keys, far in zip(batch.column("keys"), batch.column("far"), strict=True):
                n = len(keys.as_buffer()) // 8
                x = np.frombuffer(far.as_buffer(), np.float64).reshape(n, -1)
                found.append((x[:, k - 2] if k > 1 else np.zeros(n)).tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("block", "keys", "far", "others")], pa.array(found, pa.binary())], ["block", "keys", "far", "others", "core"])

    lists = near_lists(blocks, bounds, min_points) if lists is None else lists
    return lists.mapInArrow(cores, "block int, keys binary, far binary, others binary, core binary")


def tree_of_edges(table: pa.Table) -> pa.Table:
    """Those of the given edges a, b, d that are in their minimum spanning forest, by rounds in which every component keeps
    its least edge to another. They link a and b, or ca and cb where given."""
    table = table.sort_by([("d", "ascending"), ("a", "ascending"), ("b", "ascending")])
    ends = np.concatenate([table.column(c).to_numpy() for c in (("ca", "cb") if "ca" in table.column_names else ("a", "b"))])
    names, place = np.unique(ends, return_inverse=True)
    a, b = place[: len(table)], place[len(table) :]
    comp, live, kept = np.arange(len(names)), np.arange(len(table)), np.zeros(len(table), bool)
    while True:
        live = live[comp[a[live]] != comp[b[live]]]
        if not len(live):
            return table.filter(pa.array(kept))
        first = np.full(len(names), len(table))
        np.minimum.at(first, comp[a[live]], live)
        np.minimum.at(first, comp[b[live]], live)
        own = np.flatnonzero(first < len(table))
        edge = first[own]
        kept[edge] = True
        up = np.arange(len(names))
        up[own] = np.where(comp[a[edge]] == own, comp[b[edge]], comp[a[edge]])
        root = own[(up[up[own]] == own) & (own < up[own])]
        up[root] = root
        while (up[up] != up).any():
            up = up[up]
        comp = up[comp]


LINK = f"{EDGE}, ca long, cb long"


def spanning_forest(blocks: Blocks, bounds: DataFrame, cores: DataFrame) -> DataFrame:
    """a < b, d: the minimum spanning tree of mutual reachability over all vectors."""
    spark, many = blocks.spark, blocks.n
    if many < 2:
        return spark.createDataFrame([], EDGE)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, *packed in zip(*[batch.column(c) for c in ("block", "keys", "far", "others", "core")], strict=True):
                keys, far, others, core = (np.frombuffer(x.as_buffer(), t) for x, t in zip(packed, (np.int64, np.float64, np.int64, np.float64), strict=True))
                k = len(far) // len(keys)
                near = [pa.ListArray.from_arrays(pa.array(np.arange(0, len(far) + 1, k), pa.int32()), pa.array(x)) for x in (far, others)]
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()] * len(keys), pa.int32()), pa.array(keys), pa.array(core), *near], ["block", "key", "core", "far", "others"])

    points = stored(cores.mapInArrow(unpacked, "block int, key long, core double, far array<double>, others array<long>"), "hierarchy-points")
    listed = points.select("key", "core", F.explode(F.arrays_zip("far", "others")).alias("x")).select("key", "core", F.col("x.far").alias("far"), F.col("x.others").alias("other"))
    edges = listed.join(points.select(F.col("key").alias("other"), F.col("core").alias("own")), "other")
    edges = edges.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b"), F.greatest("far", "core", "own").alias("d")).distinct()
    open_ = stored(edges.select("*", F.col("a").alias("ca"), F.col("b").alias("cb")), "boruvka")
    # What a list leaves out comes after its last entry; a list of all others leaves out nothing.
    end, reach = F.element_at("others", -1), F.when(F.size("far") < many - 1, F.element_at("far", -1)).otherwise(float("inf"))
    tail = F.struct(reach.alias("d"), F.least("key", end).alias("a"), F.greatest("key", end).alias("b"))
    points = stored(points.select("block", "key", "core", F.col("key").alias("c"), tail.alias("tail")), "hierarchy-points")
    points, open_, kept = grown(points, open_)
    while (left := points.select("c").distinct().limit(FEW + 1).count()) > 1:
        tree = component_tree(open_).collect() if left <= FEW else []
        few = 0 < left - 1 == len(tree)
        if few:
            names, limits = pair_limits([(r["ca"], r["cb"], r["d"]) for r in tree])
            own, most = F.lit(0.0), float(limits.max())
        else:
            names = limits = None
            ends = open_.select(F.col("ca").alias("c"), "d").union(open_.select("cb", "d")).groupBy("c").agg(F.min("d").alias("u"))
            points = stored(points.drop("u").join(ends, "c", "left").withColumn("u", F.coalesce("u", F.lit(float("inf")))), "hierarchy-points")
            own, most = F.col("u"), points.agg(F.max("u")).first()[0]
        extra = points.select("block", "key", "c", "core", F.col("tail.d").alias("reach"), own.alias("u")).groupBy("block").applyInArrow(_packed, "block int, parts binary, cores binary, reach binary, u binary")
        pairs = bounds.where(f"low <= {most!r}D" if np.isfinite(most) else "true").select("i", "j")
        found = blocks.met(pairs, _links(names, limits), LINK, extra)
        open_ = stored(open_.select(*LINKED).union(found.select(*LINKED)), "boruvka")
        if few:
            kept.append(component_tree(open_).select("a", "b", "d"))
            break
        points, open_, new = grown(points, open_, sure=True)
        kept += new
    return stored(reduce(DataFrame.union, kept), "forest")


LINKED = ["a", "b", "d", "ca", "cb"]


def _packed(table: pa.Table) -> pa.Table:
    table = table.sort_by("key")
    return pa.table([table.column("block")[:1], *[pa.array([table.column(c).to_numpy().tobytes()], pa.binary()) for c in ("c", "core", "reach", "u")]], ["block", "parts", "cores", "reach", "u"])


def component_tree(links: DataFrame) -> DataFrame:
    """The minimum spanning forest of at most FEW components; of two components only the least link goes to its task."""
    pairs = links.groupBy(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).agg(F.min(F.struct("d", "a", "b")).alias("e"))
    return pairs.select("e.a", "e.b", "e.d", "ca", "cb").groupBy(F.lit(0).alias("all")).applyInArrow(lambda table: tree_of_edges(table.select(LINKED)), LINK)


def pair_limits(tree: list[tuple[int, int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Names of components, and the greatest edge on the tree's way between each two (-1 for a component and itself)."""
    names = np.unique([x for a, b, _ in tree for x in (a, b)])
    limits, group = np.full((len(names), len(names)), -1.0), {i: [i] for i in range(len(names))}
    for a, b, d in sorted(tree, key=lambda e: e[2]):
        one, two = (group[int(np.searchsorted(names, x))] for x in (a, b))
        limits[np.ix_(one, two)] = d
        limits[np.ix_(two, one)] = d
        both = one + two
        group.update(dict.fromkeys(both, both))
    return names, limits


def _links(names: np.ndarray | None, limits: np.ndarray | None):
    """The least edges between components among two bundles that may be in the tree: of each two components, where limits of
    all pairs are given; else at least each component's least one."""

    def run(of: dict, pairs: list) -> pa.Table:
        of = {b: (keys, v, *(np.frombuffer(x, t) for x, t in zip(more, (np.int64, np.float64, np.float64, np.float64), strict=True))) for b, (keys, v, *more) in of.items()}
        known = names if names is not None else np.unique(np.concatenate([x[2] for x in of.values()]))
        at = {b: np.searchsorted(known, x[2]) for b, x in of.items()}
        if limits is not None:
            most, now = limits.max(axis=1), limits.copy()
            live = {b: x[4] <= most[at[b]] for b, x in of.items()}  # others have all edges that matter in their lists
            of = {b: tuple(c[live[b]] for c in x) for b, x in of.items()}
            at = {b: c[live[b]] for b, c in at.items()}
        else:
            now = np.full(len(known), np.inf)
            for b, x in of.items():
                np.minimum.at(now, at[b], x[5])
        sieve = nearest.Sieve({b: x[1] for b, x in of.items()})
        found, many = [], 0

        def measured(i: int, j: int, r: np.ndarray, c: np.ndarray) -> np.ndarray:
            return np.maximum(np.maximum(nearest.euclidean(of[i][1][r], of[j][1][c], PLACES), of[i][3][r]), of[j][3][c])

        def lower(x: np.ndarray, y: np.ndarray, d: np.ndarray) -> None:
            for a, b in ((x, y), (y, x)):
                np.minimum.at(now, (a, b) if limits is not None else a, d)

        def thinned(parts: list) -> list:
            a, b, d, x, y = (np.concatenate(c) for c in zip(*parts, strict=True))
            if limits is not None:
                order = np.lexsort((b, a, d, y, x))
                first = np.r_[True, (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)] if len(order) else order
                return [tuple(c[order][first] for c in (a, b, d, x, y))]
            picked = []
            for own in (x, y):
                order = np.lexsort((b, a, d, own))
                picked.append(order[np.r_[True, np.diff(own[order]) != 0]] if len(order) else order)
            picked = np.unique(np.concatenate(picked))
            return [tuple(c[picked] for c in (a, b, d, x, y))]

        for i, j in pairs:
            if not len(at[i]) or not len(at[j]) or at[i].min() == at[i].max() == at[j].min() == at[j].max():
                continue
            for top in range(0, len(at[i]), nearest.STRIP):
                rows = slice(top, top + nearest.STRIP)
                x, y = at[i][rows], at[j]
                score = sieve.products(i, rows, j)
                score[x[:, None] == y] = -np.inf
                for r, c in ((np.arange(len(x)), score.argmax(axis=1)), (score.argmax(axis=0), np.arange(len(y)))):
                    real = score[r, c] > -np.inf
                    r, c = r[real], c[real]
                    lower(x[r], y[c], measured(i, j, r + top, c))
                limit = now[np.ix_(x, y)] if limits is not None else np.maximum(now[x][:, None], now[y])
                for r, c in sieve.places(i, rows, j, score, limit):
                    d = measured(i, j, r, c)
                    cx, cy, a, b = at[i][r], y[c], of[i][0][r], of[j][0][c]
                    good = (cx != cy) & (d <= (now[cx, cy] if limits is not None else np.maximum(now[cx], now[cy])))
                    cx, cy, a, b, d = (z[good] for z in (cx, cy, a, b, d))
                    lower(cx, cy, d)
                    found.append((np.minimum(a, b), np.maximum(a, b), d, np.minimum(cx, cy), np.maximum(cx, cy)))
                    many += len(d)
                    if many > EDGES:
                        found = thinned(found)
                        many = len(found[0][0])
        if not found:
            return pa.table({c: pa.array([], pa.float64() if c == "d" else pa.int64()) for c in LINKED})
        a, b, d, x, y = thinned(found)[0]
        return pa.table({"a": a, "b": b, "d": d, "ca": known[x], "cb": known[y]})

    return run


def grown(points: DataFrame, open_: DataFrame, sure: bool = False) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """points with new components c, the edges that are still open, and edges of the minimum spanning tree. In each round
    components take their least edge to another and follow them to a common root: those components whose edge comes before
    all that their points' lists leave out; or, in a single round, all (`sure`)."""
    kept: list[DataFrame] = []
    while True:
        ends = open_.select(F.col("ca").alias("c"), F.col("cb").alias("to"), "d", "a", "b").union(open_.select("cb", "ca", "d", "a", "b"))
        least = ends.groupBy("c").agg(F.min(F.struct("d", "a", "b", "to")).alias("e")).select("c", "e.*")
        if not sure:
            tails = points.groupBy("c").agg(F.min("tail").alias("tail"))
            least = least.join(tails, "c").where(F.struct("d", "a", "b") <= F.col("tail")).drop("tail")
        least = stored(least, "boruvka-least")
        if not least.limit(1).count():
            return points, open_, kept
        kept.append(least.select("a", "b", "d").distinct())
        back = least.select(F.col("c").alias("to"), F.col("to").alias("back"))
        # Two components that took the same edge point at each other: the lesser is the root. One that took none is its own.
        up = least.join(back, "to", "left").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("root"))
        ends = least.select(F.col("to").alias("c")).distinct().join(least, "c", "left_anti").select("c", F.col("c").alias("root"))
        roots = pointers(up.union(ends), "c", "root")
        points = stored(points.join(roots, "c", "left").withColumn("c", F.coalesce("root", "c")).drop("root"), "hierarchy-points")
        named = open_.join(roots.toDF("ca", "ra"), "ca", "left").join(roots.toDF("cb", "rb"), "cb", "left")
        named = named.select("a", "b", "d", F.coalesce("ra", "ca").alias("ca"), F.coalesce("rb", "cb").alias("cb"))
        open_ = stored(named.where("ca <> cb"), "boruvka")
        if sure:
            return points, open_, kept


def pointers(up: DataFrame, node: str, root: str) -> DataFrame:
    """node, root after following pointers to their ends, where a node points at itself; each round doubles the way."""
    now = stored(up, "pointers")
    while True:
        hop = now.select(F.col(node).alias(root), F.col(root).alias("__hop"))
        new = stored(now.join(hop, root).select(node, F.col("__hop").alias(root), (F.col("__hop") != F.col(root)).alias("moved")), "pointers")
        now = new.select(node, root)
        if not new.where("moved").limit(1).count():
            return now


STATE = "kind string, x long, y long, n long, v double, w double, won boolean"


def _merge_level(min_size: int):
    """Works off the merges of a level (no, a, b as names of components, d; size and open cluster of both). A cluster is
    named by its first merge. Rows out: `node` (component x is now in y, first joins cluster n), `open` (component x: size n,
    cluster y, sum of densities v, score of its parts w), `closed` (cluster x under y, excess of mass v, top distance w)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("no")
        columns = [table.column(c).to_pylist() for c in ("no", "a", "b", "d", "size_a", "cluster_a", "mass_a", "parts_a", "size_b", "cluster_b", "mass_b", "parts_b")]
        up: dict[int, int] = {}
        state: dict[int, tuple[int, int, float, float]] = {}  # size, open cluster, sum of densities, score of its parts
        joined: dict[int, int] = {}
        small: dict[int, list[int]] = {}  # components without a cluster, by their present one
        rows: list[tuple] = []

        def find(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for no, a, b, d, *ends in zip(*columns, strict=True):
            for x, given in ((a, ends[:4]), (b, ends[4:])):
                if x not in up:
                    up[x], state[x] = x, tuple(given)
                    if given[1] < 0:
                        small[x] = [x]
            ra, rb = find(a), find(b)
            (na, ka, ma, pa_), (nb, kb, mb, pb) = state.pop(ra), state.pop(rb)
            n, density = na + nb, 1 / max(d, LEAST)
            if ka >= 0 and kb >= 0:
                score = 0.0
                for k, size, mass, parts in ((ka, na, ma, pa_), (kb, nb, mb, pb)):
                    excess = round(mass - size * density, PLACES)
                    rows.append(("closed", k, no, size, excess, d, excess >= round(parts, PLACES)))
                    score += max(excess, parts)
                new = (n, no, n * density, score)
            elif ka >= 0 or kb >= 0:
                new = (n, max(ka, kb), max(ma, mb) + (nb if ka >= 0 else na) * density, max(pa_, pb))
            elif n >= min_size:
                new = (n, no, n * density, 0.0)
            else:
                new = (n, -1, 0.0, 0.0)
            root = min(ra, rb)
            up[ra] = up[rb] = root
            state[root] = new
            waiting = small.pop(ra, []) + small.pop(rb, [])
            if new[1] >= 0:
                joined.update(dict.fromkeys(waiting, new[1]))
            elif waiting:
                small[root] = waiting
        rows += [("node", x, find(x), joined.get(x, -1), 0.0, 0.0, False) for x in up]
        rows += [("open", x, k, n, m, p, False) for x, (n, k, m, p) in state.items()]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "x", "y", "n", "v", "w", "won"])

    return run


def condensed(forest: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    """clusters (cluster, parent, excess, top, won) that closed under another, and points (key, cluster): the first cluster
    each joins, -1 if none. A cluster won if its excess of mass is at least that of its parts."""
    merges = stored(numbered(forest, ["d", "a", "b"], out="no"), "merges")
    levels = -(-merges.count() // LEVEL)
    points = stored(forest.select(F.explode(F.array("a", "b")).alias("key")).distinct().select("key", F.col("key").alias("at"), F.lit(-1).cast("long").alias("cluster")), "points")
    known = None
    closed: list[DataFrame] = []
    for level in range(levels):
        now = merges.where((F.col("no") >= level * LEVEL) & (F.col("no") < (level + 1) * LEVEL))
        for end in ("a", "b"):
            fresh = [F.lit(1).cast("long").alias(f"size_{end}"), F.lit(-1).cast("long").alias(f"cluster_{end}"), F.lit(0.0).alias(f"mass_{end}"), F.lit(0.0).alias(f"parts_{end}")]
            if known is None:
                now = now.select("*", *fresh)
            else:
                own = known.toDF(end, f"size_{end}", f"cluster_{end}", f"mass_{end}", f"parts_{end}")
                now = now.join(own, end, "left")
                now = now.select(*[c for c in now.columns if not c.endswith(f"_{end}")], *[F.coalesce(f"{c}_{end}", F.lit(v)).alias(f"{c}_{end}") for c, v in (("size", 1), ("cluster", -1), ("mass", 0.0), ("parts", 0.0))])
        done = stored(now.groupBy(F.lit(0).alias("level")).applyInArrow(_merge_level(min_size), STATE), "level")
        closed.append(done.where("kind = 'closed'").select(F.col("x").alias("cluster"), F.col("y").alias("parent"), F.col("v").alias("excess"), F.col("w").alias("top"), "won"))
        moved = done.where("kind = 'node'").select(F.col("x").alias("at"), F.col("y").alias("to"), F.col("n").alias("first"))
        points = points.join(moved, "at", "left").select("key", F.coalesce("to", "at").alias("at"), F.when(F.col("cluster") < 0, F.coalesce("first", F.lit(-1))).otherwise(F.col("cluster")).alias("cluster"))
        if level + 1 < levels:
            points = stored(points, "points")
            for end in ("a", "b"):
                merges = merges.join(moved.select(F.col("at").alias(end), "to"), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
            merges = stored(merges.where(F.col("no") >= (level + 1) * LEVEL), "merges")
            opened = done.where("kind = 'open'").select("x", "n", "y", "v", "w")
            known = stored(opened if known is None else opened.unionByName(known.toDF("x", "n", "y", "v", "w").join(moved, F.col("x") == F.col("at"), "left_anti")), "open").toDF("c", "size", "cluster", "mass", "parts")
    if not closed:
        return forest.sparkSession.createDataFrame([], "cluster long, parent long, excess double, top double, won boolean"), points.select("key", "cluster")
    return stored(reduce(DataFrame.union, closed), "clusters"), points.select("key", "cluster")


def chosen(clusters: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """cluster, chosen for every closed cluster: the highest one on its way up that won (null if none did); with an epsilon,
    raised to the lowest that closed at that distance or above. What never closed is the root, which can't be chosen."""
    inner = clusters.join(clusters.select(F.col("cluster").alias("parent"), F.lit(True).alias("below")), "parent", "left").withColumn("below", F.coalesce("below", F.lit(False)))
    inner = stored(inner, "tree")
    own = F.when(F.col("won"), F.struct("top", "cluster"))
    way = stored(inner.select("cluster", F.when(F.col("below"), F.col("parent")).otherwise(F.col("cluster")).alias("up"), own.alias("best")), "ways")
    while True:
        hop = way.select(F.col("cluster").alias("up"), F.col("up").alias("hop"), F.col("best").alias("higher"))
        # Above stands what is merged at a greater distance, or later at the same: the later merge has the greater name.
        new = stored(way.join(hop, "up").select("cluster", F.col("hop").alias("up"), F.coalesce("higher", "best").alias("best"), (F.col("hop") != F.col("up")).alias("moved")), "ways")
        way = new.select("cluster", "up", "best")
        if not new.where("moved").limit(1).count():
            break
    found = way.select("cluster", F.col("best.cluster").alias("chosen"))
    if epsilon <= 0:
        return found
    raised = pointers(inner.select(F.col("cluster").alias("chosen"), F.when((F.col("top") < epsilon) & F.col("below"), F.col("parent")).otherwise(F.col("cluster")).alias("high")), "chosen", "high")
    return found.join(raised, "chosen", "left").select("cluster", F.col("high").alias("chosen"))


def _labelled(points: DataFrame, key: str, forest: DataFrame, min_size: int, epsilon: float) -> DataFrame:
    clusters, first = condensed(forest, min_size)
    placed = first.join(chosen(clusters, epsilon), "cluster", "left").where("chosen is not null").select("key", "chosen")
    names = placed.groupBy("chosen").agg(F.min("key").alias("label"))
    found = placed.join(names, "chosen").select(F.col("key").alias(key), F.col("label").alias("cluster"))
    return points.select(key).join(found, key, "left").select(key, F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))


def forest_of(points: DataFrame, key: str, vector: str, min_points: int, metric: str = "euclidean") -> DataFrame:
    """a, b, d: the minimum spanning tree of the vectors' mutual reachability."""
    blocks = Blocks(points, key, vector, metric)
    if not blocks.n:
        return points.sparkSession.createDataFrame([], EDGE)
    bounds = blocks.bounds()
    return spanning_forest(blocks, bounds, core_distances(blocks, bounds, min_points))


def density_hierarchy(points: DataFrame, key: str, vector: str, min_size: int = 10, min_points: int = 10, epsilon: float = 0.0, metric: str = "euclidean") -> DataFrame:
    """key, cluster: clusters of at least min_size vectors that hold the most excess of mass; a cluster is named by its least
    key, noise is -1. metric is euclidean or cosine (euclidean between vectors of length 1)."""
    return _labelled(points, key, forest_of(points, key, vector, min_points, metric), min_size, epsilon)


def silhouette(rows: DataFrame, clusters: int) -> float:
    """The mean silhouette, by squared distances, of rows (key, cluster, v), as ClusteringEvaluator has it, but by products of
    blocks of rows with blocks of clusters' means: where clusters grow with the table, a row can't go through them singly."""
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    means = rows.groupBy("cluster").agg(F.count("*").alias("size"), F.avg(square).alias("square"), Summarizer.mean(array_to_vector("v")).alias("m"))
    means = stored(means.select("cluster", "size", "square", vector_to_array("m").alias("m")), "means")
    pieces, groups = nearest.parts(rows.count(), WIDE), -(-clusters // WIDE)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    points = rows.withColumn("p", F.pmod(F.xxhash64("key"), F.lit(pieces)).cast("int")).select("*", each(groups).alias("g"))
    others = means.withColumn("g", F.pmod(F.xxhash64("cluster"), F.lit(groups)).cast("int")).select("*", each(pieces).alias("p"))

    def run(points: pa.Table, means: pa.Table) -> pa.Table:
        if not points.num_rows or not means.num_rows:
            return pa.schema([("key", pa.int64()), ("own", pa.float64()), ("size", pa.int64()), ("near", pa.float64())]).empty_table()
        means = means.sort_by("cluster")
        v, m = (t.column(c).combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t, c in ((points, "v"), (means, "m")))
        names, sizes, square = (means.column(c).to_numpy() for c in ("cluster", "size", "square"))
        cluster = points.column("cluster").to_numpy()
        at = np.minimum(np.searchsorted(names, cluster), len(names) - 1)
        own, near = np.where(names[at] == cluster, at, -1), np.full(len(v), np.inf)
        far = np.full(len(v), np.nan)
        for top in range(0, len(v), nearest.STRIP):
            x = v[top : top + nearest.STRIP]
            for left in range(0, len(m), nearest.ACROSS):
                d = (x * x).sum(axis=1)[:, None] + square[left : left + nearest.ACROSS] - 2 * x @ m[left : left + nearest.ACROSS].T
                place = own[top : top + len(x)] - left
                r = np.flatnonzero((place >= 0) & (place < d.shape[1]))
                far[top + r] = d[r, place[r]]
                d[r, place[r]] = np.inf
                near[top : top + len(x)] = np.minimum(near[top : top + len(x)], d.min(axis=1))
        return pa.table({"key": points.column("key"), "own": pa.array(far, from_pandas=True), "size": pa.array(np.where(own >= 0, sizes[at], 0)), "near": near})

    met = points.groupBy("p", "g").cogroup(others.groupBy("p", "g")).applyInArrow(run, "key long, own double, size long, near double")
    met = met.groupBy("key").agg(F.max("own").alias("own"), F.max("size").alias("size"), F.min("near").alias("b")) if groups > 1 else met.withColumnRenamed("near", "b")
    a, b = F.col("own") * F.col("size") / (F.col("size") - 1), F.col("b")
    return met.agg(F.avg(F.when((F.col("size") == 1) | (a == b), 0.0).when(a < b, 1 - a / b).otherwise(b / a - 1))).first()[0]


def density_sweep(points: DataFrame, key: str, vector: str, min_sizes: list[int], min_points: list[int], metric: str = "euclidean") -> DataFrame:
    """A row for each pair of parameters: min_cluster_size, min_samples, sizes of clusters and noise, silhouette of what is no noise
    (null with fewer than two clusters). Vectors are dealt and bounded once, and the forest of a min_points serves all sizes."""
    blocks = Blocks(points, key, vector, metric)
    spark = points.sparkSession
    bounds = blocks.bounds() if blocks.n else None
    lists = near_lists(blocks, bounds, max(min_points)) if blocks.n else None
    rows = []
    ready = points.select(F.col(key).cast("long").alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("v")) if blocks.n else None
    for k in min_points:
        forest = spanning_forest(blocks, bounds, core_distances(blocks, bounds, k, lists)) if blocks.n else spark.createDataFrame([], EDGE)
        for m in min_sizes:
            labelled = stored(_labelled(points, key, forest, m, 0.0), "sweep")
            real = labelled.where("cluster >= 0")
            clusters, score = real.select("cluster").distinct().count(), None
            if clusters > 1:
                score = silhouette(real.select(F.col(key).cast("long").alias("key"), "cluster").join(ready, "key"), clusters)
            rows.append(quality(labelled).select(F.lit(m).alias("min_cluster_size"), F.lit(k).alias("min_samples"), "*", F.lit(score).cast("double").alias("silhouette")))
    return reduce(DataFrame.unionByName, rows)
