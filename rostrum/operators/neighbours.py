"""Nearest neighbours of a query set or of all points, exact or by descent, and a spectral layout of the neighbour graph.

Points are distinct vectors scaled to length 1, named by the least key that has them; copies share a point, so large groups
of copies add no work. Vectors that are null, empty, zero or hold null or non-finite components, and null keys, are no
points. Only vectors of one length are compared. Keys are whole numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostrum.functions.vectors import norm, scaled
from rostrum.operators import nearest
from rostrum.operators.order import numbered
from rostrum.sources.store import scratch, stored

#: Most rows of a run that is compared whole, of a block of queries and of a block of points.
RUN, QUERIES, BLOCK = 512, 1 << 16, 1 << 16
#: Random directions that order the points at first; the most rounds of descent, and the share of changed edges that ends it.
DIRECTIONS, ROUNDS, SETTLED = 3, 12, 0.001
#: Edges of a part of the walk, both ways (about), parts at least for graphs of some size, and edges for which one more is made.
LINKS, PARTS, LEAST = 1 << 21, 4, 4096
#: Similarities are compared to so many decimals, so that the order of additions decides nothing.
DECIMALS = 12
EDGES = "key long, other long, sim double"


def valid(points: DataFrame, key: str, vector: str) -> DataFrame:
    """key, v: the rows whose vector has a direction, scaled to length 1."""
    rows = points.select(F.col(key).cast("long").alias("key"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"))
    rows = rows.where(F.col("key").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & (norm(F.col("v")) > 0))
    return rows.select("key", F.transform(scaled(F.col("v")), lambda x: x + 0.0).alias("v"))


def distinct_points(rows: DataFrame) -> DataFrame:
    """key, v from those of `valid`: one row for each vector, under its least key."""
    return rows.groupBy("v").agg(F.min("key").alias("key")).select("key", "v")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _best(key: np.ndarray, other: np.ndarray, sims: np.ndarray, k: int, above: np.ndarray | None = None) -> list[np.ndarray]:
    """key, other, sim of the k largest of each row, itself left out; of equals the lesser other. Only those over `above`."""
    sims = np.where(key[:, None] == other, -np.inf, np.round(sims, DECIMALS))
    if above is not None:
        sims[sims <= above[:, None]] = -np.inf
    order = np.lexsort((np.broadcast_to(other, sims.shape), -sims), axis=1)[:, :k]
    row = np.repeat(np.arange(len(key)), order.shape[1])
    found, at = sims[row, order.ravel()], order.ravel()
    real = found > -np.inf
    return [key[row[real]], other[at[real]], found[real]]


def _table(found: list[np.ndarray]) -> pa.Table:
    return pa.table(dict(zip(("key", "other", "sim"), found, strict=True)))


def _top(edges: DataFrame, k: int, out: str = "rank") -> DataFrame:
    """The k nearest of each key with their rank; sorted out before the shuffle too. Of equals that of the lesser hash, so
    that no point is everyone's neighbour."""
    order = W.partitionBy("key").orderBy(F.col("sim").desc(), F.xxhash64("key", "other"), "other")
    return edges.withColumn(out, F.row_number().over(order)).where(F.col(out) <= k)


def _along(t: int) -> Column:
    """How far v reaches in the t-th random direction."""
    return F.aggregate(F.transform("v", lambda x, i: x * (F.pmod(F.xxhash64(i, F.lit(t)), F.lit(2001)) - 1000)), F.lit(0.0), lambda s, x: s + x)


def _first_graph(points: DataFrame, k: int) -> DataFrame:
    """Along each random direction the points are ordered and cut into runs of like size, whose rows are compared."""
    sizes = points.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("points")).withColumn("runs", F.ceil(F.col("points") / RUN))
    found = None
    for t in range(DIRECTIONS):
        placed = numbered(points.select("key", "v", F.size("v").alias("size"), _along(t).alias("along")), ["along", "key"], ["size"])
        runs = placed.join(sizes, "size").withColumn("run", F.floor(F.col("n") * F.col("runs") / F.col("points")))
        near = runs.select("size", "run", "key", "v").groupBy("size", "run").applyInArrow(_within(k), EDGES)
        found = near if found is None else found.unionByName(near)
    return found.groupBy("key", "other").agg(F.max("sim").alias("sim"))


def _within(k: int):
    def run(table: pa.Table) -> pa.Table:
        keys, v = table.column("key").to_numpy(), _matrix(table.column("v"))
        return _table(_best(keys, keys, v @ v.T, k))

    return run


def _meet(k: int):
    """Rows sorted by centre: those of one centre meet, and each learns of the others that beat its worst neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            centre = table.column("centre").to_numpy()
            cuts = np.flatnonzero(np.diff(centre)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            yield from _met(table.slice(0, last), cuts[:-1], k)
            rest = table.slice(last)
        if rest is not None:
            yield from _met(rest, np.zeros(0, np.int64), k)

    return run


def _met(table: pa.Table, cuts: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    if not len(table):
        return
    member, worst, v = table.column("member").to_numpy(), table.column("worst").to_numpy(), _matrix(table.column("v"))
    found = [[], [], []]
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(member)], strict=True):
        for into, part in zip(found, _best(member[a:b], member[a:b], v[a:b] @ v[a:b].T, k, worst[a:b]), strict=True):
            into.append(part)
    yield from _table([np.concatenate(x) for x in found]).combine_chunks().to_batches()


def neighbour_graph(points: DataFrame, k: int = 10, pool: int | None = None) -> DataFrame:
    """key, other, sim, rank: the k nearest points by cosine of each point (`distinct_points`), of equals the lesser key.

    Without a pool they are exact: blocks of points meet all blocks, so a point travels once per block and not with every
    list it is in. With one they are (nearly) the nearest, by descent: runs along random directions give a first graph; in
    each round a point's neighbours, at most as many of those that it is a neighbour of, and itself are compared with each
    other, and everyone keeps its best `pool`, until fewer than SETTLED of the edges change. That saves comparisons on
    very many points that lie in groups, and finds less where they don't."""
    with scratch(points.sparkSession):
        found = exact_neighbours(points, points, k) if pool is None else _top(_descended(points, max(pool, k)), k)
        return stored(found, "neighbours", outlives=True)


def _descended(points: DataFrame, pool: int) -> DataFrame:
    points = stored(points, "points")
    graph = stored(_top(_first_graph(points, pool), pool).drop("rank"), "neighbours")
    for step in range(ROUNDS):
        worst = graph.groupBy("key").agg(F.when(F.count("*") >= pool, F.min("sim")).otherwise(-2.0).alias("worst"))
        known = points.join(worst, "key").select(F.col("key").alias("member"), "v", "worst")
        drawn = W.partitionBy("centre").orderBy(F.xxhash64("centre", "member", F.lit(step)), "member")
        back = graph.select(F.col("other").alias("centre"), F.col("key").alias("member")).withColumn("r", F.row_number().over(drawn)).where(F.col("r") <= pool).drop("r")
        ahead = graph.select(F.col("key").alias("centre"), F.col("other").alias("member"))
        own = points.select(F.col("key").alias("centre"), F.col("key").alias("member"))
        lists = ahead.unionByName(back).unionByName(own).distinct().join(known, "member").select("centre", "member", "worst", "v")
        met = lists.repartition("centre").sortWithinPartitions("centre").mapInArrow(_meet(pool), EDGES)
        both = graph.withColumn("old", F.lit(True)).unionByName(met.withColumn("old", F.lit(False)))
        new = stored(_top(both.groupBy("key", "other").agg(F.max("sim").alias("sim"), F.max("old").alias("old")), pool).drop("rank"), "neighbours")
        counts = new.agg(F.count_if(~F.col("old")).alias("changed"), F.count("*").alias("edges")).first()
        graph = new.drop("old")
        if counts["changed"] <= SETTLED * counts["edges"]:
            break
    return graph


def exact_neighbours(points: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """key, other, sim, rank: the k nearest points (key, v) of each query (key, v), a row of its own key left out; of equals
    the lesser key. Blocks of queries meet blocks of points, and only a query's best of a block travel on. Where all points
    are queries, a task has two blocks and looks both ways, so that a point travels once for each block."""
    every = queries is points
    points = stored(points.withColumn("size", F.size("v")), "points")
    queries = points if every else stored(queries.withColumn("size", F.size("v")), "queries")
    found = lambda rows: dict(rows.groupBy("size").count().collect())  # a row for each length of vectors
    p, q = found(points), found(queries)
    sizes = points.sparkSession.createDataFrame([(n, nearest.parts(p[n], BLOCK), nearest.parts(q[n], BLOCK if every else QUERIES)) for n in p if n in q], "size int, p long, q long")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("key"), F.col(n))
    columns = ["size", "pb", "qb", "asks", "key", "v"]
    two = points.join(F.broadcast(sizes), "size").withColumn("own", mine("p")).withColumn("to", upto("p"))
    two = two.withColumn("pb", F.least("own", "to")).withColumn("qb", F.greatest("own", "to")).withColumn("asks", F.col("own") == F.col("qb")).select(*columns)
    base = points.join(F.broadcast(sizes), "size").withColumn("pb", mine("p")).withColumn("qb", upto("q")).withColumn("asks", F.lit(False)).select(*columns)
    asks = queries.join(F.broadcast(sizes), "size").withColumn("qb", mine("q")).withColumn("pb", upto("p")).withColumn("asks", F.lit(True)).select(*columns)

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        keys, v = table.column("key").to_numpy(), _matrix(table.column("v"))
        cost = lambda a, b: -np.round((a * b).sum(axis=1), DECIMALS)
        ways = [(asks, ~asks)] if not every else [(asks, asks)] if table.column("pb")[0] == table.column("qb")[0] else [(asks, ~asks), (~asks, asks)]
        found = [(key, other, -far) for a, b in ways for key, other, far in nearest.nearest(keys[a], v[a], keys[b], v[b], k, cost, False, False)]
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return _table([np.concatenate(x) for x in zip(none, *found, strict=True)])

    near = (two if every else base.unionByName(asks)).groupBy("size", "pb", "qb").applyInArrow(run, EDGES)
    order = W.partitionBy("key").orderBy(F.col("sim").desc(), "other")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall(graph: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: pairs of the exact result, and the share of them that the graph has."""
    hits = exact.select("key", "other").join(graph.select("key", "other", F.lit(1).alias("hit")), ["key", "other"], "left")
    return hits.agg(F.count("*").alias("pairs"), (F.count("hit") / F.count("*")).alias("recall"))


def _packed(x: np.ndarray, kind: type) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _columns(body: bytes, points: int) -> np.ndarray:
    return np.frombuffer(body, np.float64).reshape(points, -1)


ROUTES, SENT = pa.list_(pa.struct([("to", pa.int32()), ("places", pa.binary())])), pa.schema([("part", pa.int32()), ("frm", pa.int32()), ("body", pa.binary())])
STATE = pa.schema([("part", pa.int32()), ("keys", pa.list_(pa.int64())), ("routes", ROUTES), ("body", pa.binary())])
SENT_SQL, STATE_SQL = "part int, frm int, body binary", "part int, keys array<long>, routes array<struct<to:int,places:binary>>, body binary"


class Walk:
    """The lazy random walk over a graph (key, other, sim > 0), scaled by the roots of degrees. Points are dealt into parts. The
    edges of a part stay where they are, persisted by part (until `close`) and made anew from a stored table if lost; a
    step moves values only, each once to every other part that needs it, not along every edge.

    A row of a state is a part: its keys in order, which of its points other parts need, and the points' columns, packed;
    the first is the root of the degree."""

    def __init__(self, pairs: DataFrame):
        edges = pairs.count()
        parts = max(-(-2 * edges // LINKS), min(PARTS, -(-edges // LEAST)), 1)
        of = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int").alias
        ways = pairs.unionByName(pairs.select(F.col("other").alias("key"), F.col("key").alias("other"), "sim"))

        def gathered(table: pa.Table) -> pa.Table:
            """A part's points and edges; needs: the points of each part at the other ends; src: an end's place among all these."""
            key, other, w, to = (table.column(c).to_numpy() for c in ("key", "other", "sim", "to"))
            order = np.lexsort((-w, other, key))  # of both directions the greater similarity
            order = order[np.r_[True, (np.diff(key[order]) != 0) | (np.diff(other[order]) != 0)]]
            key, other, w, to = (x[order] for x in (key, other, w, to))
            keys, starts = np.unique(key, return_index=True)
            own, needs, src, at = table.column("part")[0].as_py(), [], np.zeros(len(key), np.int32), 0
            for part in np.union1d(to, [own]).tolist():
                here = to == part
                names = keys if part == own else np.unique(other[here])
                src[here] = at + np.searchsorted(names, other[here])
                needs.append({"to": part, "places": _packed(names, np.int64)})
                at += len(names)
            packed = {"root": _packed(np.sqrt(np.add.reduceat(w, starts)), np.float64), "starts": _packed(starts, np.int64), "src": _packed(src, np.int32), "w": _packed(w, np.float64)}
            return pa.table({"part": pa.array([own], pa.int32()), "keys": [keys], **{c: pa.array([x], pa.binary()) for c, x in packed.items()}, "needs": pa.array([needs], ROUTES), "total": [float(w.sum())]})

        def routed(own: pa.Table, asked: pa.Table) -> pa.Table:
            keys = own.column("keys").combine_chunks().flatten().to_numpy()
            found = [{"to": r["part"], "places": _packed(np.searchsorted(keys, np.frombuffer(r["places"], np.int64)), np.int32)} for r in asked.to_pylist()]
            return pa.table({"part": own.column("part"), "routes": pa.array([sorted(found, key=lambda r: r["to"])], ROUTES)})

        schema = "part int, keys array<long>, root binary, starts binary, src binary, w binary, needs array<struct<to:int,places:binary>>, total double"
        rows = stored(ways.select(of("key")("part"), of("other")("to"), "key", "other", "sim").groupBy("part").applyInArrow(gathered, schema), "walk")
        asked = rows.select("part", F.explode("needs").alias("need")).select("part", "need.*")
        routes = rows.select("part", "keys").groupBy("part").cogroup(asked.groupBy("to")).applyInArrow(routed, "part int, routes array<struct<to:int,places:binary>>")
        whole = stored(rows.drop("needs").join(routes, "part"), "walk")
        self.total = whole.agg(F.sum("total")).first()[0]
        self.start = whole.select("part", "keys", "routes", "root")
        self.edges = whole.drop("total").repartition(parts, "part").persist()

    def close(self) -> None:
        self.edges.unpersist()

    def begun(self, columns: list[Column], zeros: int) -> DataFrame:
        """The state with root, zeros and given columns (arrays over the points)."""
        names = [f"_{i}" for i in range(len(columns))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, row in enumerate(batch.select(["part", "keys", "routes", "root"]).to_pylist()):
                    drawn = [batch.column(c)[i].values.to_numpy() for c in names]
                    body = np.column_stack([np.frombuffer(row["root"], np.float64), np.zeros((len(row["keys"]), zeros)), *drawn])
                    yield pa.RecordBatch.from_pylist([{**row, "body": _packed(body, np.float64)}], STATE)

        return stored(self.start.select("*", *[c.alias(n) for c, n in zip(columns, names, strict=True)]).mapInArrow(run, STATE_SQL), "columns")

    def moved(self, state: DataFrame, weights: np.ndarray, q: int, steps: int) -> DataFrame:
        """The state with columns mixed by weights, then the images of the last q by one, two, ... steps."""

        def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    yield from sent(row, _columns(row["body"], len(row["keys"])) @ weights)

        def sent(row: dict, columns: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Its own columns to the part itself, the last q of those points that another part needs to that part."""
            for r in row["routes"]:
                body = columns if r["to"] == row["part"] else (columns[:, -q:] / columns[:, :1])[np.frombuffer(r["places"], np.int32)]
                yield pa.RecordBatch.from_pylist([{"part": r["to"], "frm": row["part"], "body": _packed(body, np.float64)}], SENT)

        def stepped(last: bool):
            def run(own: pa.Table, came: pa.Table) -> pa.Table:
                (row,) = own.to_pylist()
                bodies = {r["frm"]: r["body"] for r in came.to_pylist()}
                w, src, starts, root = (np.frombuffer(row[c], t) for c, t in (("w", np.float64), ("src", np.int32), ("starts", np.int64), ("root", np.float64)))
                mine = _columns(bodies[row["part"]], len(root))
                x = np.concatenate([mine[:, -q:] / root[:, None] if frm == row["part"] else np.frombuffer(bodies[frm], np.float64).reshape(-1, q) for frm in sorted(bodies)])
                near = np.column_stack([np.add.reduceat(w * x[src, i], starts) for i in range(q)]) / root[:, None]
                columns = np.hstack([mine, (mine[:, -q:] + near) / 2])
                return pa.Table.from_pylist([{**row, "body": _packed(columns, np.float64)}], STATE) if last else pa.Table.from_batches(list(sent(row, columns)))

            return run

        rows = state.mapInArrow(mixed, SENT_SQL)
        for step in range(steps):
            last = step + 1 == steps
            rows = self.edges.groupBy("part").cogroup(rows.groupBy("part")).applyInArrow(stepped(last), STATE_SQL if last else SENT_SQL)
        return stored(rows, "columns")


def _products(width: int):
    """at, s: sums of products of all pairs of columns over a task's points, by place in the square."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((width, width))
        for batch in batches:
            for body in batch.column("body"):
                x = np.frombuffer(body.as_buffer(), np.float64).reshape(-1, width)
                sums += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], ["at", "s"])

    return run


def _ritz(bb: np.ndarray, bm: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """The q largest eigenvalues within the span of a basis, and the weights of their vectors, from its products with
    itself (bb) and with its images (bm). A basis of lower rank gives fewer, filled up with zeros."""
    norms = np.sqrt(np.maximum(np.diag(bb), 0))
    unit = np.where(norms > 0, 1 / np.where(norms > 0, norms, 1), 0)
    size, base = np.linalg.eigh(bb * unit[:, None] * unit)
    real = size > 1e-11 * max(size.max(), 1e-300)
    base = unit[:, None] * base[:, real] / np.sqrt(size[real])
    found, turn = np.linalg.eigh(base.T @ ((bm + bm.T) / 2) @ base)
    turn, found = (base @ turn)[:, ::-1][:, :q], found[::-1][:q]
    return np.r_[found, np.zeros(q - len(found))], np.hstack([turn, np.zeros((len(bb), q - turn.shape[1]))])


def spectral_layout(graph: DataFrame, dims: int = 2, tolerance: float = 1e-3, rounds: int = 30) -> tuple[DataFrame, list[float]]:
    """key and place (array of dims coordinates) for each point of a graph (key, other, sim), and the eigenvalues found.

    The graph counts in both directions, negative similarities as none. Coordinates are the eigenvectors that follow the
    trivial one of the lazy random walk. Power iteration on Spark: in a round a few columns are multiplied by the walk
    three times; of the span of all powers and of the last step, the leading vectors go on. Only sums of products, as
    many as the columns squared, reach the driver. It ends when what is left over is within the tolerance. Parts of the
    graph without a link come apart; points without a positive weight stay at the origin. Each coordinate's mean square,
    by degree, is 1 (0 if the graph has too few points for it), and its farthest point is on the positive side."""
    q = dims + 2
    nodes = graph.select("key").union(graph.select("other")).distinct()
    walk = Walk(graph.where("sim > 0").select("key", "other", "sim"))
    try:
        if not walk.total:
            return nodes.select("key", F.array([F.lit(0.0)] * dims).alias("place")), []
        # p: the last step, m: its image; x: the vectors so far, then their images by one, two and three steps of the walk.
        every = ["root", *[c for c in "pmxyzw" for _ in range(q)]]
        at = lambda *cs: [i for c in cs for i, n in enumerate(every) if n == c]
        basis, image = at("p", "x", "y", "z"), at("m", "y", "z", "w")

        def products(state: DataFrame, width: int) -> np.ndarray:
            found = state.select("body").mapInArrow(_products(width), "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
            return np.array([s for _, s in sorted(map(tuple, found))]).reshape(width, width)

        drawn = lambda i: F.transform("keys", lambda k: F.pmod(F.xxhash64(k, F.lit(i)), F.lit(2_000_001)) / 1e6 - 1)
        state = walk.begun([drawn(i) for i in range(q)], 2 * q)
        weights = np.eye(1 + 3 * q)
        weights[0, at("x")] = -products(state, 1 + 3 * q)[0, at("x")] / walk.total
        for _ in range(rounds):
            state = walk.moved(state, weights, q, 3)
            sums = products(state, len(every))
            values, turn = _ritz(sums[np.ix_(basis, basis)], sums[np.ix_(basis, image)], q)
            left = np.einsum("ij,ik,kj->j", turn, sums[np.ix_(image, image)], turn) - values**2
            weights = np.zeros((len(every), 1 + 3 * q))
            weights[0, 0] = 1
            weights[np.ix_(basis, at("x"))] = turn
            weights[0, at("x")] = -(sums[0, basis] @ turn) / walk.total  # what rounding adds of the trivial vector
            step = np.vstack([turn[:q], np.zeros((q, q)), turn[2 * q :]])
            weights[np.ix_(basis, at("p"))], weights[np.ix_(image, at("m"))] = step, step
            if np.sqrt(np.maximum(left[:dims], 0)).max(initial=0) <= tolerance:
                break
    finally:
        walk.close()
    xs = [f"x{i}" for i in range(dims)]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, body in zip(batch.column("keys"), batch.column("body"), strict=True):
                x = _columns(body.as_buffer(), len(keys)) @ weights
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(x[:, 0] ** 2), *[pa.array(x[:, 1 + 2 * q + i] / x[:, 0]) for i in range(dims)]], ["key", "d", *xs])

    places = stored(state.mapInArrow(placed, ", ".join(["key long", "d double", *[f"{x} double" for x in xs]])), "places")
    ends = places.agg(*[F.max_by(x, F.struct(F.abs(x), "key")).alias(x) for x in xs], *[F.sqrt(F.sum(F.col("d") * F.col(x) * F.col(x)) / walk.total).alias(f"s{x}") for x in xs]).first()
    unit = [F.col(x) * (float(np.sign(ends[x])) / ends[f"s{x}"] if ends[f"s{x}"] > 1e-9 else 0.0) for x in xs]
    found = nodes.join(places.select("key", F.array(*unit).alias("place")), "key", "left")
    return found.select("key", F.coalesce("place", F.array([F.lit(0.0)] * dims)).alias("place")), values[:dims].tolist()


def neighbour_layout(points: DataFrame, key: str, vector: str, k: int = 10, dims: int = 2) -> DataFrame:
    """key, place for each row of points with a direction: the layout of its point; a point that has no neighbour is at
    the origin."""
    rows = stored(valid(points, key, vector), "rows")
    single = stored(distinct_points(rows), "points")
    places, _ = spectral_layout(stored(neighbour_graph(single, k), "graph"), dims)
    at = single.join(places, "key", "left").select("v", F.coalesce("place", F.array([F.lit(0.0)] * dims)).alias("place"))
    return rows.join(at, "v").select(F.col("key").alias(key), "place")
