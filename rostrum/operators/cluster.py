"""Clustering on Spark: connected components, density clustering, alignment of clusters over periods, quality."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostrum.functions.vectors import cosine, mean_vectors, scaled
from rostrum.sources.store import stored


#: Vectors of a block, and those of them that are compared at a time.
BLOCK, STRIP = 2048, 256


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: every node of an edge and the least node it can reach. Each round gives a node the least root of its
    neighbours, then follows that root once more, until nothing changes."""
    both = stored(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct())
    roots = stored(both.groupBy(F.col("x").alias("node")).agg(F.min(F.least("x", "y")).alias("root")))
    while True:
        near = both.join(roots.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("near"))
        new = roots.join(near, "node").select("node", "root", F.least("root", "near").alias("new"))
        hop = roots.select(F.col("node").alias("new"), F.col("root").alias("hop"))
        new = stored(new.join(hop, "new", "left").select("node", F.col("root").alias("old"), F.least("new", F.coalesce("hop", "new")).alias("root")))
        changed = new.where("old <> root").limit(1).count()
        roots = new.select("node", "root")
        if not changed:
            return roots


def dbscan(points: DataFrame, key: str, vector: str, eps: float = 0.3, min_points: int = 3, groups: list[str] | None = None) -> DataFrame:
    """groups, key, cluster: density clusters by cosine distance within each group; the cluster is its least core key, -1
    for noise. A border point joins the least core it is near to.

    A group's vectors are dealt into blocks, and a task compares two blocks at a time, first to count neighbours, then to
    join cores into chains and to find border points' cores; pairs are never listed, and no task holds a group."""
    groups = groups or []
    unit = points.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(*groups, key, scaled(F.col(vector)).alias("v")).withColumn("size", F.size("v"))
    unit = stored(unit.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))))
    sizes = unit.groupBy(*groups, "size").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = unit.join(sizes, [*groups, "size"]).withColumn("b", F.pmod(F.xxhash64(key), F.col("blocks")))
    met = dealt.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select(*groups, key, "v", "size", F.least("b", "x").alias("i"), F.greatest("b", "x").alias("j"), (F.col("b") > F.col("x")).alias("second"))
    kept = [f"{c} {points.schema[c].dataType.simpleString()}" for c in [*groups, key]]
    together = [*groups, "size", "i", "j"]
    near = met.groupBy(*together).applyInArrow(_neighbours(groups, key, eps), ", ".join([*kept, "n long"]))
    core = stored(near.groupBy(*groups, key).agg(F.sum("n").alias("n")).where(F.col("n") >= min_points).select(*groups, key, F.lit(True).alias("core")))
    marked = met.join(core, [*groups, key], "left").withColumn("core", F.coalesce("core", F.lit(False)))
    to = f"other {points.schema[key].dataType.simpleString()}"
    links = stored(marked.groupBy(*together).applyInArrow(_chains(groups, key, eps), ", ".join([*kept, to, "border boolean"])))
    node = lambda c: F.struct(*groups, F.col(c).alias("k"))
    roots = connected_components(links.where("not border").select(node(key).alias("a"), node("other").alias("b")))
    placed = roots.select(*[F.col(f"node.{g}").alias(g) for g in groups], F.col("node.k").alias("other"), F.col("root.k").alias("cluster"))
    border = links.where("border").groupBy(*groups, key).agg(F.min("other").alias("other"))
    found = placed.withColumnRenamed("other", key).unionByName(border.join(placed, [*groups, "other"]).select(*groups, key, "cluster"))
    return points.select(*groups, key).join(found, [*groups, key], "left").select(*groups, key, F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def _blocks(table: pa.Table, key: str) -> tuple[pa.Table, pa.Table, np.ndarray, np.ndarray]:
    """The rows of both blocks by key, and their vectors; a block that meets itself comes twice."""
    table = table.sort_by(key)
    second = table.column("second").to_numpy()
    one = table.filter(pa.array(~second))
    two = table.filter(pa.array(second)) if second.any() else one
    if table.column("i")[0].as_py() != table.column("j")[0].as_py():
        two = table.filter(pa.array(second))
    vectors = [t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t in (one, two)]
    return one, two, *vectors


def _out(table: pa.Table, columns: list[str], picked: np.ndarray, **more) -> pa.Table:
    out = table.select(columns).take(pa.array(picked))
    for name, values in more.items():
        out = out.append_column(name, values if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values))
    return out


def _strips(n: int):
    return (slice(at, at + STRIP) for at in range(0, n, STRIP))


def _neighbours(groups: list[str], key: str, eps: float):
    def run(table: pa.Table) -> pa.Table:
        one, two, a, b = _blocks(table, key)
        n_a, n_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        for s in _strips(len(a)):
            near = a[s] @ b.T >= 1 - eps
            n_a[s] = near.sum(axis=1)
            n_b += near.sum(axis=0)
        out = _out(one, [*groups, key], np.flatnonzero(n_a), n=n_a[n_a > 0])
        return out if one is two else pa.concat_tables([out, _out(two, [*groups, key], np.flatnonzero(n_b), n=n_b[n_b > 0])])

    return run


def _chains(groups: list[str], key: str, eps: float):
    """For cores the least core key that chains within the two blocks reach; for other points the least core near to them."""

    def run(table: pa.Table) -> pa.Table:
        one, two, a, b = _blocks(table, key)
        near = np.zeros((len(a), len(b)), bool)
        for s in _strips(len(a)):
            near[s] = a[s] @ b.T >= 1 - eps
        core_a, core_b = (t.column("core").to_numpy() for t in (one, two))
        keys = pa.chunked_array([*one.column(key).chunks, *two.column(key).chunks])
        rank = np.empty(len(keys), np.int64)
        order = pc.sort_indices(keys).to_numpy()
        rank[order] = np.arange(len(keys))
        root_a, root_b = rank[: len(a)].copy(), rank[len(a) :].copy()
        x, y = np.nonzero(near & core_a[:, None] & core_b)
        first = np.flatnonzero(np.diff(x, prepend=-1))  # links come row by row
        own = x[first]
        while len(x):
            new_a, new_b = root_a.copy(), root_b.copy()
            new_a[own] = np.minimum(root_a[own], np.minimum.reduceat(root_b[y], first))
            np.minimum.at(new_b, y, new_a[x])
            if (new_a == root_a).all() and (new_b == root_b).all():
                break
            root_a, root_b = new_a, new_b
        made = []
        for t, own, near_, root, core, other in ((one, core_a, near, root_a, core_b, two), (two, core_b, near.T, root_b, core_a, one)):
            cores = np.flatnonzero(own)
            made.append(_out(t, [*groups, key], cores, other=keys.take(pa.array(order[root[cores]])), border=np.zeros(len(cores), bool)))
            border = np.flatnonzero(~own)
            close = near_[border] & core
            border, close = border[close.any(axis=1)], close[close.any(axis=1)]
            made.append(_out(t, [*groups, key], border, other=other.column(key).take(pa.array(close.argmax(axis=1) if len(border) else np.zeros(0, np.int64))), border=np.ones(len(border), bool)))
            if one is two:
                break
        return pa.concat_tables(made)

    return run


def largest(rows: DataFrame, keys: list[str], label: str, k: int) -> DataFrame:
    """Keeps the k largest clusters of each key, ties by label; the rest becomes -1."""
    counts = rows.where(F.col(label) >= 0).groupBy(*keys, label).agg(F.count("*").alias("n"))
    order = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(F.col("n").desc(), label)
    kept = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select(*keys, label, F.lit(True).alias("kept"))
    return rows.join(kept, [*keys, label], "left").withColumn(label, F.when(F.col("kept"), F.col(label)).otherwise(-1)).drop("kept")


def align(local: DataFrame, threshold: float = 0.7, cap: int = 50, first_cap: int = 30, words: list[str] | None = None) -> DataFrame:
    """local: words (columns that name a target word, if there are several), term, year, cluster, centroid, size. Returns
    those with global_id. For each word, period by period in order, larger clusters first, each takes the most similar known
    centre at or above the threshold, else a new id up to the cap, else -1. Words are folded apart from each other, each in
    a task of its own over its few centres a period."""
    words = words or []

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["term", "year", "size", "cluster"], ascending=[True, True, False, True])
        known, ids, period, limit = np.zeros((0, 0)), [], None, first_cap
        for term, year, centroid in zip(pdf["term"], pdf["year"], pdf["centroid"], strict=True):
            if period != (term, year):
                period, limit = (term, year), cap if len(known) else first_cap
            c = np.array(centroid, np.float64)
            c /= np.sqrt(c @ c) or 1.0
            sims = known @ c if len(known) else np.zeros(0)
            best = int(sims.argmax()) if len(sims) else -1
            if best < 0 or sims[best] < threshold:
                best = len(known) if len(known) < limit else -1
                if best >= 0:
                    known = np.vstack([known, c]) if len(known) else c[None]
            ids.append(best)
        return pdf.assign(global_id=np.array(ids, np.int32))

    columns = [*words, "term", "year", "cluster", "size", "centroid"]
    whole = ", ".join(f"`{c}` {local.schema[c].dataType.simpleString()}" for c in columns)
    return local.select(*columns).groupBy(*words or [F.lit(0).alias("__all")]).applyInPandas(fold, f"{whole}, global_id int")


def period_clusters(contexts: DataFrame, key: str, vector: str, eps: float, min_points: int, k: int, words: list[str] | None = None) -> DataFrame:
    """words, term, year, cluster, centroid, size of each word's and period's k largest density clusters. A key stands once
    for each word."""
    groups = [*(words or []), "term", "year"]
    labelled = dbscan(contexts, key, vector, eps, min_points, groups)
    kept = stored(largest(labelled, groups, "cluster", k).where("cluster >= 0").join(contexts.select(*groups, key, vector), [*groups, key]))
    sizes = kept.groupBy(*groups, "cluster").agg(F.count("*").alias("size"))
    return mean_vectors(kept, [*groups, "cluster"], vector).join(sizes, [*groups, "cluster"])


def kmeans(points: DataFrame, vector: str, k: int, seed: int = 42, min_size: int = 3) -> DataFrame:
    """Adds cluster; clusters under min_size become -1."""
    ready = points.withColumn("features", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(ready)
    labelled = model.transform(ready)
    sizes = labelled.groupBy("cluster").agg(F.count("*").alias("__n"))
    return labelled.join(sizes, "cluster").withColumn("cluster", F.when(F.col("__n") >= min_size, F.col("cluster")).otherwise(-1)).drop("__n")


def project(points: DataFrame, vector: str, dims: int = 2) -> DataFrame:
    """Adds `projection`, the first principal components."""
    ready = points.withColumn("__features", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    return PCA(k=dims, inputCol="__features", outputCol="__p").fit(ready).transform(ready).withColumn("projection", vector_to_array("__p")).drop("__features", "__p")


def quality(labelled: DataFrame) -> DataFrame:
    """One row: clusters, outliers, outlier_pct, average, least and greatest size. Needs only the column cluster."""
    sizes = labelled.groupBy("cluster").agg(F.count("*").alias("n"))
    real = F.col("cluster") >= 0
    return sizes.agg(
        F.count_if(real).alias("clusters"), F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).alias("outliers"), F.round(F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)) * 100.0 / F.sum("n"), 1).alias("outlier_pct"),
        F.round(F.avg(F.when(real, F.col("n"))), 1).alias("avg_size"), F.min(F.when(real, F.col("n"))).alias("min_size"), F.max(F.when(real, F.col("n"))).alias("max_size"),
    )


def sweep(points: DataFrame, vector: str, ks: list[int]) -> DataFrame:
    """quality, silhouette and a balanced score (0.4, 0.4, 0.2) for each k, best first."""
    rows = []
    for k in ks:
        labelled = stored(kmeans(points, vector, k))
        real = labelled.where("cluster >= 0")
        several = real.select("cluster").distinct().count() > 1
        silhouette = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(real) if several else 0.0
        rows.append(quality(labelled).select(F.lit(k).alias("k"), "*", F.lit(float(silhouette)).alias("silhouette")))
    table = reduce(DataFrame.unionByName, rows)
    score = 0.4 * F.col("silhouette") + 0.4 * (1 - F.col("outlier_pct") / 100) + 0.2 * F.least(F.col("clusters") / 100.0, F.lit(1.0))
    return table.withColumn("score", score).orderBy(F.col("score").desc(), "k")


def same_direction(a: str, b: str):
    return cosine(F.col(a), F.col(b))
