"""Neighbour graph and layout of vectors (M8), with the nearest of the query set in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.operators import neighbours
from rostrum.plans.registry import query
from rostrum.sources.fixtures import table
from rostrum.sources.store import stored

#: Neighbours of a point; every so manieth id is a query of the searches.
K, EVERY = 10, 50

NEAR_SQL = f"""v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
{{points}} near AS (SELECT q.vec_id, p.vec_id AS other, round(list_cosine_similarity(q.e, p.e), 12) AS sim FROM {{of}} q JOIN {{of}} p ON p.vec_id <> q.vec_id WHERE q.vec_id % {EVERY} = 0),
best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, other) AS rank FROM near)"""


@query("M8_exact_neighbours", "WITH " + NEAR_SQL.format(points="", of="v") + f" SELECT vec_id, other, round(sim, 6) AS sim, rank FROM best WHERE rank <= {K}")
def m8_exact(spark, d):
    """The nearest rows of every query row, over all rows."""
    rows = neighbours.valid(table(spark, d, "embeddings"), "vec_id", "embedding")
    found = neighbours.exact_neighbours(rows, rows.where(F.col("key") % EVERY == 0), K)
    return found.select(F.col("key").alias("vec_id"), "other", F.round("sim", 6).alias("sim"), "rank")


def graph_of(spark, d):
    points = stored(neighbours.distinct_points(neighbours.valid(table(spark, d, "embeddings"), "vec_id", "embedding")), "points")
    return points, neighbours.neighbour_graph(points, K)


@query("M8_neighbour_graph")
def m8_graph(spark, d):
    """The neighbour graph of all vectors, by descent."""
    return graph_of(spark, d)[1].select(F.col("key").alias("vec_id"), "other", F.round("sim", 6).alias("sim"), "rank")


@query("M8_neighbour_recall", "WITH " + NEAR_SQL.format(points="one AS (SELECT min(vec_id) AS vec_id, e FROM v GROUP BY e),", of="one") + f" SELECT count(*) AS pairs, true AS enough FROM best WHERE rank <= {K}")
def m8_recall(spark, d):
    """Whether the graph holds nine tenths of the true neighbours of the query points."""
    points, graph = graph_of(spark, d)
    exact = neighbours.exact_neighbours(points, points.where(F.col("key") % EVERY == 0), K)
    return neighbours.recall(graph, exact).select("pairs", (F.col("recall") >= 0.9).alias("enough"))


@query("M8_neighbour_layout")
def m8_layout(spark, d):
    """Two coordinates of each vector from the walk over the neighbour graph."""
    placed = neighbours.neighbour_layout(table(spark, d, "embeddings"), "vec_id", "embedding", K)
    return placed.select("vec_id", F.get("place", F.lit(0)).alias("x"), F.get("place", F.lit(1)).alias("y"))
