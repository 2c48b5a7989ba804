"""Hierarchical density clusters and their sweep (M5, M9), with the hierarchy in recursive SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.operators import hierarchy
from rostrum.plans.registry import query
from rostrum.sources.fixtures import table

NEAR_SQL = """v AS (SELECT vec_id AS k, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
near AS MATERIALIZED (SELECT x.k AS a, y.k AS b, round(sqrt(list_sum(list_transform(range(1, len(x.e) + 1), lambda i: (x.e[i] - y.e[i]) * (x.e[i] - y.e[i])))), 9) AS d FROM v x CROSS JOIN v y)"""


def forest_sql(points: int) -> str:
    """Views up to forest{points} (a, b, d): a tree grown from the least key, nearest first."""
    s = points
    return f"""core{s} AS (SELECT a, d AS core FROM (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d) AS r FROM near) WHERE r = {points}),
reach{s} AS MATERIALIZED (SELECT n.a, n.b, greatest(n.d, x.core, y.core) AS d FROM near n JOIN core{s} x ON x.a = n.a JOIN core{s} y ON y.a = n.b WHERE n.a <> n.b),
grown{s} AS (SELECT 0 AS step, b AS k, a AS frm, d FROM reach{s} WHERE a = (SELECT min(k) FROM v) UNION ALL
SELECT step + 1, g.k, CASE WHEN (r.d, least(g.k, g.at), greatest(g.k, g.at)) < (g.d, least(g.k, g.frm), greatest(g.k, g.frm)) THEN g.at ELSE g.frm END, least(g.d, r.d)
FROM (SELECT *, first_value(k) OVER (ORDER BY d, least(k, frm), greatest(k, frm)) AS at FROM grown{s}) g JOIN reach{s} r ON r.a = g.at AND r.b = g.k),
forest{s} AS MATERIALIZED (SELECT least(k, frm) AS a, greatest(k, frm) AS b, d FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY d, least(k, frm), greatest(k, frm)) AS r FROM grown{s}) WHERE r = 1),
m{s} AS MATERIALIZED (SELECT row_number() OVER (ORDER BY d, a, b) - 1 AS no, a, b, d FROM forest{s}),
state{s} AS MATERIALIZED (SELECT CAST(-1 AS BIGINT) AS no, k, k AS comp FROM v UNION ALL
SELECT no + 1, k, CASE WHEN comp = greatest(ca, cb) THEN least(ca, cb) ELSE comp END FROM (SELECT s.no, s.k, s.comp, max(s.comp) FILTER (s.k = m.a) OVER () AS ca, max(s.comp) FILTER (s.k = m.b) OVER () AS cb FROM state{s} s JOIN m{s} m ON m.no = s.no + 1))"""


def labels_sql(points: int, size: int) -> str:
    """Views up to label{points}_{size} (k, cluster) after those of forest_sql: the cluster open in a component is the last
    one born in it; scores go up from the leaves; members are read where a cluster meets its rival."""
    s, p = f"{points}_{size}", points
    return f"""sizes{s} AS (SELECT no, comp, count(*) AS n FROM state{p} GROUP BY 1, 2),
merge{s} AS MATERIALIZED (SELECT m.*, x.comp AS ca, y.comp AS cb, u.n AS na, w.n AS nb FROM m{p} m JOIN state{p} x ON x.no = m.no - 1 AND x.k = m.a JOIN state{p} y ON y.no = m.no - 1 AND y.k = m.b
JOIN sizes{s} u ON u.no = m.no - 1 AND u.comp = x.comp JOIN sizes{s} w ON w.no = m.no - 1 AND w.comp = y.comp),
born{s} AS (SELECT no AS cluster, a, d, na + nb AS n FROM merge{s} WHERE (na < {size} AND nb < {size} AND na + nb >= {size}) OR (na >= {size} AND nb >= {size})),
ends{s} AS (SELECT no, d, ca AS comp, na AS n, nb AS other FROM merge{s} UNION ALL SELECT no, d, cb, nb, na FROM merge{s}),
held{s} AS MATERIALIZED (SELECT e.no, e.comp, e.d, e.n, e.other, max(b.cluster) AS cluster FROM ends{s} e JOIN born{s} b ON b.cluster < e.no JOIN state{p} x ON x.no = e.no - 1 AND x.k = b.a AND x.comp = e.comp WHERE e.n >= {size} GROUP BY ALL),
mass{s} AS (SELECT cluster, sum(n * (1e0 / greatest(d, 1e-12))) AS mass FROM (SELECT cluster, n, d FROM born{s} UNION ALL SELECT cluster, other, d FROM held{s} WHERE other < {size}) GROUP BY 1),
closed{s} AS (SELECT h.cluster, h.no AS parent, round(mass - n * (1e0 / greatest(d, 1e-12)), 9) AS excess, row_number() OVER (ORDER BY h.cluster) AS r FROM held{s} h JOIN mass{s} USING (cluster) WHERE other >= {size}),
parted{s} AS (SELECT c.r, any_value(c.excess) AS excess, list(k.r ORDER BY k.r) FILTER (k.r IS NOT NULL) AS kids FROM closed{s} c LEFT JOIN closed{s} k ON k.parent = c.cluster GROUP BY 1),
score{s} AS (SELECT CAST(0 AS BIGINT) AS r, CAST([] AS DOUBLE[]) AS scores, CAST([] AS BOOLEAN[]) AS won UNION ALL
SELECT r, list_append(scores, greatest(excess, parts)), list_append(won, excess >= round(parts, 9)) FROM (SELECT c.r, q.scores, q.won, c.excess, coalesce(list_sum(list_transform(c.kids, lambda i: q.scores[i])), 0e0) AS parts FROM score{s} q JOIN parted{s} c ON c.r = q.r + 1)),
winner{s} AS (SELECT cluster, parent, won[c.r] AS won FROM closed{s} c, (SELECT arg_max(won, r) AS won FROM score{s})),
climb{s} AS (SELECT cluster AS first, cluster, parent, won, 0 AS up FROM winner{s} UNION ALL SELECT c.first, w.cluster, w.parent, w.won, up + 1 FROM climb{s} c JOIN winner{s} w ON w.cluster = c.parent),
pick{s} AS (SELECT DISTINCT arg_max({{'cluster': cluster, 'parent': parent}}, up) FILTER (won) OVER (PARTITION BY first) AS p FROM climb{s}),
member{s} AS (SELECT p.p.cluster AS cluster, x.k FROM pick{s} p JOIN born{s} b ON b.cluster = p.p.cluster JOIN state{p} own ON own.no = p.p.parent - 1 AND own.k = b.a JOIN state{p} x ON x.no = own.no AND x.comp = own.comp),
label{s} AS (SELECT v.k, coalesce(min(m.k) OVER (PARTITION BY m.cluster), -1) AS cluster FROM v LEFT JOIN member{s} m ON m.k = v.k WHERE m.k IS NOT NULL UNION ALL SELECT k, -1 FROM v WHERE k NOT IN (SELECT k FROM member{s}))"""


@query("M5_density_hierarchy", f"WITH RECURSIVE {NEAR_SQL},\n{forest_sql(3)},\n{labels_sql(3, 4)}\nSELECT k AS vec_id, cluster FROM label3_4")
def m5_hierarchy(spark, d):
    """Clusters of any density over all vectors, by excess of mass."""
    return hierarchy.density_hierarchy(table(spark, d, "embeddings"), "vec_id", "embedding", 4, 3)


@query("M5_spanning_forest", f"WITH RECURSIVE {NEAR_SQL},\n{forest_sql(5)}\nSELECT a, b, round(d, 6) AS d FROM forest5")
def m5_forest(spark, d):
    """The forest of mutual reachability that the hierarchy is made from."""
    return hierarchy.forest_of(table(spark, d, "embeddings"), "vec_id", "embedding", 5).select("a", "b", F.round("d", 6).alias("d"))


SWEPT = [(points, size) for points in (2, 3) for size in (3, 5)]
SWEEP_SQL = f"WITH RECURSIVE {NEAR_SQL},\n" + ",\n".join([*map(forest_sql, (2, 3)), *(labels_sql(*x) for x in SWEPT)]) + "\n" + " UNION ALL ".join(
    f"SELECT {size} AS min_cluster_size, {points} AS min_samples, count(*) AS clusters, (SELECT count(*) FROM label{points}_{size} WHERE cluster = -1) AS outliers, CAST(max(n) AS BIGINT) AS max_size FROM (SELECT cluster, count(*) AS n FROM label{points}_{size} WHERE cluster >= 0 GROUP BY 1)" for points, size in SWEPT
)


@query("M9_density_sweep", SWEEP_SQL)
def m9_density(spark, d):
    """Cluster counts and noise for each pair of parameters."""
    found = hierarchy.density_sweep(table(spark, d, "embeddings"), "vec_id", "embedding", [3, 5], [2, 3])
    return found.select("min_cluster_size", "min_samples", "clusters", "outliers", "max_size")
