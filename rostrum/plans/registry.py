"""Registered queries: a DataFrame function by name and, where SQL can say it, the same in portable SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rostrum.sources.fixtures import with_views

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql:
            SQL[name] = with_views(sql, *views)
        return run

    return register


def ratio_sql(pairs: str) -> str:
    """Views that end in ratio(a, b, similarity) for distinct pairs, a query that gives a and b: blocks that both strings
    share are taken longest first, of equal ones the first in a, then in b, and again left and right of each."""
    return f"""pairs AS ({pairs}), lowered AS (SELECT a, b, lower(a) AS x, lower(b) AS y FROM pairs),
at_a AS (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM lowered), at_b AS (SELECT *, unnest(range(1, len(y) + 1)) AS j FROM at_a),
same AS (SELECT *, unnest(range(1, least(len(x) - i, len(y) - j) + 2)) AS k FROM at_b WHERE substr(x, i, 1) = substr(y, j, 1)),
block AS (SELECT a, b, i, j, k FROM same WHERE substr(x, i, k) = substr(y, j, k)),
span AS (SELECT a, b, 1 AS a0, len(x) + 1 AS a1, 1 AS b0, len(y) + 1 AS b1, 0 AS hit FROM lowered UNION ALL
SELECT a, b, CASE WHEN side = 0 THEN a0 ELSE m.i + m.k END, CASE WHEN side = 0 THEN m.i ELSE a1 END, CASE WHEN side = 0 THEN b0 ELSE m.j + m.k END, CASE WHEN side = 0 THEN m.j ELSE b1 END, CASE WHEN side = 0 THEN m.k ELSE 0 END
FROM (SELECT p.a, p.b, a0, a1, b0, b1, arg_max({{'i': i, 'j': j, 'k': k}}, (k, -i, -j)) AS m FROM span p JOIN block c ON c.a = p.a AND c.b = p.b AND i >= a0 AND i + k <= a1 AND j >= b0 AND j + k <= b1 GROUP BY ALL), (VALUES (0), (1)) AS t(side)),
ratio AS (SELECT l.a, l.b, CASE WHEN len(x) + len(y) = 0 THEN 1e0 ELSE 2e0 * hits / (len(x) + len(y)) END AS similarity FROM lowered l JOIN (SELECT a, b, CAST(sum(hit) AS INT) AS hits FROM span GROUP BY 1, 2) h ON h.a = l.a AND h.b = l.b)"""
