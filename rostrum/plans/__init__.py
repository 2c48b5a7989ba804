"""The registered queries over the speech corpus."""

from rostrum.plans import aggregates, analysis, density, filters, ingest, neighbours, stores, streams  # noqa: F401
from rostrum.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
