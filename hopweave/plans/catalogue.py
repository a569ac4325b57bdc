"""Every query of the analytics side, by name, with the SQL that checks it."""

from __future__ import annotations

from hopweave.plans import forecast_queries, geo_queries, graph_queries, merge_queries, source_queries, summary_queries, text_queries, trajectory_queries  # noqa: F401
from hopweave.plans.register import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
