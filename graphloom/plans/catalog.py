"""All registered queries."""

from graphloom.plans import queries_auth, queries_files, queries_graph, queries_layout, queries_runs, queries_sources, queries_streams  # noqa: F401
from graphloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
