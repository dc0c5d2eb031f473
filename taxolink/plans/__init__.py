"""Registered queries over the supplied tables, with the SQL that gives the same rows."""

from taxolink.plans import derived_queries, extra_queries, graph_queries, link_queries, more_queries, table_queries  # noqa: F401  they register themselves
from taxolink.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
