"""All registered queries of the library proper."""

from factloom.plans import extra_queries, facts_queries, graph_queries, link_queries, matching_queries, package_queries, report_queries, text_queries  # noqa: F401
from factloom.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
