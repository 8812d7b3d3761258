"""Registered queries."""

from . import audience_queries, homes_queries, persona_queries, postal_queries, report_queries, table_queries, visits_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
