"""Registered queries over the test tables, each with the SQL that checks it."""

from pactlens.queries import basics, documents, filters, grouping, joining, maintaining, measuring  # noqa: F401
from pactlens.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
