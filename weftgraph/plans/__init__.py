"""All named queries of the graph engine and their SQL."""

from . import basics, graphs, texts  # noqa: F401 - registers the queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
