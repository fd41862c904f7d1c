"""Named queries, each with the SQL that says the same over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.projections import CODE_SQL, COMMERCE_SQL, CORPUS_SQL, EVENTS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_GRAPHS = {
    "commerce": COMMERCE_SQL.format(pending=""),
    "dangling": COMMERCE_SQL.format(pending="WHERE status <> 'P'"),
    "events": EVENTS_SQL,
    "corpus": CORPUS_SQL,
    "code": CODE_SQL,
    "": "",
}


def query(sql: str | None = None, graph: str = "commerce", recursive: bool = False) -> Callable[[Query], Query]:
    """Registers a query. ``sql`` begins with further table expressions, if any, and a line ``=>``, then the SELECT."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            extra, arrow, select = sql.rpartition("=>")
            tables = ",\n".join(x.strip() for x in (_GRAPHS[graph], extra) if x.strip())
            SQL[f.__name__] = (f"WITH {'RECURSIVE ' if recursive else ''}{tables}\n" if tables else "") + select.strip()
        return f

    return add
