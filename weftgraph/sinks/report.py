"""Reports in Markdown: a summary, the analysis of a graph, a node's explanation, the health of a corpus, a diff."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..operators import aggregates as A
from ..operators import centrality as C
from ..operators import communities as K
from ..operators import insights as I
from ..operators import joins as J


def _table(head: Sequence[str], rows: Iterable[Sequence[object]]) -> list[str]:
    def cell(v: object) -> str:
        return f"{v:.2f}" if isinstance(v, float) else str("" if v is None else v).replace("|", "\\|")

    body = ["| " + " | ".join(map(cell, r)) + " |" for r in rows]
    return ["| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *body, ""] if body else ["none", ""]


def _rows(df: DataFrame, *columns: str) -> list[tuple]:
    return [tuple(r[c] for c in columns) for r in df.collect()]


def _short(label: str, most: int = 40) -> str:
    return label if len(label) <= most else label[: most - 3] + "..."


def summary(g: Graph, top: int = 10, packages: int = 20) -> str:
    out = ["# Graph summary", ""]
    counts = A.graph_summary(g).orderBy("section", "name").collect()
    for section in ("total", "node_type", "edge_type"):
        out += [f"## {section.replace('_', ' ')}", "", *_table(("name", "count"), [(r["name"], r["n"]) for r in counts if r["section"] == section])]
    hubs = A.node_degrees(g).orderBy(F.desc("degree"), "id").limit(top)
    out += ["## hubs", "", *_table(("node", "type", "in", "out", "all"), [(_short(r["label"] or r["id"]), r["type"], r["in_degree"], r["out_degree"], r["degree"]) for r in hubs.collect()])]
    by_package = A.package_overview(g.nodes)
    n = by_package.count()
    rows = _rows(by_package.orderBy(F.desc("items"), "package").limit(packages), "package", "items")
    out += [f"## packages ({n})", "", *_table(("package", "items"), rows + ([("...", f"{n - packages} more")] if n > packages else []))]
    return "\n".join(out)


def report_sections(g: Graph, top: int = 10, communities: DataFrame | None = None, pivots: int | None = None) -> dict[str, DataFrame]:
    """The sections of a report. Communities are computed if they aren't given; ``pivots`` bounds the betweenness."""
    c = communities if communities is not None else K.louvain(g)
    return {
        "summary": A.graph_summary(g), "god_nodes": A.god_nodes(g, top), "bridges": C.betweenness(g, pivots=pivots).orderBy(F.desc("score"), "id").limit(top),
        "communities": K.cohesion(g.edges, c).join(K.community_labels(c, g.nodes), "community_id"), "modularity": K.modularity(g.edges, c), "surprises": I.surprises(g, c, top),
        "isolated": A.isolated_nodes(g), "packages": A.package_stats(g), "cross_file": J.cross_file_edges(g), "questions": I.questions(g, c, 5),
    }


def report(g: Graph, top: int = 10, communities: DataFrame | None = None, pivots: int | None = None) -> str:
    out = ["# Graph report", ""]
    for name, df in report_sections(g, top, communities, pivots).items():
        n = df.count() if name in ("isolated", "cross_file") else None
        order = {"communities": (F.desc("size"), "community_id"), "packages": (F.desc("functions"), "name")}.get(name, ())
        shown = (df.orderBy(*order) if order else df).limit(100 if name == "summary" else max(top, 5))
        out += [f"## {name.replace('_', ' ')}" + (f" ({n})" if n is not None else ""), "", *_table(shown.columns, _rows(shown, *shown.columns))]
    return "\n".join(out)


def explanation(g: Graph, node_id: str, communities: DataFrame | None = None, scores: DataFrame | None = None) -> str:
    row = I.explain(g, node_id, communities, scores).first()
    if row is None:
        return f"no node {node_id}\n"
    out = [f"# {row['label'] or row['id']}", "", *_table(("field", "value"), row.asDict().items())]
    out += ["## edges by type", "", *_table(("type", "count"), _rows(A.edge_type_breakdown(g.edges, node_id).orderBy("type"), "type", "n"))]
    near = I.explain_neighbors(g, node_id).orderBy("direction", "rank")
    return "\n".join(out + ["## neighbours", "", *_table(("direction", "node", "type", "confidence"), _rows(near, "direction", "label", "edge_type", "confidence"))])


def health_text(health: DataFrame) -> str:
    row = health.first().asDict()
    return "\n".join([f"# Corpus health: {row['verdict']}", "", *_table(("measure", "value"), row.items())])


def diff_text(parts: dict[str, DataFrame], shown: int = 10) -> str:
    out = ["# Changes", ""]
    for name, df in parts.items():
        columns = df.columns
        out += [f"## {name.replace('_', ' ')} ({df.count()})", "", *_table(columns, _rows(df.orderBy(*columns).limit(shown), *columns))]
    return "\n".join(out)
