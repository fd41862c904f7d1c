"""Folders of files for readers: a site of pages, and a bundle for programs that write code."""

from __future__ import annotations

import html
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..operators import filters as W
from ..operators.communities import community_labels
from ..operators.joins import service_mappings
from . import cytoscape, report, toon


def _page(path: Path, text: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def write(g: Graph, folder: str, sources: DataFrame | None = None, communities: DataFrame | None = None, title: str = "Code Graph", infrastructure: bool = True) -> list[str]:
    """Writes the site and returns its pages. With a system node: an overview, and a page for each service's sources
    (``sources``: ordinal, path). A page for each given community. Pages hold graphs of viewable size."""
    g = g if infrastructure else W.without_infrastructure(g)
    root, pages = Path(folder), []
    several = W.has_system_node(g.nodes)
    overview = cytoscape.page(W.system_subgraph(g) if several else g, title)
    links = []
    if several and sources is not None:
        for r in service_mappings(g, sources).where("local_path <> ''").orderBy("slug", "local_path").collect():  # one row a service
            own = W.subgraph_by_path(g, r["local_path"])
            pages.append(f"services/{r['slug']}.html")
            links.append((pages[-1], r["name"]))
            _page(root / pages[-1], cytoscape.page(own, r["name"]))
    if communities is not None:
        for r in community_labels(communities, g.nodes).orderBy("community_id").collect():  # one row a community
            ids = communities.where(F.col("community_id") == r["community_id"]).select(F.col("node_id").alias("id"))
            pages.append(f"communities/{r['community_id']}.html")
            links.append((pages[-1], r["label"] or f"Community {r['community_id']}"))
            _page(root / pages[-1], cytoscape.page(Graph(g.nodes.join(ids, "id", "left_semi"), W.inside(g.edges, ids)), links[-1][1]))
    listed = "".join(f'<li><a href="{html.escape(p)}">{html.escape(name)}</a></li>' for p, name in links)
    _page(root / "index.html", overview + f"<ul>{listed}</ul>\n")
    return ["index.html", *pages]


def write_bundle(g: Graph, folder: str, top: int = 10) -> list[str]:
    """A summary and the compressed compact text of a graph, for programs that read them first."""
    root = Path(folder)
    _page(root / "SUMMARY.md", report.summary(g, top))
    toon.write_gzipped(str(root / "graph.toon.gz"), toon.render(g))
    (root / "semantic").mkdir(exist_ok=True)
    return ["SUMMARY.md", "graph.toon.gz", "semantic"]
