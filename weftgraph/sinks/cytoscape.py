"""Elements for a graph viewer, with placeholders for ends of edges that have no node row; JSON lines, or one page."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..operators.joins import placeholders

EDGE_STYLES = {
    "calls": ("#4a78c2", "solid"), "contains": ("#9a9a9a", "dotted"), "imports": ("#4a9a63", "dashed"), "references": ("#c08a3a", "solid"), "implements": ("#8a5ab0", "solid"),
    "extends": ("#b05a86", "solid"), "method_of": ("#6f8f9f", "dotted"), "inferred_depends": ("#c2504a", "dashed"), "links_to": ("#3a9aa0", "solid"),
}
LAYOUTS = ("breadthfirst", "circle", "concentric", "cose", "dagre", "grid")


def elements(g: Graph) -> DataFrame:
    """(element, id, label, type, placeholder, source, target). A node without a label takes what follows the ``:`` of its id, as placeholders do."""
    after = F.regexp_replace("id", "^[^:]*:", "")
    label = F.coalesce(F.nullif("label", F.lit("")), F.nullif(F.col("attrs")["label"], F.lit("")), after)
    none = F.lit(None).cast("string")
    nodes = g.nodes.select(F.lit("nodes").alias("element"), "id", label.alias("label"), "type", F.lit(False).alias("placeholder"), none.alias("source"), none.alias("target"))
    absent = placeholders(g).select(F.lit("nodes"), "id", "label", "type", F.lit(True), none, none)
    edges = g.edges.select(F.lit("edges"), F.concat("src", F.lit("->"), "dst", F.lit(":"), "type"), none, "type", F.lit(False), "src", "dst")
    return nodes.union(absent).union(edges)


def json_elements(g: Graph) -> DataFrame:
    """(json): one element a line, its attributes beside its own fields."""
    own = elements(g)
    attrs = g.nodes.select("id", "attrs").union(g.edges.select(F.concat("src", F.lit("->"), "dst", F.lit(":"), "type"), "attrs"))
    joined = own.join(attrs, "id", "left")
    data = F.struct("id", "label", "type", F.when(F.col("placeholder"), True).alias("placeholder"), "source", "target", "attrs")
    return joined.select(F.to_json(F.struct(F.col("element").alias("group"), data.alias("data"))).alias("json"))


def write_json(g: Graph, path: str) -> None:
    json_elements(g).write.mode("overwrite").text(path)


def page(g: Graph, title: str = "Code Graph", layout: str = "dagre") -> str:
    """A page that holds a graph of viewable size; it fails if a node has no label."""
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout: {layout}")
    rows = [json.loads(r["json"]) for r in json_elements(g).collect()]
    bare = [r["data"]["id"] for r in rows if r["group"] == "nodes" and not r["data"].get("label")]
    if bare:
        raise ValueError(f"nodes without a label: {', '.join(bare[:10])}")
    for r in rows:
        extra = r["data"].pop("attrs", None) or {}
        r["data"] = {**extra, **{k: v for k, v in r["data"].items() if v is not None}}
    data = json.dumps(rows, ensure_ascii=False).replace("</", "<\\/")
    style = json.dumps([{"selector": f'edge[type="{t}"]', "style": {"line-color": c, "line-style": s}} for t, (c, s) in EDGE_STYLES.items()])
    return f"""<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><div id="view" style="height:90vh"></div>
<script id="elements" type="application/json">{data}</script>
<script>window.graphOptions = {{layout: {json.dumps(layout)}, style: {style}}};</script>
"""
