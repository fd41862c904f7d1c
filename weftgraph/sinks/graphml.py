"""GraphML. Edges with an end that has no node row are left out and counted."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Graph, attr

NODE_KEYS = ("type", "label", "package", "source_file")
EDGE_KEYS = ("type", "confidence", "confidence_score")


def _known(g: Graph) -> DataFrame:
    e = g.edges
    for end in ("src", "dst"):
        e = e.join(g.nodes.select(F.col("id").alias(end), F.lit(True).alias(f"known_{end}")).distinct(), end, "left")
    return e.withColumn("known", F.col("known_src").isNotNull() & F.col("known_dst").isNotNull())


def edge_counts(g: Graph) -> DataFrame:
    return _known(g).agg(F.count_if("known").alias("written"), F.count_if(~F.col("known")).alias("skipped"))


def _xml(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def _data(key: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f'<data key="{key}">'), _xml(value), F.lit("</data>"))).otherwise("")


def node_lines(nodes: DataFrame) -> DataFrame:
    data = [_data(f"n_{k}", F.col(k) if k in ("type", "label") else attr(k)) for k in NODE_KEYS]
    return nodes.select("id", F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('">'), *data, F.lit("</node>")).alias("line"))


def edge_lines(g: Graph) -> DataFrame:
    score = F.when(F.col("confidence_score") > 0, F.col("confidence_score").cast("string"))
    data = [_data("e_type", F.col("type")), _data("e_confidence", F.col("confidence")), _data("e_confidence_score", score)]
    line = F.concat(F.lit('<edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('">'), *data, F.lit("</edge>"))
    return _known(g).where("known").select("src", "dst", "type", line.alias("line"))


def header(graph_id: str = "code-graph", directed: bool = True) -> str:
    keys = [f'<key id="n_{k}" for="node" attr.name="{k}" attr.type="string"/>' for k in NODE_KEYS]
    keys += [f'<key id="e_{k}" for="edge" attr.name="{k}" attr.type="{"double" if k == "confidence_score" else "string"}"/>' for k in EDGE_KEYS]
    kind = "directed" if directed else "undirected"
    return '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n' + "\n".join(keys) + f'\n<graph id="{escape(graph_id)}" edgedefault="{kind}">'


FOOTER = "</graph>\n</graphml>"


def write(g: Graph, path: str, graph_id: str = "code-graph", directed: bool = True) -> None:
    """Folders whose files make one document when they are joined in order: header, nodes, edges, footer."""
    spark = g.nodes.sparkSession
    for name, text in (("0-header", header(graph_id, directed)), ("3-footer", FOOTER)):
        spark.createDataFrame([(text,)], "line string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
    node_lines(g.nodes).select("line").write.mode("overwrite").text(f"{path}/1-nodes")
    edge_lines(g).select("line").write.mode("overwrite").text(f"{path}/2-edges")


def render(g: Graph, graph_id: str = "code-graph", directed: bool = True) -> str:
    nodes = [r["line"] for r in node_lines(g.nodes).orderBy("id").collect()]
    edges = [r["line"] for r in edge_lines(g).orderBy("src", "dst", "type").collect()]
    return "\n".join([header(graph_id, directed), *nodes, *edges, FOOTER])
