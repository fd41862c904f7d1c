"""Statements that rebuild a graph in a database that speaks Cypher. Every node also has the label Node, by which edges find it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cypher_key, cypher_label, cypher_string
from ..model import Graph

CONSTRAINT = "CREATE CONSTRAINT node_id IF NOT EXISTS FOR (n:Node) REQUIRE n.id IS UNIQUE;"


def _quoted(key: Column | str, value: Column) -> Column:
    return F.concat(F.lit(key) if isinstance(key, str) else key, F.lit(": '"), cypher_string(value), F.lit("'"))


def _attrs() -> Column:
    """The attributes that aren't empty, by key."""
    entries = F.array_sort(F.map_entries(F.map_filter("attrs", lambda k, v: v != "")))
    return F.transform(entries, lambda e: _quoted(cypher_key(e["key"]), e["value"]))


def _some(cond: Column, item: Column) -> Column:
    return F.when(cond, F.array(item)).otherwise(F.array().cast("array<string>"))


def node_statements(nodes: DataFrame) -> DataFrame:
    """(id, statement)"""
    label = _some((F.coalesce("label", F.lit("")) != "") & (F.col("label") != F.col("id")), _quoted("label", F.col("label")))
    props = F.concat(F.array(_quoted("id", F.col("id")), _quoted("type", F.col("type"))), label, _attrs())
    kind = cypher_label(F.col("type"))
    labels = F.when(kind == "Node", kind).otherwise(F.concat(kind, F.lit(":Node")))
    return nodes.select("id", F.concat(F.lit("CREATE (:"), labels, F.lit(" {"), F.array_join(props, ", "), F.lit("});")).alias("statement"))


def edge_statements(edges: DataFrame) -> DataFrame:
    """(src, dst, statement)"""
    score = _some(F.col("confidence_score") > 0, F.concat(F.lit("confidence_score: "), F.format_string("%.6f", F.col("confidence_score"))))
    props = F.concat(_some(F.coalesce("confidence", F.lit("")) != "", _quoted("confidence", F.col("confidence"))), score, _attrs())
    bag = F.when(F.size(props) > 0, F.concat(F.lit(" {"), F.array_join(props, ", "), F.lit("}"))).otherwise("")
    text = F.concat(
        F.lit("MATCH (a:Node {id: '"), cypher_string(F.col("src")), F.lit("'}), (b:Node {id: '"), cypher_string(F.col("dst")), F.lit("'}) CREATE (a)-[:"), F.upper("type"), bag, F.lit("]->(b);")
    )
    return edges.select("src", "dst", text.alias("statement"))


def write(g: Graph, path: str) -> None:
    """Folders ``1-nodes`` and ``2-edges`` of statements, and ``0-constraint``; to be run in this order."""
    spark = g.nodes.sparkSession
    spark.createDataFrame([(CONSTRAINT,)], "statement string").coalesce(1).write.mode("overwrite").text(f"{path}/0-constraint")
    node_statements(g.nodes).select("statement").write.mode("overwrite").text(f"{path}/1-nodes")
    edge_statements(g.edges).select("statement").write.mode("overwrite").text(f"{path}/2-edges")
