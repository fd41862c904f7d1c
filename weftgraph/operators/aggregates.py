"""Counts, degrees and summaries. Every one is a partial aggregate on the map side before its shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import saved
from ..functions.scalars import label_tokens
from ..model import CODE_NODES, Graph, attr
from .filters import without_ids

ONE = "*"


def node_type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count(ONE).alias("n"))


def edge_type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count(ONE).alias("n"))


def confidence_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("confidence").agg(F.count(ONE).alias("n"))


def edges_grouped(edges: DataFrame, by: str = "type") -> DataFrame:
    """(by, edges): each group's edges as one sorted list. A list grows with its group; for counts use the functions above, for text :func:`edges_joined`."""
    return edges.groupBy(by).agg(F.sort_array(F.collect_list(F.concat_ws("|", "src", "dst"))).alias("edges"))


def edges_joined(edges: DataFrame, by: str = "type", rows: int = 250_000) -> DataFrame:
    """(by, edges): each group's edges as one sorted text, joined by commas.

    Edges are sorted by range and joined to pieces of about ``rows`` edges, of which a last task makes one text for
    each group. It holds few pieces instead of a list of all edges, but the text itself is a cell: Spark ends at 2 GB.
    """
    lines = saved(edges.select(by, F.concat_ws("|", "src", "dst").alias("line")))
    parts = max(1, -(-lines.count() // rows))
    piece = lines.repartitionByRange(parts, by, "line").withColumn("part", F.spark_partition_id()).groupBy(by, "part").agg(F.array_join(F.sort_array(F.collect_list("line")), ",").alias("text"))
    return piece.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), ",").alias("edges"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, degree) of every id that an edge touches, with or without a node row; one shuffle."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    d = ends.groupBy(F.col("x.id").alias("id")).agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))
    return d.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def node_degrees(g: Graph) -> DataFrame:
    """(id, type, label, attrs, in_degree, out_degree, degree) of every node row, 0 without edges."""
    zero = {c: 0 for c in ("in_degree", "out_degree", "degree")}
    return g.nodes.join(degrees(g.edges), "id", "left").fillna(zero)


def god_nodes(g: Graph, top: int | None = 10, exclude_types: Sequence[str] = ("file", "package")) -> DataFrame:
    """Node rows by degree, most first; the degree table is shuffled once and joined by id."""
    d = degrees(g.edges).join(g.nodes.where(~F.col("type").isin(*exclude_types)).select("id", "label", "type"), "id")
    out = d.select("id", "label", "type", "in_degree", "out_degree", "degree")
    return out if top is None else out.orderBy(F.desc("degree"), "id").limit(top)


def summary_god_nodes(g: Graph, top: int = 10, exclude_prefixes: Sequence[str] = ("call_",), exclude_substrings: Sequence[str] = ()) -> DataFrame:
    """(id, degree) over edge ends, with or without a node row."""
    d = without_ids(degrees(g.edges).select("id", "degree"), "id", exclude_prefixes, exclude_substrings)
    return d.orderBy(F.desc("degree"), "id").limit(top)


def isolated_nodes(g: Graph, threshold: int = 1, exclude_types: Sequence[str] = ("file", "package")) -> DataFrame:
    d = node_degrees(Graph(g.nodes.where(~F.col("type").isin(*exclude_types)), g.edges))
    return d.where(F.col("degree") <= threshold).select("id", "label", "type", "degree")


def graph_summary(g: Graph) -> DataFrame:
    """(section, name, n): totals, and counts by type and confidence, in one scan of either relation; totals are 0 for an empty graph."""
    e = g.edges.groupingSets([["type"], ["confidence"]], "type", "confidence").agg(F.count(ONE).alias("n"), F.grouping("type").alias("g"))
    e = e.select(F.when(F.col("g") == 0, "edge_type").otherwise("confidence").alias("section"), F.when(F.col("g") == 0, F.col("type")).otherwise(F.col("confidence")).alias("name"), "n")
    n = g.nodes.groupBy("type").agg(F.count(ONE).alias("n")).select(F.lit("node_type").alias("section"), F.col("type").alias("name"), "n")

    def total(counts: DataFrame, section: str, name: str) -> DataFrame:
        return counts.agg(F.coalesce(F.sum(F.when(F.col("section") == section, F.col("n"))), F.lit(0)).alias("n")).select(F.lit("total").alias("section"), F.lit(name).alias("name"), "n")

    return n.union(total(n, "node_type", "nodes")).union(e).union(total(e, "edge_type", "edges"))


def package_stats(g: Graph) -> DataFrame:
    """(name, files, functions, types, imports) of each package, ``pkg_`` stripped; a package node without one is its own."""
    own = F.when(attr("package") != "", attr("package")).when(F.col("type") == "package", F.col("id"))
    named = g.nodes.select("id", "type", F.regexp_replace(own, "^pkg_", "").alias("name"), F.regexp_replace(attr("package"), "^pkg_", "").alias("package"))

    def count(cond: Column) -> Column:
        return F.count_if(cond)

    kind = F.col("type")
    stats = named.where("name is not null").groupBy("name").agg(count(kind == "file").alias("files"), count(kind.isin(*CODE_NODES)).alias("functions"), count(kind.isin("interface", "struct")).alias("types"))
    importing = g.edges.where(F.col("type") == "imports").select(F.col("src").alias("id")).join(named.select("id", "package"), "id")
    imports = importing.groupBy(F.col("package").alias("name")).agg(F.count(ONE).alias("imports"))
    return stats.join(imports, "name", "left").fillna({"imports": 0})


def package_overview(nodes: DataFrame) -> DataFrame:
    """(package, items): the part of the id before its first dot, over functions, methods, structs and interfaces."""
    own = nodes.where(F.col("type").isin(*CODE_NODES, "interface", "struct") & F.col("id").contains("."))
    return own.groupBy(F.substring_index("id", ".", 1).alias("package")).agg(F.count(ONE).alias("items"))


def edge_type_breakdown(edges: DataFrame, node_id: str) -> DataFrame:
    """(type, n) of the edges at a node; a loop counts for either end."""
    at = edges.where((F.col("src") == node_id) | (F.col("dst") == node_id))
    ends = (F.col("src") == node_id).cast("int") + (F.col("dst") == node_id).cast("int")
    return at.groupBy("type").agg(F.sum(ends).cast("bigint").alias("n"))


def semantic_breakdown(edges: DataFrame) -> DataFrame:
    """(section, name, n) of the edges that aren't extracted, by type and by confidence."""
    own = edges.where("confidence <> 'EXTRACTED'")
    g = own.groupingSets([["type"], ["confidence"]], "type", "confidence").agg(F.count(ONE).alias("n"))
    return g.select(F.when(F.col("type").isNotNull(), "type").otherwise("confidence").alias("section"), F.coalesce("type", "confidence").alias("name"), "n")


def graph_tokens(g: Graph) -> DataFrame:
    """One row: graph_nodes, graph_edges, graph_tokens."""
    n = g.nodes.agg(F.count(ONE).alias("graph_nodes"), F.coalesce(F.sum(5 + label_tokens(F.col("label")) + 3 * F.size("attrs")), F.lit(0)).alias("nt"))
    e = g.edges.agg(F.count(ONE).alias("graph_edges"), F.coalesce(F.sum(8 + 3 * F.size("attrs")), F.lit(0)).alias("et"))
    return n.crossJoin(e).select("graph_nodes", "graph_edges", (F.col("nt") + F.col("et")).cast("bigint").alias("graph_tokens"))


def corpus_health(g: Graph, source: DataFrame) -> DataFrame:
    """``source`` has one row (files, source_tokens); without tokens 500 a file are taken."""
    est = F.when(F.col("source_tokens") > 0, F.col("source_tokens")).otherwise(F.col("files") * 500)
    h = graph_tokens(g).crossJoin(source).withColumn("estimated_tokens", est.cast("bigint"))
    cut = F.when(F.col("estimated_tokens") > 0, F.greatest(F.lit(0.0), (F.col("estimated_tokens") - F.col("graph_tokens")) / F.col("estimated_tokens") * 100)).otherwise(0.0)
    h = h.withColumn("token_reduction", cut).withColumn("edges_per_node", F.when(F.col("graph_nodes") > 0, F.col("graph_edges") / F.col("graph_nodes")).otherwise(0.0))
    r, d = F.col("token_reduction"), F.col("edges_per_node")
    verdict = (
        F.when((F.col("graph_nodes") < 10) | (F.col("graph_edges") < 5), "limited").when(d < 0.3, "marginal")
        .when(r >= 50, "valuable").when(r >= 10, "marginal").otherwise("limited")
    )
    return h.select("files", "graph_nodes", "graph_edges", "graph_tokens", "estimated_tokens", F.floor(F.col("estimated_tokens") * 0.7).cast("bigint").alias("word_count"), "token_reduction", verdict.alias("verdict"))


def topk_per_group(df: DataFrame, group: str | Sequence[str], k: int, *order: Column | str) -> DataFrame:
    """The first ``k`` rows of each group, by a group-limited window."""
    from pyspark.sql import Window

    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)
