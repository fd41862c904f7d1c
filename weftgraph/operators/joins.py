"""Joins of edges with nodes, communities and one another, and set operations on graphs.

Nodes are never broadcast by hint: the planner does so where statistics show a small side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import AMBIGUOUS, DEPENDENCY_EDGES, EXTRACTED, INFERRED, Graph, attr


def with_ends(g: Graph, *columns: str, how: str = "inner") -> DataFrame:
    """Edges with ``src_<c>`` and ``dst_<c>`` for node columns or attributes ``c``."""
    out = g.edges
    for end in ("src", "dst"):
        own = [F.col(c) if c in ("type", "label") else attr(c) for c in columns]
        out = out.join(g.nodes.select(F.col("id").alias(end), *(x.alias(f"{end}_{c}") for x, c in zip(own, columns))), end, how)
    return out


def cross_file_edges(g: Graph) -> DataFrame:
    """Edges whose ends name different source files."""
    e = with_ends(g, "source_file").where("src_source_file <> '' and dst_source_file <> '' and src_source_file <> dst_source_file")
    return e.select("src", "dst", "type", "src_source_file", "dst_source_file")


def with_communities(edges: DataFrame, communities: DataFrame, how: str = "inner") -> DataFrame:
    for end in ("src", "dst"):
        edges = edges.join(communities.select(F.col("node_id").alias(end), F.col("community_id").alias(f"{end}_community")), end, how)
    return edges


def bridge_edges(edges: DataFrame, communities: DataFrame) -> DataFrame:
    e = with_communities(edges, communities).where("src_community <> dst_community")
    return e.select("src", "dst", "type", "src_community", "dst_community")


def placeholders(g: Graph) -> DataFrame:
    """(id, label, type) for ends of edges that have no node row; the type follows the id's prefix."""
    ends = g.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(g.nodes.select("id"), "id", "left_anti")
    prefix = F.substring_index("id", ":", 1)
    kind = (
        F.when(~F.col("id").contains(":"), "unknown").when(prefix == "svc", "service").when(prefix == "helm", "helm_chart").when(prefix == "terraform", "terraform_module")
        .when(prefix == "repo", "repository").when(prefix.isin("cloudsql", "dynamodb", "rds"), "database").when(prefix.isin("pubsub", "sns", "sqs"), "queue")
        .when(prefix.isin("gcs", "r2", "s3"), "storage").otherwise("unknown")
    )
    return ends.select("id", F.regexp_replace("id", "^[^:]*:", "").alias("label"), kind.alias("type"))


def two_cycles(edges: DataFrame, types: tuple[str, ...] = DEPENDENCY_EDGES) -> DataFrame:
    """(a, b), a < b: pairs that depend on each other. One shuffle by the unordered pair, without a self-join."""
    e = edges.where(F.col("type").isin(*types) & (F.col("src") != F.col("dst")))
    pair = e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return pair.agg(F.bool_or(F.col("src") < F.col("dst")).alias("there"), F.bool_or(F.col("src") > F.col("dst")).alias("back")).where("there and back").select("a", "b")


def service_mappings(g: Graph, sources: DataFrame) -> DataFrame:
    """(name, slug, repo_url, local_path) for links from services to repositories.

    ``sources`` (ordinal, path); the first path whose last element is the repository's name is its local path.
    Without any link each source is a service of its own.
    """
    from ..functions.scalars import label_or_id, repo_name, slugify

    services = g.nodes.where((F.col("type") == "service") | F.col("id").startswith("svc:"))
    bare = F.regexp_replace("id", "^svc:", "")
    links = g.edges.where((F.col("type") == "links_to") & F.col("dst").startswith("repo:")).join(
        services.select(F.col("id").alias("src"), label_or_id(F.col("label"), bare).alias("name")), "src"
    )
    links = links.select("name", F.regexp_replace("dst", "^repo:", "").alias("repo_url")).withColumn("repo", repo_name(F.col("repo_url")))
    tails = sources.select("ordinal", "path", F.substring_index(F.regexp_replace(F.replace(F.col("path"), F.lit("\\"), F.lit("/")), "/+$", ""), "/", -1).alias("repo"))
    first = tails.groupBy("repo").agg(F.min_by("path", "ordinal").alias("local_path"))
    mapped = links.join(first, "repo", "left").select("name", slugify(F.col("name")).alias("slug"), "repo_url", F.coalesce("local_path", F.lit("")).alias("local_path"))
    own = tails.select(F.col("repo").alias("name"), slugify(F.col("repo")).alias("slug"), F.lit("").alias("repo_url"), F.col("path").alias("local_path"))
    none = mapped.limit(1).agg((F.count(F.lit(1)) == 0).alias("none"))
    return mapped.union(own.crossJoin(none).where("none").drop("none"))


def merge_nodes(ast: DataFrame, semantic: DataFrame) -> DataFrame:
    """All of ``ast``, and of ``semantic`` (with ``ordinal``) the first row of each id that ``ast`` lacks."""
    first = F.row_number().over(Window.partitionBy("id").orderBy("ordinal"))
    new = semantic.withColumn("rn", first).where("rn = 1").join(ast.select("id"), "id", "left_anti")
    return ast.unionByName(new.select("id", "type", "label", "attrs"))


def merge_edges(ast: DataFrame, semantic: DataFrame) -> DataFrame:
    """All of ``ast``, and of ``semantic`` (with ``reason`` and ``ordinal``) the first row of each (src, dst, type) that ``ast`` lacks.

    New edges are INFERRED unless they are AMBIGUOUS and carry their reason and ``source = llm``.
    """
    key = ["src", "dst", "type"]
    first = F.row_number().over(Window.partitionBy(*key).orderBy("ordinal"))
    # keys hardly repeat: rows are sorted once, behind the exchange, which the join needs as well
    new = semantic.repartition(*key).withColumn("rn", first).where("rn = 1").join(ast.select(*key), key, "left_anti")
    confidence = F.when(F.col("confidence") == AMBIGUOUS, AMBIGUOUS).otherwise(INFERRED)
    reason = F.create_map(F.lit("reason"), F.coalesce("reason", F.lit("")), F.lit("source"), F.lit("llm"))
    return ast.unionByName(new.select(*key, confidence.alias("confidence"), "confidence_score", F.map_filter(reason, lambda k, v: v != "").alias("attrs")))


def semantic_violations(semantic: DataFrame) -> DataFrame:
    """(ordinal, problem): what is wrong with each edge that is wrong, by its first problem."""
    problem = (
        F.when(F.coalesce("src", F.lit("")) == "", "missing src").when(F.coalesce("dst", F.lit("")) == "", "missing dst").when(F.coalesce("type", F.lit("")) == "", "missing type")
        .when(F.col("confidence") == EXTRACTED, "an inferred edge can't be EXTRACTED").when(~F.coalesce("confidence", F.lit("")).isin(AMBIGUOUS, INFERRED), "unknown confidence")
        .when((F.col("confidence_score") < 0) | (F.col("confidence_score") > 1), "score out of range")
    )
    return semantic.select("ordinal", problem.alias("problem")).where("problem is not null")


def validate_semantic(semantic: DataFrame) -> None:
    bad = semantic_violations(semantic).orderBy("ordinal").first()
    if bad:
        raise ValueError(f"edge {bad['ordinal']}: {bad['problem']}")


def diff(old: Graph, new: Graph) -> dict[str, DataFrame]:
    """Nodes by id and edges by (src, dst, type) that only one snapshot has."""
    node, edge = ["id", "type", "label"], ["src", "dst", "type"]
    return {
        "new_nodes": new.nodes.select(*node).join(old.nodes.select("id"), "id", "left_anti"),
        "removed_nodes": old.nodes.select(*node).join(new.nodes.select("id"), "id", "left_anti"),
        "new_edges": new.edges.select(*edge).join(old.edges.select(*edge), edge, "left_anti"),
        "removed_edges": old.edges.select(*edge).join(new.edges.select(*edge), edge, "left_anti"),
    }


def union_graphs(*graphs: Graph) -> Graph:
    nodes, edges = graphs[0].nodes, graphs[0].edges
    for g in graphs[1:]:
        nodes, edges = nodes.unionByName(g.nodes), edges.unionByName(g.edges)
    return Graph(nodes, edges).distinct()


def chunk(df: DataFrame, size: int, *order: str) -> DataFrame:
    """Adds ``chunk``, the number of each run of ``size`` rows in order.

    A global row number, made of range partitions: the partitions' counts (one row each) give the offsets, so that no
    partition has to hold all rows.
    """
    if size <= 0:
        raise ValueError("size must be positive")
    from ..checkpoints import saved

    ranged = saved(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + F.col("_before")
    return ranged.join(before, "_part").withColumn("chunk", F.floor(at / size).cast("bigint")).drop("_part", "_before")
