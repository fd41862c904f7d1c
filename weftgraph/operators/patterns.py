"""Detectors of architectural, structural and harmful patterns.

Each returns (type, name, nodes, confidence, location) for a pattern, or its own
columns. ``top`` takes the first by id, as reports do; None returns all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import saved
from ..model import CODE_NODES, Graph, attr
from .aggregates import node_degrees, topk_per_group
from .joins import two_cycles

LAYERS = {
    "business": "business|core|domain|service|usecase",
    "data": "dao|database|db|repo|store",
    "presentation": "api|controller|grpc|handler|http|rest",
}


def _first(df: DataFrame, top: int | None) -> DataFrame:
    return df if top is None else df.orderBy("id").limit(top)


def _pattern(df: DataFrame, kind: str, confidence: Column, nodes: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("type"), F.col("id"), F.col("label").alias("name"), confidence.cast("double").alias("confidence"), attr("package").alias("location"), nodes.alias("nodes"))


def _targets(g: Graph, owners: DataFrame, *types: str) -> DataFrame:
    """``owners`` with ``targets``: the sorted ends of their edges of these types, empty for none."""
    e = g.edges.where(F.col("type").isin(*types)).select(F.col("src").alias("id"), "dst")
    own = e.join(owners.select("id"), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list("dst")).alias("targets"))
    return owners.join(own, "id", "left").withColumn("targets", F.coalesce("targets", F.array().cast("array<string>")))


def _self_and(targets: str) -> Column:
    return F.concat(F.array("id"), F.col(targets))


def factories(g: Graph, top: int | None = None) -> DataFrame:
    own = g.nodes.where((F.col("type") == "function") & F.col("label").startswith("New") & attr("signature").contains(")"))
    return _pattern(_targets(g, _first(own, top), "creates", "returns"), "factory", F.lit(0.8), _self_and("targets"))


def singletons(g: Graph) -> DataFrame:
    own = g.nodes.where(F.col("type").isin("constant", "variable") & F.lower("label").rlike("default|global|instance"))
    used = g.edges.select(F.col("dst").alias("id")).join(own.select("id"), "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return _pattern(own.join(used, "id"), "singleton", F.lit(0.7), F.array("id"))


def handlers(g: Graph, top: int | None = None) -> DataFrame:
    own = g.nodes.where(F.col("type").isin(*CODE_NODES) & F.lower("label").rlike("endpoint|handle|route|serve"))
    sig = attr("signature")
    confidence = F.when(sig.rlike("Request|ResponseWriter"), 0.95).when(sig.contains("Context"), 0.8).otherwise(0.6)
    return _pattern(_first(own, top), "handler", confidence, F.array("id"))


def repositories(g: Graph) -> DataFrame:
    own = g.nodes.where(F.col("type").isin("interface", "struct") & F.lower("label").rlike("dao|repo|storage|store"))
    return _pattern(_targets(g, own, "contains", "has_method"), "repository", F.lit(0.85), _self_and("targets"))


def builders(g: Graph) -> DataFrame:
    own = g.nodes.where((F.col("type") == "struct") & F.lower("label").rlike("builder|options"))
    methods = g.edges.where("type = 'has_method'").join(own.select(F.col("id").alias("src"), "label"), "src").join(g.nodes.select(F.col("id").alias("dst"), attr("signature").alias("sig")), "dst")
    fluent = methods.where(F.col("sig").contains(F.col("label"))).groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("targets")).where(F.size("targets") >= 2)
    return _pattern(own.join(fluent, "id"), "builder", F.lit(0.9), _self_and("targets"))


def hub_nodes(g: Graph, least: int = 10, top: int | None = 10) -> DataFrame:
    d = node_degrees(g).where(F.col("degree") >= least).select("id", "label", "in_degree", "out_degree", "degree")
    return d if top is None else d.orderBy(F.desc("degree"), "id").limit(top)


def layer_members(g: Graph, top: int = 10) -> DataFrame:
    """(layer, id, rank): the first nodes of each layer, if two layers at least have any."""
    package = F.lower(attr("package"))
    names = F.filter(F.array(*(F.when(package.rlike(words), layer) for layer, words in LAYERS.items())), lambda x: x.isNotNull())
    members = g.nodes.where(package != "").select("id", F.explode(names).alias("layer"))
    first = topk_per_group(members, "layer", top, "id")
    several = first.agg((F.count_distinct("layer") >= 2).alias("several"))  # at most ten rows a layer
    return first.crossJoin(several).where("several").select("layer", "id", "rank")


def clusters(g: Graph, least: int = 5, density: float = 2.0) -> DataFrame:
    """(package, nodes, inner_edges) of packages with so many nodes and so many inner edges a node."""
    own = g.nodes.select("id", attr("package").alias("package")).where("package <> ''")
    size = own.groupBy("package").agg(F.count(F.lit(1)).alias("nodes")).where(F.col("nodes") >= least)
    e = g.edges.join(own.select(F.col("id").alias("src"), F.col("package").alias("a")), "src").join(own.select(F.col("id").alias("dst"), F.col("package").alias("b")), "dst").where("a = b")
    inner = e.groupBy(F.col("a").alias("package")).agg(F.count(F.lit(1)).alias("inner_edges"))
    return size.join(inner, "package").where(F.col("inner_edges") / F.col("nodes") >= density)


def god_objects(g: Graph) -> DataFrame:
    """(id, name, methods, dependencies, severity)."""
    own = g.nodes.where(F.col("type").isin("class", "struct")).select("id", "label")
    out = g.edges.select(F.col("src").alias("id"), "dst", F.col("type").alias("t")).join(own, "id")
    kinds = g.nodes.where(F.col("type").isin(*CODE_NODES)).select(F.col("id").alias("dst"), F.lit(1).alias("code"))
    m = out.join(kinds, "dst", "left")
    d = m.groupBy("id", F.col("label").alias("name")).agg(F.count_if(F.col("t").isin("contains", "has_method") & F.col("code").isNotNull()).alias("methods"), F.count(F.lit(1)).alias("dependencies"))
    severity = F.when((F.col("methods") >= 30) | (F.col("dependencies") >= 50), "high").otherwise("medium")
    return d.where("methods >= 20 or dependencies >= 30").withColumn("severity", severity)


def circular_dependencies(g: Graph, top: int | None = None) -> DataFrame:
    c = two_cycles(g.edges)
    return c if top is None else c.orderBy("a", "b").limit(top)


def dead_code(g: Graph, top: int | None = None, usage_types: tuple[str, ...] = ()) -> DataFrame:
    """(id, name): functions and methods that no edge leads to, entry points, tests and exported names left out.

    ``usage_types`` narrows the edges that count as usage; by default containment counts too.
    """
    low = F.lower("label")
    own = g.nodes.where(F.col("type").isin(*CODE_NODES) & ~low.isin("init", "main") & ~low.startswith("test") & ~F.col("label").rlike("^[A-Z]"))
    used = g.edges.where(F.col("type").isin(*usage_types)) if usage_types else g.edges
    return _first(own.join(used.select(F.col("dst").alias("id")), "id", "left_anti").select("id", F.col("label").alias("name")), top)


def health(g: Graph) -> DataFrame:
    """One row (patterns, anti_patterns, health_score) from the lists as reports cut them."""
    g = Graph(g.nodes, saved(g.edges.select("src", "dst", "type")))  # most of the detectors read them
    found = factories(g, 15).select("type").union(singletons(g).select("type")).union(handlers(g, 20).select("type")).union(repositories(g).select("type")).union(builders(g).select("type"))
    found = found.union(hub_nodes(g).select(F.lit("hub_node"))).union(layer_members(g).select("layer").distinct()).union(clusters(g).select(F.lit("cluster")))
    bad = god_objects(g).select("severity").union(circular_dependencies(g, 10).select(F.lit("high"))).union(dead_code(g, 20).select(F.lit("low")))
    cost = F.when(F.col("severity") == "high", 10).when(F.col("severity") == "medium", 5).otherwise(2)
    b = bad.agg(F.count(F.lit(1)).alias("anti_patterns"), F.greatest(F.lit(0.0), 100.0 - F.coalesce(F.sum(cost), F.lit(0))).alias("health_score"))
    return found.agg(F.count(F.lit(1)).alias("patterns")).crossJoin(b)


def pattern_counts(g: Graph) -> DataFrame:
    """(type, n) of all patterns, uncut."""
    parts = [factories(g).select("type"), singletons(g).select("type"), handlers(g).select("type"), repositories(g).select("type"), builders(g).select("type")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


