"""What could be shared: like signatures, repeated names, common dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import saved
from ..functions.scalars import is_common_name, normalize_signature
from ..model import CODE_NODES, DEPENDENCY_EDGES, Graph, attr


def _members(own: DataFrame, groups: DataFrame, key: str, top: int | None) -> DataFrame:
    """``groups`` with the sorted ids of their rows in ``own``; with ``top`` only the largest groups' ids are brought together."""
    if top is not None:
        groups = groups.orderBy(F.desc("n"), key).limit(top)
    ids = own.join(groups.select(key), key, "left_semi").groupBy(key).agg(F.array_sort(F.collect_list("id")).alias("nodes"))
    return groups.join(ids, key)


def similar_signatures(nodes: DataFrame, top: int | None = 20) -> DataFrame:
    """(pattern, n, nodes) of signatures that are equal but for names, most members first."""
    own = nodes.where(F.col("type").isin(*CODE_NODES) & (attr("signature") != "")).select("id", normalize_signature(attr("signature")).alias("pattern")).where("pattern <> ''")
    return _members(own, own.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where("n >= 2"), "pattern", top)


def duplicate_names(nodes: DataFrame, top: int | None = 20) -> DataFrame:
    """(name, n, packages, nodes) of labels in two packages at least, common names left out."""
    own = nodes.where((F.col("label") != "") & ~is_common_name(F.col("label"))).select("id", F.col("label").alias("name"), F.nullif(attr("package"), F.lit("")).alias("package"))
    groups = own.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("package")).alias("packages"))
    return _members(own, groups.where((F.col("n") >= 2) & (F.size("packages") >= 2)), "name", top).select("name", "n", "packages", "nodes")


def shared_dependencies(edges: DataFrame, top: int | None = 10) -> DataFrame:
    """(deps, n_deps, nodes): ids with the same three or more dependencies, repeated edges counting as often.

    Lists are made only of ids whose dependencies have the number and the digest of another id's; the lists themselves decide.
    """
    own = saved(edges.where(F.col("type").isin(*DEPENDENCY_EDGES)).select("src", "dst"))
    digest = saved(own.groupBy("src").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("dst")).alias("h")).where("k >= 3"))
    alike = digest.join(digest.groupBy("k", "h").agg(F.count(F.lit(1)).alias("n")).where("n >= 2"), ["k", "h"], "left_semi")
    of = own.join(alike.select("src"), "src", "left_semi").groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("deps")).where(F.size("deps") >= 3)
    groups = of.groupBy("deps").agg(F.array_sort(F.collect_list("src")).alias("nodes")).where(F.size("nodes") >= 2).select("deps", F.size("deps").alias("n_deps"), "nodes")
    return groups if top is None else groups.orderBy(F.desc("n_deps"), "deps").limit(top)


def refactor_candidates(g: Graph) -> DataFrame:
    """(kind, subject, nodes, priority), from the lists as they are cut for reports."""
    a = similar_signatures(g.nodes).where("n >= 4").select(F.lit("extract_interface").alias("kind"), F.col("pattern").alias("subject"), "nodes", F.lit("medium").alias("priority"))
    b = duplicate_names(g.nodes).where(F.size("packages") >= 3).select(F.lit("consolidate"), "name", "nodes", F.lit("low"))
    c = shared_dependencies(g.edges).where((F.col("n_deps") >= 5) & (F.size("nodes") >= 3)).select(F.lit("extract_service"), F.array_join("deps", "|"), "nodes", F.lit("high"))
    return a.union(b).union(c)


def reuse_summary(g: Graph) -> DataFrame:
    def one(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(name))

    out = one(g.nodes, "total_nodes")
    for df, name in ((similar_signatures(g.nodes), "similar_groups"), (duplicate_names(g.nodes), "duplicate_groups"), (refactor_candidates(g), "candidates")):
        out = out.crossJoin(one(df, name))
    return out
