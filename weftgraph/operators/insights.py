"""Surprising connections, questions worth asking, and the explanation of a node."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import saved
from ..functions.scalars import join_max, label_or_id
from ..model import AMBIGUOUS, INFERRED, Graph
from .aggregates import degrees, edge_type_breakdown, node_degrees
from .communities import cohesion
from .filters import is_code_doc, is_file_hub, is_structural
from .joins import with_ends

PRIORITY = {"ambiguous_edges": 1, "bridge_nodes": 2, "verify_inferred": 3, "isolated_nodes": 4, "low_cohesion": 5}


def surprises(g: Graph, communities: DataFrame, top: int | None = None) -> DataFrame:
    """(src, dst, type, score, why) of edges between two known nodes that are neither structural nor at a hub.

    An edge scores by its confidence and for crossing files, for crossing communities, for a low
    score and for joining code with documents; ``why`` names what it scored for.
    """
    e = with_ends(Graph(g.nodes, g.edges.where(~is_structural(F.col("type")))), "type", "external", "source_file")
    e = e.where(~is_file_hub(F.col("src_type"), F.col("src_external")) & ~is_file_hub(F.col("dst_type"), F.col("dst_external")))
    for end in ("src", "dst"):
        e = e.join(communities.select(F.col("node_id").alias(end), F.col("community_id").alias(f"{end}_community")), end, "left")
    conf = F.col("confidence")
    files = (F.col("src_source_file") != "") & (F.col("dst_source_file") != "") & (F.col("src_source_file") != F.col("dst_source_file"))
    apart = F.coalesce(F.col("src_community") != F.col("dst_community"), F.lit(False))
    unsure = (conf == INFERRED) & (F.col("confidence_score") > 0) & (F.col("confidence_score") < 0.7)
    doc = is_code_doc(F.col("type"))
    base = F.when(conf == AMBIGUOUS, 3.0).when(conf == INFERRED, 2.0).otherwise(1.0)
    score = base + F.when(files, 2.5).otherwise(0.0) + F.when(apart, 2.0).otherwise(0.0) + F.when(unsure, 1.0).otherwise(0.0) + F.when(doc, 1.5).otherwise(0.0)
    why = F.concat_ws(
        "; ", F.when(conf == AMBIGUOUS, "ambiguous").when(conf == INFERRED, "inferred"), F.when(files, "other file"), F.when(apart, "other community"), F.when(unsure, "low score"), F.when(doc, "code and document")
    )
    out = e.select("src", "dst", "type", score.alias("score"), why.alias("why"))
    return out if top is None else out.orderBy(F.desc("score"), "src", "dst", "type").limit(top)


def question_bridges(g: Graph, communities: DataFrame) -> DataFrame:
    """(id, n_communities) of ids whose edges touch two communities at least; no community counts as community 0, file nodes are left out."""
    e = g.edges.select("src", "dst")
    for end in ("src", "dst"):
        e = e.join(communities.select(F.col("node_id").alias(end), F.col("community_id").alias(f"c_{end}")), end, "left")
    e = e.select("src", "dst", F.coalesce("c_src", F.lit(0)).alias("a"), F.coalesce("c_dst", F.lit(0)).alias("b"))
    both = F.explode(F.array(*(F.struct(F.col(i).alias("id"), F.col(c).alias("c")) for i in ("src", "dst") for c in ("a", "b"))))
    touched = e.select(both.alias("x")).select("x.id", "x.c").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n_communities")).where("n_communities >= 2")
    return touched.join(g.nodes.where("type = 'file'").select("id"), "id", "left_anti")


def inferred_by_node(g: Graph, least: int = 3) -> DataFrame:
    """(id, n) of ids with at least ``least`` inferred edges; a loop counts twice."""
    e = g.edges.where(F.col("confidence") == INFERRED)
    return e.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _labelled(df: DataFrame, nodes: DataFrame) -> DataFrame:
    return df.join(nodes.select("id", "label"), "id", "left").withColumn("name", label_or_id(F.col("label"), F.col("id"))).drop("label")


def question_ambiguous(g: Graph) -> DataFrame:
    e = g.edges.where(F.col("confidence") == AMBIGUOUS)
    n = e.agg(F.count(F.lit(1)).alias("n"))
    first = e.orderBy("src", "dst", "type").limit(3)
    names = g.nodes.select("id", "label")
    first = first.join(names.select(F.col("id").alias("src"), F.col("label").alias("ls")), "src", "left").join(names.select(F.col("id").alias("dst"), F.col("label").alias("ld")), "dst", "left")
    pair = F.concat(label_or_id(F.col("ls"), F.col("src")), F.lit(" -> "), label_or_id(F.col("ld"), F.col("dst")))
    shown = first.agg(F.array_sort(F.collect_list(F.struct("src", "dst", "type", pair.alias("p")))).alias("x")).select(F.transform("x", lambda v: v["p"]).alias("shown"))
    return n.crossJoin(shown).where("n > 0").select(
        F.lit("ambiguous_edges").alias("kind"), F.lit("").alias("subject"), F.col("n"), F.concat(F.lit("Which of the uncertain links hold, such as "), join_max(F.col("shown"), 2), F.lit("?")).alias("question")
    )


def question_bridge_nodes(g: Graph, communities: DataFrame) -> DataFrame:
    b = question_bridges(g, communities)
    n = b.agg(F.count(F.lit(1)).alias("n"))
    top = _labelled(b.orderBy(F.desc("n_communities"), "id").limit(3), g.nodes)
    shown = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n_communities")).alias("k"), "id", "name"))).alias("x")).select(F.transform("x", lambda v: v["name"]).alias("shown"))
    return n.crossJoin(shown).where("n > 0").select(
        F.lit("bridge_nodes").alias("kind"), F.lit("").alias("subject"), F.col("n"), F.concat(F.lit("Are "), join_max(F.col("shown"), 3), F.lit(" meant to join communities?")).alias("question")
    )


def question_inferred(g: Graph, least: int = 3) -> DataFrame:
    """A question for every node with ``least`` inferred edges."""
    named = _labelled(inferred_by_node(g, least), g.nodes)
    return named.select(F.lit("verify_inferred").alias("kind"), F.col("id").alias("subject"), "n", F.concat(F.lit("Do the "), F.col("n").cast("string"), F.lit(" inferred links of "), F.col("name"), F.lit(" hold?")).alias("question"))


def question_isolated(g: Graph) -> DataFrame:
    d = node_degrees(Graph(g.nodes.where(~F.col("type").isin("concept", "file", "package")), g.edges)).where("degree <= 1")
    n = d.agg(F.count(F.lit(1)).alias("n"))
    top = d.select("id", label_or_id(F.col("label"), F.col("id")).alias("name")).orderBy("id").limit(3)
    shown = top.agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("x")).select(F.transform("x", lambda v: v["name"]).alias("shown"))
    return n.crossJoin(shown).where("n > 0").select(
        F.lit("isolated_nodes").alias("kind"), F.lit("").alias("subject"), F.col("n"), F.concat(F.lit("What ties "), join_max(F.col("shown"), 3), F.lit(" to the rest?")).alias("question")
    )


def question_cohesion(g: Graph, communities: DataFrame, least_size: int = 5, below: float = 0.15) -> DataFrame:
    c = cohesion(g.edges, communities).where((F.col("size") >= least_size) & (F.col("cohesion") < below))
    first = communities.join(g.nodes.where("type = 'package'").select(F.col("id").alias("node_id"), "label"), "node_id").groupBy("community_id").agg(F.min_by(label_or_id(F.col("label"), F.col("node_id")), "node_id").alias("name"))
    name = F.coalesce("name", F.concat(F.lit("Community "), F.col("community_id").cast("string")))
    q = F.concat(F.lit("Should "), name, F.lit(" be split into smaller parts?"))
    return c.join(first, "community_id", "left").select(F.lit("low_cohesion").alias("kind"), F.col("community_id").cast("string").alias("subject"), F.col("size").alias("n"), q.alias("question"))


def questions(g: Graph, communities: DataFrame, top: int = 5) -> DataFrame:
    """(kind, subject, n, question), the most pressing kinds first; one row of kind no_signal if there is nothing to ask.

    As in a report, at most ``top`` questions for inferred links join the rest.
    """
    g = Graph(g.nodes, saved(g.edges.select("src", "dst", "type", "confidence")))  # each kind of question reads them, some twice
    communities = saved(communities)
    inferred = question_inferred(g).orderBy(F.desc("n"), "subject").limit(top)
    every = question_ambiguous(g).union(question_bridge_nodes(g, communities)).union(inferred).union(question_isolated(g)).union(question_cohesion(g, communities))
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv)), F.col("kind"))
    first = every.withColumn("p", rank).orderBy("p", F.desc("n"), "subject").limit(top)
    none = first.agg((F.count(F.lit(1)) == 0).alias("none")).where("none").select(F.lit("no_signal"), F.lit(""), F.lit(0).cast("bigint"), F.lit(""), F.lit(10))
    return first.union(none).orderBy("p", F.desc("n"), "subject").drop("p")


def explain_neighbors(g: Graph, node_id: str, limit: int = 20) -> DataFrame:
    """(direction, id, label, edge_type, confidence, rank): the first ``limit`` edges each way, by id and type."""
    out = g.edges.where(F.col("src") == node_id).select(F.lit("out").alias("direction"), F.col("dst").alias("id"), F.col("type").alias("edge_type"), "confidence")
    back = g.edges.where(F.col("dst") == node_id).select(F.lit("in").alias("direction"), F.col("src").alias("id"), F.col("type").alias("edge_type"), "confidence")
    rank = F.row_number().over(Window.partitionBy("direction").orderBy("id", "edge_type", "confidence"))
    first = out.union(back).withColumn("rank", rank).where(F.col("rank") <= limit)
    return _labelled(first, g.nodes).select("direction", "id", F.col("name").alias("label"), "edge_type", "confidence", "rank")


def explain(g: Graph, node_id: str, communities: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
    """One row (id, label, type, in_degree, out_degree, degree, is_hub, community_id, community_size, score, rank); none for an unknown id.

    ``communities`` and ``scores`` (id, score) are tables made before: both cost a whole-graph computation.
    """
    one = g.nodes.where(F.col("id") == node_id).select("id", "label", "type")
    own = degrees(g.edges.where((F.col("src") == node_id) | (F.col("dst") == node_id))).where(F.col("id") == node_id)
    out = one.join(own, "id", "left").fillna({"in_degree": 0, "out_degree": 0, "degree": 0})
    place = degrees(g.edges).select(F.col("degree").alias("d")).agg(F.percentile_approx("d", 0.9).alias("p90"))
    out = out.crossJoin(place).withColumn("is_hub", F.col("degree") >= F.col("p90")).drop("p90")
    if communities is not None:
        mine = communities.where(F.col("node_id") == node_id).select("community_id").limit(1)
        size = communities.join(mine, "community_id", "left_semi").groupBy("community_id").agg(F.count(F.lit(1)).alias("community_size"))
        out = out.join(size, F.lit(True), "left")
    if scores is not None:
        mine = scores.where(F.col("id") == node_id).select(F.col("score").alias("mine"))
        above = scores.crossJoin(mine).agg(F.first("mine").alias("score"), (F.count_if((F.col("score") > F.col("mine")) | ((F.col("score") == F.col("mine")) & (F.col("id") < node_id))) + 1).alias("rank"))
        out = out.crossJoin(above)
    return out


def node_detail(g: Graph, communities: DataFrame, node_id: str) -> DataFrame:
    d = explain(g, node_id).drop("is_hub", "degree")
    return d.join(communities.select(F.col("node_id").alias("id"), "community_id"), "id", "left").fillna({"community_id": -1})


__all__ = ["edge_type_breakdown", "explain", "explain_neighbors", "inferred_by_node", "node_detail", "question_ambiguous", "question_bridge_nodes", "question_bridges", "question_cohesion", "question_inferred", "question_isolated", "questions", "surprises"]
