"""Betweenness and hub and authority scores.

Betweenness is exact by three steps. Trees that hang on the graph are folded into the nodes they hang on, leaf by
leaf: what passes a node of a tree follows from the sizes of its branches. Nodes with equal neighbours become one node with a
multiplicity. On what is left Brandes' algorithm runs: from each source a breadth-first search counts shortest paths, and
dependencies flow back level by level. All sources' searches are one DataFrame
program: their state is a table (source, node, depth, paths) that is joined with the
edges at each level, so neither graph nor state has to fit in a worker, and no adjacency is
broadcast. The work grows with sources times edges of what is left; a forest leaves nothing. ``pivots`` estimates from a sample
of sources, scaled up, where all of them are too many.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import saved
from ..model import Graph
from .order import numbered


def betweenness(g: Graph, exclude_edges: Sequence[str] = ("contains",), exclude_nodes: Sequence[str] = ("file", "package"), pivots: int | None = None, halve: bool = False) -> DataFrame:
    """(id, label, type, score), score above 0, of nodes whose type isn't excluded; undirected, without loops and parallel edges.

    Scores are sums over ordered pairs (in a path A-B-C that of B is 2); ``halve`` counts unordered ones.
    ``pivots`` takes that many sources, in order of a hash of their ids.
    """
    e = g.edges.where(~F.col("type").isin(*exclude_edges) & (F.col("src") != F.col("dst")))
    both = e.select(F.col("src").alias("tail"), F.col("dst").alias("head")).union(e.select(F.col("dst").alias("tail"), F.col("src").alias("head")))
    links = saved(both.distinct())
    scale = F.lit(1.0)
    if pivots is None:
        score = _exact(links)
    else:
        single = links.select(F.col("tail").alias("v")).distinct().select("v", F.lit(1.0).alias("m"), F.lit(1.0).alias("w"))
        n = single.count()
        score = _brandes(links, single, single.orderBy(F.xxhash64("v"), "v").limit(pivots))[0]
        scale = F.lit(max(1.0, n / pivots))
    total = score.groupBy(F.col("v").alias("id")).agg((F.sum("score") * scale * (0.5 if halve else 1.0)).alias("score")).where("score > 1e-9")
    own = g.nodes.where(~F.col("type").isin(*exclude_nodes)).select("id", "label", "type")
    return total.join(own, "id").select("id", "label", "type", "score")


def _exact(links: DataFrame) -> DataFrame:
    """(v, score) of every node of ``links`` (tail, head; each link both ways), maybe in several rows."""
    folded, rest, core = _fold(links)
    size = rest.select("v", F.col("s").alias("n"))
    inner = None
    if not core.isEmpty():
        weight = core.select(F.col("tail").alias("v")).distinct().join(rest, "v", "left").select("v", F.coalesce("s", F.lit(1)).cast("double").alias("w"))
        twin, nodes, few = _twins(core, weight)
        score, reach = _brandes(few, nodes, nodes)
        among = few.join(nodes.select(F.col("v").alias("head"), "m"), "head").groupBy("tail").agg(F.sum("m").alias("ways"))
        pairs = nodes.where("pairs > 0").select(F.col("v").alias("tail"), "pairs").join(among, "tail").join(few, "tail")
        score = saved(score.union(pairs.select(F.col("head").alias("v"), F.col("pairs") / F.col("ways"))).groupBy("v").agg(F.sum("score").alias("score")))
        inner = twin.join(score.withColumnRenamed("v", "twin"), "twin").select("v", "score")
        size = rest.join(core.select(F.col("tail").alias("v")), "v", "left_anti").select("v", F.col("s").alias("n"))
        size = saved(size.union(twin.join(reach.select(F.col("v").alias("twin"), "n"), "twin").select("v", "n")))
    parts = []
    for f in reversed(folded):
        own = saved(f.join(size.select(F.col("v").alias("parent"), "n"), "parent").select("v", "s", "squares", "n"))
        parts.append(own)
        size = size.union(own.select("v", "n"))
    out = rest.join(size, "v").select("v", "s", "squares", "n")
    for p in parts:
        out = out.union(p)
    # of the ordered pairs of other nodes those whose ends are in one branch don't pass
    n = F.col("n")
    out = out.select("v", ((n - 1) * (n - 1) - F.col("squares") - (n - F.col("s")) * (n - F.col("s"))).cast("double").alias("score"))
    return out if inner is None else out.union(inner)


def _fold(links: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Takes leaves off until there are none: (leaves of each round, (v, s, squares) of nodes left that leaves were folded into, links left).

    Leaves are (v, parent, s, squares): s counts a node and all folded into it, squares sums the squares of what was folded
    into it at once. The rounds are no more than half of the longest path of a tree.
    """
    folded, rest = [], links.sparkSession.createDataFrame([], "v string, s bigint, squares bigint")
    while True:
        ends = links.groupBy(F.col("tail").alias("v")).agg(F.count(F.lit(1)).alias("k"), F.min("head").alias("parent")).where("k = 1").select("v", "parent")
        # of two nodes that have only each other the smaller one stays
        pair = ends.select(F.col("v").alias("parent"), F.col("parent").alias("v")).where("v < parent")
        ends = ends.join(pair, ["v", "parent"], "left_anti")
        leaves = saved(ends.join(rest, "v", "left").select("v", "parent", F.coalesce("s", F.lit(1).cast("bigint")).alias("s"), F.coalesce("squares", F.lit(0).cast("bigint")).alias("squares")))
        if leaves.isEmpty():
            return folded, rest, links
        folded.append(leaves)
        new = leaves.select(F.col("parent").alias("v"), "s", (F.col("s") * F.col("s")).alias("squares"))
        old = rest.join(leaves.select("v"), "v", "left_anti").select("v", (F.col("s") - 1).alias("s"), "squares")
        rest = saved(new.union(old).groupBy("v").agg((F.sum("s") + 1).alias("s"), F.sum("squares").alias("squares")))
        gone = leaves.select("v")
        links = saved(links.join(gone.withColumnRenamed("v", "tail"), "tail", "left_anti").join(gone.withColumnRenamed("v", "head"), "head", "left_anti").select("tail", "head"))


def _twins(links: DataFrame, weight: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes with equal neighbours as one, the smallest of them: ((v, twin), (v, m, w, pairs), links among those).

    m counts the nodes, w sums their weights, pairs sums the products of weights of ordered pairs of them. Sets of
    neighbours are compared by number and a 128-bit digest, so that a hub's neighbours meet in no list.
    """
    key = ["k", "h1", "h2"]
    digest = links.groupBy(F.col("tail").alias("v")).agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("head")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "head")).alias("h2"))
    digest = saved(digest.join(weight, "v"))
    classes = saved(digest.groupBy(*key).agg(F.min("v").alias("twin"), F.count(F.lit(1)).cast("double").alias("m"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("squares")))
    twin = saved(digest.join(classes.select(*key, "twin"), key).select("v", "twin"))
    nodes = saved(classes.select(F.col("twin").alias("v"), "m", "w", F.when(F.col("m") > 1, F.col("w") * F.col("w") - F.col("squares")).otherwise(0.0).alias("pairs")))
    for end in ("tail", "head"):
        links = links.join(nodes.select(F.col("v").alias(end)), end, "left_semi")
    return twin, nodes, saved(links.select("tail", "head"))


def _brandes(links: DataFrame, nodes: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((v, score), (v, n)): dependencies on each node, in several rows, and the weight that each source reaches.

    ``nodes`` and ``sources`` are (v, m, w): m equal nodes of the weight w in all. Paths from a source start at one of its m
    nodes; the others have the same neighbours, so that no shortest path to another node passes them.
    """
    level = saved(sources.select(F.col("v").alias("s"), F.col("w").alias("sw"), "v", F.lit(1.0).alias("paths"), F.lit(1.0).alias("m"), "w"))
    levels, seen = [level], level.select("s", "v")
    while True:
        step = level.select("s", "sw", F.col("v").alias("tail"), (F.col("paths") * F.col("m")).alias("ways")).join(links, "tail").groupBy("s", "sw", F.col("head").alias("v")).agg(F.sum("ways").alias("paths"))
        level = saved(step.join(seen, ["s", "v"], "left_anti").join(nodes.select("v", "m", "w"), "v").select("s", "sw", "v", "paths", "m", "w"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.union(level.select("s", "v"))
    flow, score, reach = None, levels[0].select("v", F.lit(0.0).alias("score")), levels[0].select("s", "w")
    for d in range(len(levels) - 1, 0, -1):
        at = levels[d]
        reach = reach.union(at.select("s", "w"))
        at = at.join(flow, ["s", "v"], "left").fillna({"dep": 0.0}) if flow is not None else at.withColumn("dep", F.lit(0.0))
        score = score.union(at.groupBy("v").agg(F.sum(F.col("dep") * F.col("sw")).alias("score")))
        share = at.select("s", F.col("v").alias("head"), ((F.col("w") + F.col("m") * F.col("dep")) / F.col("paths")).alias("share")).join(links, "head")
        up = share.select("s", F.col("tail").alias("v"), "share").join(levels[d - 1], ["s", "v"])
        flow = saved(up.groupBy("s", "v").agg((F.sum("share") * F.first("paths")).alias("dep")))
    return score, reach.groupBy(F.col("s").alias("v")).agg(F.sum("w").cast("bigint").alias("n"))


def ranked(scores: DataFrame, top: int | None = None) -> DataFrame:
    """Adds ``rank`` and ``is_top`` (the best tenth, one at least)."""
    n = scores.count()
    first = scores.orderBy(F.desc("score"), "id").limit(top) if top is not None else scores
    return numbered(first, "rank", F.desc("score"), F.col("id")).withColumn("is_top", F.col("rank") <= max(1, n // 10))


def touched_communities(g: Graph, scores: DataFrame, communities: DataFrame) -> DataFrame:
    """(id, communities): of each scored node its own community's and its neighbours', where there are two at least."""
    e = g.edges.select("src", "dst").union(g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = e.join(scores.select(F.col("id").alias("src")), "src", "left_semi").union(scores.select(F.col("id").alias("src"), F.col("id").alias("dst"))).distinct()
    c = near.join(communities.select(F.col("node_id").alias("dst"), "community_id"), "dst")
    return c.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("community_id")).alias("communities")).where(F.size("communities") >= 2)


def hits(edges: DataFrame, tolerance: float = 1e-9, rounds: int = 1000) -> DataFrame:
    """(id, hub, authority) by power iteration over distinct edges, each vector scaled to length 1.

    It ends when no hub score changes by more than ``tolerance``, or after ``rounds``, a bound for graphs whose two largest eigenvalues are equal.
    """
    e = saved(edges.select("src", "dst").distinct())

    def unit(df: DataFrame) -> DataFrame:
        df = saved(df)
        norm = df.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 1.0
        return df.select("id", (F.col("x") / F.lit(norm)).alias("x"))

    hub = unit(e.select(F.col("src").alias("id")).distinct().withColumn("x", F.lit(1.0)))
    for _ in range(rounds):
        before = hub
        authority = unit(e.join(hub.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("x").alias("x")))
        hub = unit(e.join(authority.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("x").alias("x")))
        change = hub.join(before.withColumnRenamed("x", "was"), "id").agg(F.max(F.abs(F.col("x") - F.col("was")))).first()[0]
        if change is None or change <= tolerance:
            break
    a, h = authority.withColumnRenamed("x", "authority"), hub.withColumnRenamed("x", "hub")
    return h.join(a, "id", "full").fillna(0.0, ["hub", "authority"]).select("id", "hub", "authority")
