"""Breadth-first and depth-first traversal, shortest paths, neighbours and components.

A traversal is a loop over levels: the frontier is joined with the edges, ids already seen are
removed by an anti-join, and each level is written to the shared folder as a table, whose
size the planner then knows: it broadcasts a small frontier, and the edges aren't
shuffled. The loop ends with the depth asked for or an empty frontier; nothing but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import saved
from ..model import Graph


def arcs(edges: DataFrame, direction: str = "out", types: Sequence[str] = ()) -> DataFrame:
    """(tail, head, type): the steps that a traversal may take."""
    e = edges.where(F.col("type").isin(*types)) if types else edges
    out, back = e.select(F.col("src").alias("tail"), F.col("dst").alias("head"), "type"), e.select(F.col("dst").alias("tail"), F.col("src").alias("head"), "type")
    return {"out": out, "in": back, "both": out.union(back)}[direction]


def _levels(steps: DataFrame, start: DataFrame, depth: int, target: str | None = None) -> DataFrame:
    """(id, depth, parent, via) of the ids within ``depth`` steps; the parent is the smallest one, then the smallest type."""
    frontier = saved(start.select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("via")))
    seen = frontier
    for d in range(1, depth + 1):
        reached = frontier.select(F.col("id").alias("tail")).join(steps, "tail").groupBy(F.col("head").alias("id")).agg(F.min(F.struct("tail", "type")).alias("p"))
        frontier = reached.join(seen.select("id"), "id", "left_anti").select("id", F.lit(d).alias("depth"), F.col("p.tail").alias("parent"), F.col("p.type").alias("via"))
        frontier = saved(frontier)
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
        if target is not None and not frontier.where(F.col("id") == target).isEmpty():
            break
    return seen


def bfs(g: Graph, start: str | Sequence[str], depth: int, direction: str = "both", types: Sequence[str] = ()) -> DataFrame:
    """(id, depth) of the ids within ``depth`` steps of the start nodes that exist; dangling ids are visited too."""
    starts = [start] if isinstance(start, str) else list(start)
    steps = saved(arcs(g.edges, direction, types)) if depth > 1 else arcs(g.edges, direction, types)
    return _levels(steps, g.nodes.where(F.col("id").isin(*starts)).select("id"), depth).select("id", "depth")


def bfs_edges(g: Graph, visited: DataFrame, max_depth: int, direction: str = "both", types: Sequence[str] = ()) -> DataFrame:
    """The edges between visited ids whose tail lies above the last level."""
    e = g.edges.where(F.col("type").isin(*types)) if types else g.edges
    v = visited.select("id", "depth")
    e = e.join(v.select(F.col("id").alias("src"), F.col("depth").alias("ds")), "src").join(v.select(F.col("id").alias("dst"), F.col("depth").alias("dd")), "dst")
    tail = {"out": F.col("ds"), "in": F.col("dd"), "both": F.least("ds", "dd")}[direction]
    return e.where(tail < max_depth).select("src", "dst", "type")


def layers(visited: DataFrame, limit: int = 100) -> DataFrame:
    """(depth, n, ids): each level's size and its first ids."""
    ranked = visited.withColumn("rank", F.row_number().over(Window.partitionBy("depth").orderBy("id"))).where(F.col("rank") <= limit)
    first = ranked.groupBy("depth").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return visited.groupBy("depth").agg(F.count(F.lit(1)).alias("n")).join(first, "depth")


def query_graph(g: Graph, query: str, depth: int = 2, seeds: int = 5) -> tuple[DataFrame, DataFrame]:
    """(visited, edges) around the nodes that match a query, undirected, at most six levels deep.

    An edge is found if it leads from a level to an id that wasn't visited before that level.
    """
    from .filters import seed_nodes

    depth = min(max(depth, 1), 6)
    visited = _levels(saved(arcs(g.edges, "both")), seed_nodes(g.nodes, query, seeds).select("id"), depth).select("id", "depth")
    v = saved(visited)
    e = g.edges.join(v.select(F.col("id").alias("src"), F.col("depth").alias("ds")), "src").join(v.select(F.col("id").alias("dst"), F.col("depth").alias("dd")), "dst")
    return v.join(g.nodes.select("id", "label", "type"), "id"), e.where("ds <> dd").select("src", "dst", "type", "confidence")


def shortest_path(g: Graph, start: str, end: str, direction: str = "out", types: Sequence[str] = (), max_depth: int = 64) -> DataFrame:
    """(step, id, via): the ids of a path of fewest edges and the type of the edge into each; empty if there is none.

    Of several predecessors the smallest id is taken, then the smallest edge type.
    """
    spark = g.nodes.sparkSession
    levels = _levels(saved(arcs(g.edges, direction, types)), g.nodes.where(F.col("id") == start).select("id"), max_depth, end)
    path, at = [], end
    while at is not None:  # one row for each step of the answer
        row = levels.where(F.col("id") == at).first()
        if row is None:
            return spark.createDataFrame([], "step int, id string, via string")
        path.append((row["depth"], at, row["via"]))
        at = row["parent"]
    return spark.createDataFrame(path[::-1], "step int, id string, via string")


def dfs(g: Graph, start: str | Sequence[str], depth: int, direction: str = "both", types: Sequence[str] = ()) -> DataFrame:
    """(id, depth, position) in depth-first order, neighbours by id, within ``depth`` steps.

    The order is sequential by nature. It is taken on one worker over the edges of the ball of ``depth`` steps, which the
    distributed breadth-first search extracts; the ball must fit there.
    """
    import pandas as pd

    starts = [start] if isinstance(start, str) else list(start)
    ball = saved(bfs(g, starts, depth, direction, types))
    own = arcs(bfs_edges(g, ball, depth, direction, types), direction).select("tail", "head").distinct()
    exists = g.nodes.where(F.col("id").isin(*starts)).select(F.lit(None).cast("string").alias("tail"), F.col("id").alias("head"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        roots = sorted(pdf[pdf["tail"].isna()]["head"], key=starts.index)
        kids: dict[str, list[str]] = {}
        for t, h in pdf[pdf["tail"].notna()].sort_values(["tail", "head"], ascending=[True, False])[["tail", "head"]].itertuples(index=False):
            kids.setdefault(t, []).append(h)
        seen: dict[str, int] = {}
        stack = [(r, 0) for r in reversed(roots)]
        while stack:
            node, d = stack.pop()
            if node in seen or d > depth:
                continue
            seen[node] = d
            stack += [(k, d + 1) for k in kids.get(node, ()) if k not in seen]
        return pd.DataFrame({"id": list(seen), "depth": list(seen.values()), "position": range(len(seen))})

    return own.union(exists).withColumn("one", F.lit(True)).groupBy("one").applyInPandas(walk, "id string, depth int, position int")


def neighbors(g: Graph, node_id: str, direction: str = "both") -> DataFrame:
    """(id, label, type, edge_type, direction), distinct; a loop counts as outgoing; ids without a node row are left out."""
    out = g.edges.where(F.col("src") == node_id).select(F.col("dst").alias("id"), F.col("type").alias("edge_type"), F.lit("out").alias("direction"))
    loop = F.lit(True) if direction == "in" else F.col("src") != node_id
    back = g.edges.where((F.col("dst") == node_id) & loop).select(F.col("src").alias("id"), F.col("type").alias("edge_type"), F.lit("in").alias("direction"))
    found = {"out": out, "in": back, "both": out.union(back)}[direction].distinct()
    return found.join(g.nodes.select("id", "label", "type"), "id").select("id", "label", "type", "edge_type", "direction")


def star_components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of the connected component of each node of ``edges`` (a, b), two columns of one type.

    Alternating large-star and small-star steps (Kiveris et al., 2014); their number grows with the
    logarithm of the longest path. A node's smallest neighbour is aggregated with a map-side combine and joined
    back, so a hot node's neighbours never meet in one task; each step is written to the shared folder.
    """
    e = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def settled() -> bool:
        """Every node has one edge at most, and no edge leads to a node that has one."""
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(e.select("v", F.lit(0), F.lit(1)))
        return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR out > 0 AND into > 0").isEmpty()

    while not settled():
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = saved(e.join(low, F.col("v") == F.col("w")).select("u", F.col("m").alias("v")).distinct())
        low = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = saved(small.union(low.select("w", "m")).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select("v", "v").distinct())


def connected_components(nodes: DataFrame, edges: DataFrame, types: Sequence[str] = ()) -> DataFrame:
    """(id, component): the smallest id of each id's undirected component, isolated nodes included.

    Ids are numbered once; the steps of :func:`star_components` move numbers alone.
    """
    e = edges.where(F.col("type").isin(*types)) if types else edges
    e = saved(e.where("src <> dst").select("src", "dst").distinct())
    ids = saved(e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().withColumn("n", F.monotonically_increasing_id()))
    numbered = e.join(ids.select(F.col("id").alias("src"), F.col("n").alias("a")), "src").join(ids.select(F.col("id").alias("dst"), F.col("n").alias("b")), "dst")
    found = saved(ids.join(star_components(numbered.select("a", "b")), F.col("n") == F.col("node")).select("id", "label"))
    first = found.groupBy("label").agg(F.min("id").alias("component"))
    return nodes.select("id").join(found.join(first, "label").select("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
