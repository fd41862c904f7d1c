"""Selections over nodes and edges. Predicates reach the scan: no UDF, no cache in front of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import AMBIGUOUS, CODE_DOC_EDGES, INFERRED, STRUCTURAL_EDGES, Graph, attr

SYSTEM_TYPES = ("repository", "service", "system")


def filter_edges(edges: DataFrame, node_id: str = "", src: str = "", dst: str = "", type: str = "", types: Sequence[str] = (), limit: int = 0) -> DataFrame:
    """(src, dst, type, confidence) of the edges that pass every filter given; ``type`` is added to ``types``.

    With a limit the first by (src, dst, type), and a column ``truncated``: true when as many as the limit are found.
    """
    out = edges
    if node_id:
        out = out.where((F.col("src") == node_id) | (F.col("dst") == node_id))
    if src:
        out = out.where(F.col("src") == src)
    if dst:
        out = out.where(F.col("dst") == dst)
    wanted = sorted({*types, *([type] if type else [])})
    if wanted:
        out = out.where(F.col("type").isin(*wanted))
    out = out.select("src", "dst", "type", "confidence")
    if limit <= 0:
        return out
    first = out.orderBy("src", "dst", "type").limit(limit)
    enough = first.agg((F.count(F.lit(1)) >= limit).alias("truncated"))  # one row
    return first.crossJoin(enough)


def partial_matches(nodes: DataFrame, query: str, limit: int = 10, ignore_case: bool = False) -> DataFrame:
    """Ids that contain the query; an empty query matches nothing."""
    if not query:
        return nodes.select("id").where(F.lit(False))
    found = F.lower("id").contains(query.lower()) if ignore_case else F.col("id").contains(query)
    return nodes.where(found).select("id").orderBy("id").limit(limit)


def seed_nodes(nodes: DataFrame, query: str, limit: int = 5) -> DataFrame:
    q = query.lower()
    return nodes.where(F.lower("label").contains(q) | F.lower("id").contains(q)).select("id", "label", "type").orderBy("id").limit(limit)


def get_node(nodes: DataFrame, key: str) -> DataFrame:
    """The node of this id, else the first whose id or label equals it but for case; at most one row."""
    low = key.lower()
    found = nodes.where((F.col("id") == key) | (F.lower("id") == low) | (F.lower("label") == low))
    return found.orderBy(F.col("id") != key, "id").limit(1)


def ambiguous_edges(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("confidence") == AMBIGUOUS)


def inferred_edges(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("confidence") == INFERRED)


def low_confidence_edges(edges: DataFrame, threshold: float) -> DataFrame:
    return inferred_edges(edges).where((F.col("confidence_score") > 0) & (F.col("confidence_score") < threshold))


def is_structural(kind: Column) -> Column:
    return kind.isin(*STRUCTURAL_EDGES)


def is_code_doc(kind: Column) -> Column:
    return kind.isin(*CODE_DOC_EDGES)


def is_file_hub(node_type: Column, external: Column) -> Column:
    return node_type.isin("file", "package") | (external == "true")


def without_ids(df: DataFrame, column: str = "id", prefixes: Sequence[str] = (), substrings: Sequence[str] = ()) -> DataFrame:
    for p in prefixes:
        df = df.where(~F.col(column).startswith(p))
    for s in substrings:
        df = df.where(~F.col(column).contains(s))
    return df


def _touching(edges: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Edges whose both ends pass a semi or anti join with ``ids`` (id)."""
    for end in ("src", "dst"):
        edges = edges.join(ids.select(F.col("id").alias(end)), end, how)
    return edges.select("src", "dst", "type", "confidence", "confidence_score", "attrs")


def inside(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges of the subgraph that ``ids`` (id) induce."""
    return _touching(edges, ids, "left_semi")


def without_infrastructure(g: Graph) -> Graph:
    """Without chart and module nodes, the edges at them, and edges that deploy or manage."""
    infra = F.col("type").isin("helm_chart", "terraform_module") | F.col("id").startswith("helm:") | F.col("id").startswith("terraform:")
    edges = g.edges.where(~F.col("type").isin("deploys", "manages") & ~_is_infra_id("src") & ~_is_infra_id("dst"))
    return Graph(g.nodes.where(~infra), _touching(edges, g.nodes.where(infra).select("id"), "left_anti"))


def _is_infra_id(column: str) -> Column:
    return F.col(column).startswith("helm:") | F.col(column).startswith("terraform:")


def subgraph_by_path(g: Graph, path: str) -> Graph:
    """Nodes whose source file begins with the path or whose id contains it, and the edges among them; all for an empty path."""
    if not path:
        return g
    bare = path.rstrip("/")
    own = g.nodes.where(attr("source_file").startswith(bare) | F.col("id").contains(bare))
    return Graph(own, inside(g.edges, own.select("id")))


def system_subgraph(g: Graph) -> Graph:
    own = F.col("type").isin(*SYSTEM_TYPES)
    for p in ("repo:", "svc:", "system:"):
        own = own | F.col("id").startswith(p)
    nodes = g.nodes.where(own)
    return Graph(nodes, inside(g.edges, nodes.select("id")))


def has_system_node(nodes: DataFrame) -> bool:
    return not nodes.where((F.col("type") == "system") | F.col("id").startswith("system:")).limit(1).isEmpty()
