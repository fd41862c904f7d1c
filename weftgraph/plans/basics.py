"""Queries of scans, filters, counts, joins, set operations and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import Graph, attr
from ..operators import aggregates as A
from ..operators import filters as W
from ..operators import joins as J
from ..sources import projections as P
from .registry import query


@query("SELECT id, type, label, package, source_file, signature FROM nodes")
def scan_nodes(spark: SparkSession, d: str) -> DataFrame:
    return P.commerce_nodes(spark, d).select("id", "type", "label", attr("package").alias("package"), attr("source_file").alias("source_file"), attr("signature").alias("signature"))


@query("SELECT src, dst, type, confidence, score AS confidence_score FROM edges")
def scan_edges(spark: SparkSession, d: str) -> DataFrame:
    return P.commerce_edges(spark, d).drop("attrs")


@query("SELECT src, dst, type, confidence FROM edges WHERE src = 'order:7' OR dst = 'order:7'")
def filter_edges_node(spark: SparkSession, d: str) -> DataFrame:
    return W.filter_edges(P.commerce_edges(spark, d), node_id="order:7")


@query("SELECT src, dst, type, confidence FROM edges WHERE src = 'customer:3'")
def filter_edges_from(spark: SparkSession, d: str) -> DataFrame:
    return W.filter_edges(P.commerce_edges(spark, d), src="customer:3")


@query("SELECT src, dst, type, confidence FROM edges WHERE dst = 'supplier:4'")
def filter_edges_to(spark: SparkSession, d: str) -> DataFrame:
    return W.filter_edges(P.commerce_edges(spark, d), dst="supplier:4")


@query("SELECT src, dst, type, confidence FROM edges WHERE type = 'calls'")
def filter_edges_type(spark: SparkSession, d: str) -> DataFrame:
    return W.filter_edges(P.commerce_edges(spark, d), type="calls")


@query("SELECT src, dst, type, confidence FROM edges WHERE type IN ('calls', 'imports', 'contains')")
def filter_edges_types(spark: SparkSession, d: str) -> DataFrame:
    return W.filter_edges(P.commerce_edges(spark, d), type="calls", types=("imports", "contains"))


@query("SELECT src, dst, type, confidence FROM edges WHERE (src = 'order:7' OR dst = 'order:7') AND type = 'uses'")
def filter_edges_combined(spark: SparkSession, d: str) -> DataFrame:
    return W.filter_edges(P.commerce_edges(spark, d), node_id="order:7", type="uses")


@query("SELECT src, dst, type, confidence, true AS truncated FROM edges WHERE type = 'contains' ORDER BY src, dst, type LIMIT 12")
def filter_edges_limit(spark: SparkSession, d: str) -> DataFrame:
    return W.filter_edges(P.commerce_edges(spark, d), type="contains", limit=12)


@query("SELECT id FROM nodes WHERE contains(id, 'order:10') ORDER BY id LIMIT 10")
def partial_match(spark: SparkSession, d: str) -> DataFrame:
    return W.partial_matches(P.commerce_nodes(spark, d), "order:10")


@query("SELECT id FROM nodes WHERE contains(lower(id), 'nation:1') ORDER BY id LIMIT 5")
def partial_match_ci(spark: SparkSession, d: str) -> DataFrame:
    return W.partial_matches(P.commerce_nodes(spark, d), "NATION:1", 5, ignore_case=True)


@query("SELECT id, label, type FROM nodes WHERE contains(lower(label), 'order_12') OR contains(lower(id), 'order_12') ORDER BY id LIMIT 5")
def seed_nodes(spark: SparkSession, d: str) -> DataFrame:
    return W.seed_nodes(P.commerce_nodes(spark, d), "ORDER_12")


@query("SELECT id, type, label FROM nodes WHERE lower(label) = 'order_5' OR lower(id) = 'order_5' ORDER BY id LIMIT 1")
def get_node(spark: SparkSession, d: str) -> DataFrame:
    return W.get_node(P.commerce_nodes(spark, d), "Order_5").select("id", "type", "label")


@query("SELECT src, dst, type FROM edges WHERE confidence = 'AMBIGUOUS'")
def ambiguous_edges(spark: SparkSession, d: str) -> DataFrame:
    return W.ambiguous_edges(P.commerce_edges(spark, d)).select("src", "dst", "type")


@query("SELECT src, dst, score AS confidence_score FROM edges WHERE confidence = 'INFERRED' AND score > 0 AND score < 0.7")
def low_confidence_edges(spark: SparkSession, d: str) -> DataFrame:
    return W.low_confidence_edges(P.commerce_edges(spark, d), 0.7).select("src", "dst", "confidence_score")


@query("SELECT src, dst, type FROM edges WHERE confidence = 'INFERRED'")
def inferred_edges(spark: SparkSession, d: str) -> DataFrame:
    return W.inferred_edges(P.commerce_edges(spark, d)).select("src", "dst", "type")


def _with_infrastructure(spark: SparkSession, d: str) -> Graph:
    """Suppliers as modules, regions as charts."""
    g = P.commerce(spark, d)
    kind = F.when(F.col("id").startswith("supplier:"), "terraform_module").when(F.col("id").startswith("region:"), "helm_chart").otherwise(F.col("type"))
    return Graph(g.nodes.withColumn("type", kind), g.edges)


@query("SELECT src, dst, type FROM edges WHERE NOT (src LIKE 'supplier:%' OR dst LIKE 'supplier:%' OR src LIKE 'region:%' OR dst LIKE 'region:%')")
def filter_iac(spark: SparkSession, d: str) -> DataFrame:
    return W.without_infrastructure(_with_infrastructure(spark, d)).edges.select("src", "dst", "type")


@query(
    """=> SELECT src, dst, type FROM edges WHERE src IN (SELECT id FROM nodes WHERE starts_with(source_file, 'F') OR contains(id, 'F')) AND dst IN (SELECT id FROM nodes WHERE starts_with(source_file, 'F') OR contains(id, 'F'))"""
)
def subgraph_by_path(spark: SparkSession, d: str) -> DataFrame:
    return W.subgraph_by_path(P.commerce(spark, d), "F/").edges.select("src", "dst", "type")


@query("own AS (SELECT id FROM nodes WHERE type IN ('file', 'interface')) => SELECT src, dst, type FROM edges WHERE src IN (FROM own) AND dst IN (FROM own)")
def system_subgraph(spark: SparkSession, d: str) -> DataFrame:
    g = P.commerce(spark, d)
    kind = F.when(F.col("type") == "file", "system").when(F.col("type") == "interface", "service").otherwise(F.col("type"))
    return W.system_subgraph(Graph(g.nodes.withColumn("type", kind), g.edges)).edges.select("src", "dst", "type")


@query("SELECT 'doc:' || doc_id AS id, floor(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')), 0) * 1.3)::BIGINT AS tokens FROM documents", graph="")
def doc_tokens_words(spark: SparkSession, d: str) -> DataFrame:
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^ \t\n\r\f\x0B]+")), F.lit(0))
    return P.read(spark, d, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), F.floor(words * F.lit(1.3).cast("double")).cast("bigint").alias("tokens"))


@query("SELECT id, label || ' ' || doc || ' ' || package || ' ' || signature || ' ' || id AS all_text FROM nodes")
def search_docs(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.search import search_docs as docs

    return docs(P.commerce_nodes(spark, d)).select("id", "all_text")


@query("SELECT type, count(*) AS n FROM nodes GROUP BY type")
def node_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.node_type_counts(P.commerce_nodes(spark, d))


@query("SELECT type, count(*) AS n FROM edges GROUP BY type")
def edge_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.edge_type_counts(P.commerce_edges(spark, d))


@query("SELECT confidence, count(*) AS n FROM edges GROUP BY confidence")
def confidence_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.confidence_counts(P.commerce_edges(spark, d))


@query("SELECT type, string_agg(src || '|' || dst, ',' ORDER BY src || '|' || dst) AS edges FROM edges GROUP BY type", graph="code")
def edges_by_type(spark: SparkSession, d: str) -> DataFrame:
    return A.edges_joined(P.code(spark, d).edges)


@query("SELECT confidence, string_agg(src || '|' || dst, ',' ORDER BY src || '|' || dst) AS edges FROM edges GROUP BY confidence", graph="code")
def edges_by_confidence(spark: SparkSession, d: str) -> DataFrame:
    return A.edges_joined(P.code(spark, d).edges, "confidence")


DEGREES = "deg AS (SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(*) AS degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY id)"


@query(DEGREES + " => SELECT * FROM deg")
def degrees(spark: SparkSession, d: str) -> DataFrame:
    return A.degrees(P.commerce_edges(spark, d))


@query(DEGREES + " => SELECT id, label, type, in_degree, out_degree, degree FROM deg JOIN nodes USING (id) WHERE type NOT IN ('file', 'package') ORDER BY degree DESC, id LIMIT 10")
def god_nodes(spark: SparkSession, d: str) -> DataFrame:
    return A.god_nodes(P.commerce(spark, d))


@query(DEGREES + " => SELECT id, label, type, in_degree, out_degree, degree FROM deg JOIN nodes USING (id) WHERE type NOT IN ('file', 'package')")
def god_nodes_all(spark: SparkSession, d: str) -> DataFrame:
    return A.god_nodes(P.commerce(spark, d), top=None)


@query(DEGREES + " => SELECT id, degree FROM deg WHERE NOT starts_with(id, 'call_') ORDER BY degree DESC, id LIMIT 10", graph="dangling")
def god_nodes_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.summary_god_nodes(P.commerce(spark, d, without_pending=True))


@query(DEGREES + " => SELECT id, label, type, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN deg USING (id) WHERE type NOT IN ('file', 'package') AND coalesce(degree, 0) <= 3")
def isolated_nodes(spark: SparkSession, d: str) -> DataFrame:
    return A.isolated_nodes(P.commerce(spark, d), threshold=3)


SUMMARY = """=> SELECT 'total' AS section, 'nodes' AS name, count(*) AS n FROM nodes UNION ALL SELECT 'total', 'edges', count(*) FROM edges
UNION ALL SELECT 'node_type', type, count(*) FROM nodes GROUP BY type UNION ALL SELECT 'edge_type', type, count(*) FROM edges GROUP BY type
UNION ALL SELECT 'confidence', confidence, count(*) FROM edges GROUP BY confidence"""


@query(SUMMARY)
def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.graph_summary(P.commerce(spark, d))


@query(SUMMARY, graph="code")
def report_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.graph_summary(P.code(spark, d))


@query(
    """named AS (SELECT id, type, regexp_replace(CASE WHEN package <> '' THEN package WHEN type = 'package' THEN id END, '^pkg_', '') AS name, regexp_replace(package, '^pkg_', '') AS package FROM nodes),
    imp AS (SELECT n.package AS name, count(*) AS imports FROM edges e JOIN named n ON e.src = n.id WHERE e.type = 'imports' GROUP BY n.package)
    => SELECT name, count(*) FILTER (type = 'file') AS files, count(*) FILTER (type IN ('function', 'method')) AS functions, count(*) FILTER (type IN ('struct', 'interface')) AS types,
      coalesce(max(imports), 0) AS imports FROM named LEFT JOIN imp USING (name) WHERE name IS NOT NULL GROUP BY name"""
)
def package_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.package_stats(P.commerce(spark, d))


@query("SELECT package, count(*) AS items FROM (SELECT split_part(id, '.', 1) AS package FROM (SELECT replace(id, ':', '.') AS id, type FROM nodes) WHERE type IN ('function', 'method', 'struct', 'interface')) GROUP BY package")
def package_overview(spark: SparkSession, d: str) -> DataFrame:
    return A.package_overview(P.commerce_nodes(spark, d).withColumn("id", F.replace("id", F.lit(":"), F.lit("."))))


@query("SELECT type, count(*) AS n FROM (SELECT type FROM edges WHERE src = 'nation:3' UNION ALL SELECT type FROM edges WHERE dst = 'nation:3') GROUP BY type")
def edge_type_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return A.edge_type_breakdown(P.commerce_edges(spark, d), "nation:3")


@query("SELECT 'type' AS section, type AS name, count(*) AS n FROM edges WHERE confidence <> 'EXTRACTED' GROUP BY type UNION ALL SELECT 'confidence', confidence, count(*) FROM edges WHERE confidence <> 'EXTRACTED' GROUP BY confidence")
def semantic_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return A.semantic_breakdown(P.commerce_edges(spark, d))


GRAPH_TOKENS = """tok AS (SELECT (SELECT count(*) FROM nodes) AS graph_nodes, (SELECT count(*) FROM edges) AS graph_edges,
  ((SELECT sum(5 + CASE WHEN label = '' THEN 0 ELSE floor(1.5 * (1 + length(label) - length(translate(label, '_-./', '')))) END + 3 * n_attrs) FROM nodes) + (SELECT sum(8) FROM edges))::BIGINT AS graph_tokens)"""


@query(GRAPH_TOKENS + " => SELECT * FROM tok")
def graph_tokens(spark: SparkSession, d: str) -> DataFrame:
    return A.graph_tokens(P.commerce(spark, d))


TOKENS = r"floor(1.5 * len(regexp_extract_all(text, '[\p{L}\p{Nd}_]+'))) + len(regexp_extract_all(text, '\p{P}')) // 2"


@query(f"SELECT doc_id, coalesce({TOKENS}, 0)::BIGINT AS tokens FROM documents", graph="")
def document_tokens(spark: SparkSession, d: str) -> DataFrame:
    return P.read(spark, d, "documents").select("doc_id", S.estimate_tokens(F.col("text")).alias("tokens"))


def _corpus_tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = P.read(spark, d, "documents")
    return docs.agg(F.count(F.lit(1)).alias("files"), F.sum(S.estimate_tokens(F.col("text"))).alias("source_tokens"))


@query(f"SELECT count(*) AS files, sum(coalesce({TOKENS}, 0))::BIGINT AS source_tokens FROM documents", graph="")
def corpus_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _corpus_tokens(spark, d)


HEALTH = f"""{GRAPH_TOKENS}, src AS (SELECT count(*) AS files, sum(coalesce({TOKENS}, 0))::BIGINT AS t FROM documents),
h AS (SELECT *, CASE WHEN t > 0 THEN t ELSE files * 500 END::BIGINT AS estimated_tokens FROM tok, src),
r AS (SELECT *, CASE WHEN estimated_tokens > 0 THEN greatest(0.0::DOUBLE, (estimated_tokens - graph_tokens)::DOUBLE / estimated_tokens * 100) ELSE 0.0 END AS token_reduction, graph_edges::DOUBLE / graph_nodes AS d FROM h)"""


@query(
    HEALTH
    + """ => SELECT files, graph_nodes, graph_edges, graph_tokens, estimated_tokens, floor(estimated_tokens * 0.7::DOUBLE)::BIGINT AS word_count, token_reduction,
    CASE WHEN graph_nodes < 10 OR graph_edges < 5 THEN 'limited' WHEN d < 0.3 THEN 'marginal' WHEN token_reduction >= 50 THEN 'valuable' WHEN token_reduction >= 10 THEN 'marginal' ELSE 'limited' END AS verdict FROM r"""
)
def corpus_health(spark: SparkSession, d: str) -> DataFrame:
    return A.corpus_health(P.commerce(spark, d), _corpus_tokens(spark, d))


@query(HEALTH + " => SELECT estimated_tokens, graph_tokens, estimated_tokens::DOUBLE / graph_tokens AS ratio FROM r")
def token_reduction(spark: SparkSession, d: str) -> DataFrame:
    h = A.corpus_health(P.commerce(spark, d), _corpus_tokens(spark, d))
    return h.select("estimated_tokens", "graph_tokens", (F.col("estimated_tokens") / F.col("graph_tokens")).alias("ratio"))


@query("SELECT e.src, e.dst, e.type, a.source_file AS src_source_file, b.source_file AS dst_source_file FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.source_file <> '' AND b.source_file <> '' AND a.source_file <> b.source_file")
def cross_file_edges(spark: SparkSession, d: str) -> DataFrame:
    return J.cross_file_edges(P.commerce(spark, d))


@query("SELECT src, dst, type, a.community_id AS src_community, b.community_id AS dst_community FROM edges JOIN communities a ON a.node_id = src JOIN communities b ON b.node_id = dst WHERE a.community_id <> b.community_id")
def bridge_edges(spark: SparkSession, d: str) -> DataFrame:
    return J.bridge_edges(P.commerce_edges(spark, d), P.commerce_communities(spark, d))


@query("SELECT DISTINCT x.id, split_part(x.id, ':', 2) AS label, 'unknown' AS type FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) x WHERE x.id NOT IN (SELECT id FROM nodes)", graph="dangling")
def placeholder_nodes(spark: SparkSession, d: str) -> DataFrame:
    return J.placeholders(P.commerce(spark, d, without_pending=True))


@query(
    P.SEMANTIC_SQL
    + """, f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ordinal) AS rn FROM sem_nodes)
    => SELECT id, type, label FROM nodes UNION ALL SELECT id, type, label FROM f WHERE rn = 1 AND id NOT IN (SELECT id FROM nodes)"""
)
def merge_nodes(spark: SparkSession, d: str) -> DataFrame:
    return J.merge_nodes(P.commerce_nodes(spark, d), P.commerce_semantic(spark, d)[0]).select("id", "type", "label")


@query(
    P.SEMANTIC_SQL
    + """, f AS (SELECT *, row_number() OVER (PARTITION BY src, dst, type ORDER BY ordinal) AS rn FROM sem_edges)
    => SELECT src, dst, type, confidence, score AS confidence_score, '' AS source FROM edges
    UNION ALL SELECT src, dst, type, CASE confidence WHEN 'AMBIGUOUS' THEN 'AMBIGUOUS' ELSE 'INFERRED' END, score, 'llm' FROM f
      WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = f.src AND e.dst = f.dst AND e.type = f.type)"""
)
def merge_edges(spark: SparkSession, d: str) -> DataFrame:
    merged = J.merge_edges(P.commerce_edges(spark, d), P.commerce_semantic(spark, d)[1])
    return merged.select("src", "dst", "type", "confidence", "confidence_score", attr("source").alias("source"))


@query(
    P.SEMANTIC_SQL
    + """ => SELECT ordinal, problem FROM (SELECT ordinal, CASE WHEN confidence = 'EXTRACTED' THEN 'an inferred edge can''t be EXTRACTED' WHEN score < 0 OR score > 1 THEN 'score out of range' END AS problem FROM sem_edges)
    WHERE problem IS NOT NULL"""
)
def semantic_violations(spark: SparkSession, d: str) -> DataFrame:
    return J.semantic_violations(P.commerce_semantic(spark, d)[1])


OLD, NEW = "o_orderdate < timestamp_ntz'2000-08-07'", "o_orderdate >= timestamp_ntz'1995-12-26'"


def _diff(spark: SparkSession, d: str, part: str) -> DataFrame:
    return J.diff(P.commerce(spark, d, orders_where=OLD), P.commerce(spark, d, orders_where=NEW))[part]


_ADDED = "gone AS (SELECT 'order:' || o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '2000-08-07')"
_REMOVED = "gone AS (SELECT 'order:' || o_orderkey AS id FROM orders WHERE o_orderdate < TIMESTAMP '1995-12-26')"


@query(_ADDED + " => SELECT id, type, label FROM nodes WHERE id IN (FROM gone)")
def diff_new_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d, "new_nodes")


@query(_REMOVED + " => SELECT id, type, label FROM nodes WHERE id IN (FROM gone)")
def diff_removed_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d, "removed_nodes")


@query(_ADDED + " => SELECT src, dst, type FROM edges WHERE src IN (FROM gone) OR dst IN (FROM gone)")
def diff_new_edges(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d, "new_edges")


@query(_REMOVED + " => SELECT src, dst, type FROM edges WHERE src IN (FROM gone) OR dst IN (FROM gone)")
def diff_removed_edges(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d, "removed_edges")


@query(P.EVENTS_SQL.replace("\nnodes AS", "\nnodes2 AS").replace("\nedges AS", "\nedges2 AS") + " => SELECT src, dst, type FROM edges UNION SELECT src, dst, type FROM edges2")
def multi_source_union(spark: SparkSession, d: str) -> DataFrame:
    g = P.commerce(spark, d)
    return J.union_graphs(g, P.events(spark, d), g).edges.select("src", "dst", "type")


@query("SELECT id, ((row_number() OVER (ORDER BY id) - 1) // 25)::BIGINT AS chunk FROM nodes")
def chunk_files(spark: SparkSession, d: str) -> DataFrame:
    return J.chunk(P.commerce_nodes(spark, d).select("id"), 25, "id")


@query(DEGREES + " => SELECT type, id, degree, rank FROM (SELECT type, id, degree, row_number() OVER (PARTITION BY type ORDER BY degree DESC, id) AS rank FROM deg JOIN nodes USING (id)) WHERE rank <= 5")
def topk_per_layer(spark: SparkSession, d: str) -> DataFrame:
    own = A.node_degrees(P.commerce(spark, d)).select("type", "id", "degree")
    return A.topk_per_group(own, "type", 5, F.desc("degree"), "id")


@query(
    """p AS (SELECT page_id, lower(url) AS low, regexp_extract(lower(url), '[^/]*$') AS base FROM pages),
    f AS (SELECT *, CASE WHEN contains(low, '/') THEN left(low, length(low) - length(base) - 1) ELSE '.' END AS folder FROM p)
    => SELECT page_id, CASE WHEN base IN ('readme', 'readme.md') THEN 'readme' WHEN base IN ('changelog', 'changelog.md') THEN 'changelog' WHEN base = 'contributing.md' THEN 'contributing'
      WHEN base IN ('license', 'license.md') THEN 'license' WHEN regexp_matches(folder, 'docs|documentation') THEN 'documentation' WHEN regexp_matches(base, 'spec|rfc') THEN 'specification'
      WHEN regexp_matches(base, 'design|architecture') THEN 'architecture' WHEN contains(base, 'api') THEN 'api_reference' ELSE 'general' END AS doc_type FROM f""",
    graph="",
)
def doc_type(spark: SparkSession, d: str) -> DataFrame:
    return P.read(spark, d, "pages").select("page_id", S.classify_doc(F.col("url")).alias("doc_type"))
