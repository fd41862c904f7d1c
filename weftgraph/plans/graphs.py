"""Queries of traversals, communities, centrality, insights, detectors, reuse, search and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import Graph, attr
from ..operators import centrality as C
from ..operators import communities as K
from ..operators import insights as I
from ..operators import patterns as D
from ..operators import reuse as R
from ..operators import search as X
from ..operators import traversal as T
from ..operators.filters import inside
from ..sinks import cypher, cytoscape, graphml, toon, vault
from ..sources import projections as P
from .basics import DEGREES
from .registry import SQL, query

OUT = "SELECT src AS tail, dst AS head, type FROM edges"
BACK = "SELECT dst AS tail, src AS head, type FROM edges"


def _walk(start: str, depth: int, arcs: str) -> str:
    return f"""arcs AS ({arcs}),
    walk AS (SELECT id, 0 AS depth FROM nodes WHERE {start} UNION SELECT head, depth + 1 FROM walk JOIN arcs ON tail = id WHERE depth < {depth}),
    visited AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)"""


@query(_walk("id = 'customer:3'", 3, OUT) + " => SELECT id, depth FROM visited", recursive=True)
def bfs_out(spark: SparkSession, d: str) -> DataFrame:
    return T.bfs(P.commerce(spark, d), "customer:3", 3, "out")


@query(_walk("id = 'supplier:1'", 2, BACK) + " => SELECT id, depth FROM visited", recursive=True)
def bfs_in(spark: SparkSession, d: str) -> DataFrame:
    return T.bfs(P.commerce(spark, d), "supplier:1", 2, "in")


@query(_walk("id = 'part:5'", 2, OUT + " UNION ALL " + BACK) + " => SELECT id, depth FROM visited", recursive=True)
def bfs_both(spark: SparkSession, d: str) -> DataFrame:
    return T.bfs(P.commerce(spark, d), "part:5", 2, "both")


@query(_walk("id = 'nation:3'", 3, OUT + " WHERE type IN ('contains', 'calls')") + " => SELECT id, depth FROM visited", recursive=True)
def bfs_typed(spark: SparkSession, d: str) -> DataFrame:
    return T.bfs(P.commerce(spark, d), "nation:3", 3, "out", ("contains", "calls"))


@query(_walk("id = 'customer:3'", 2, OUT) + " => SELECT src, dst, type FROM edges JOIN visited a ON a.id = src JOIN visited b ON b.id = dst WHERE a.depth < 2", recursive=True)
def bfs_edges(spark: SparkSession, d: str) -> DataFrame:
    g = P.commerce(spark, d)
    return T.bfs_edges(g, T.bfs(g, "customer:3", 2, "out"), 2, "out")


@query(
    _walk("id = 'nation:3'", 2, OUT + " WHERE type IN ('contains', 'calls')")
    + ", r AS (SELECT *, row_number() OVER (PARTITION BY depth ORDER BY id) AS k, count(*) OVER (PARTITION BY depth) AS n FROM visited) => SELECT depth, max(n) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM r WHERE k <= 100 GROUP BY depth",
    recursive=True,
)
def bfs_layers(spark: SparkSession, d: str) -> DataFrame:
    found = T.layers(T.bfs(P.commerce(spark, d), "nation:3", 2, "out", ("contains", "calls")))
    return found.select("depth", "n", F.array_join("ids", ",").alias("ids"))


SEEDS = "id IN (SELECT id FROM nodes WHERE contains(lower(label), 'order_12') OR contains(lower(id), 'order_12') ORDER BY id LIMIT 5)"


@query(_walk(SEEDS, 2, OUT + " UNION ALL " + BACK) + " => SELECT id, depth, label, type FROM visited JOIN nodes USING (id)", recursive=True)
def query_graph_bfs(spark: SparkSession, d: str) -> DataFrame:
    return T.query_graph(P.commerce(spark, d), "order_12")[0]


@query(
    _walk(SEEDS, 2, OUT + " UNION ALL " + BACK) + " => SELECT src, dst, type, confidence FROM edges JOIN visited a ON a.id = src JOIN visited b ON b.id = dst WHERE a.depth <> b.depth",
    recursive=True,
)
def query_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return T.query_graph(P.commerce(spark, d), "order_12")[1]


# Each step of a walk from a customer leads one layer down, so that all paths to an id have one length and the first of them is the walk's.
@query(
    """walk AS (SELECT id, 0 AS depth, [id] AS path FROM nodes WHERE id = 'customer:3'
      UNION ALL SELECT dst, depth + 1, list_append(path, dst) FROM walk JOIN (SELECT DISTINCT src, dst FROM edges) ON src = id WHERE depth < 3)
    => SELECT id, min(depth)::INTEGER AS depth, (row_number() OVER (ORDER BY min(path)) - 1)::INTEGER AS position FROM walk GROUP BY id""",
    recursive=True,
)
def dfs_reach(spark: SparkSession, d: str) -> DataFrame:
    return T.dfs(P.commerce(spark, d), "customer:3", 3, "out")


@query()
def query_graph_dfs(spark: SparkSession, d: str) -> DataFrame:
    return T.dfs(P.commerce(spark, d), ["order:12", "order:120"], 1, "both")


@query(
    _walk("id = 'customer:3'", 5, OUT)
    + """, parents AS (SELECT b.id, min({'p': a.id, 't': e.type}) AS x FROM edges e JOIN visited a ON a.id = e.src JOIN visited b ON b.id = e.dst AND b.depth = a.depth + 1 GROUP BY b.id),
    back AS (SELECT id, depth, 0 AS k FROM visited WHERE id = 'supplier:7' UNION SELECT p.x.p, b.depth - 1, k + 1 FROM back b JOIN parents p ON p.id = b.id)
    => SELECT depth::INTEGER AS step, back.id, p.x.t AS via FROM back LEFT JOIN parents p ON p.id = back.id AND depth > 0""",
    recursive=True,
)
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    return T.shortest_path(P.commerce(spark, d), "customer:3", "supplier:7", "out")


@query(
    """near AS (SELECT DISTINCT dst AS id, type AS edge_type, 'out' AS direction FROM edges WHERE src = 'nation:3' UNION SELECT DISTINCT src, type, 'in' FROM edges WHERE dst = 'nation:3' AND src <> 'nation:3')
    => SELECT id, label, type, edge_type, direction FROM near JOIN nodes USING (id)"""
)
def neighbors(spark: SparkSession, d: str) -> DataFrame:
    return T.neighbors(P.commerce(spark, d), "nation:3")


COMPONENTS = """both_ways AS (SELECT src AS a, dst AS b FROM edges {where} UNION SELECT dst, src FROM edges {where}),
  cc(id, component) USING KEY (id) AS (
    SELECT id, id AS component FROM nodes
    UNION (SELECT e.a, min(u.component) FROM cc AS u JOIN both_ways e ON e.b = u.id JOIN recurring.cc AS v ON v.id = e.a WHERE u.component < v.component GROUP BY e.a))
  => SELECT id, component FROM cc"""


@query(COMPONENTS.format(where=""), recursive=True)
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    g = P.commerce(spark, d)
    return T.connected_components(g.nodes, g.edges)


@query(COMPONENTS.format(where="WHERE type IN ('contains', 'imports')"), recursive=True)
def structural_components(spark: SparkSession, d: str) -> DataFrame:
    g = P.commerce(spark, d)
    return T.connected_components(g.nodes, g.edges, ("contains", "imports"))


@query()
def louvain(spark: SparkSession, d: str) -> DataFrame:
    return K.louvain(P.commerce(spark, d))


@query(
    """e AS (SELECT a.community_id AS ca, b.community_id AS cb FROM edges JOIN communities a ON a.node_id = src JOIN communities b ON b.node_id = dst),
    k AS (SELECT c, sum(same) AS i, count(*) AS ends FROM (SELECT ca AS c, (ca = cb)::INT AS same FROM e UNION ALL SELECT cb, 0 FROM e) GROUP BY c)
    => SELECT round(sum(i)::DOUBLE / (sum(ends)::DOUBLE / 2) - sum(ends::DOUBLE * ends) / (sum(ends)::DOUBLE * sum(ends)), 9) AS modularity FROM k"""
)
def modularity(spark: SparkSession, d: str) -> DataFrame:
    return K.modularity(P.commerce_edges(spark, d), P.commerce_communities(spark, d))


COHESION = """pairs AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst),
  inner_pairs AS (SELECT a.community_id, count(*) AS inside FROM pairs JOIN communities a ON a.node_id = pairs.a JOIN communities b ON b.node_id = pairs.b WHERE a.community_id = b.community_id GROUP BY a.community_id),
  sizes AS (SELECT community_id, count(*) AS size FROM communities GROUP BY community_id),
  coh AS (SELECT community_id, size, coalesce(inside, 0) AS inside, CASE WHEN size <= 1 THEN 1.0 ELSE coalesce(inside, 0) / (size * (size - 1) / 2) END::DOUBLE AS cohesion FROM sizes LEFT JOIN inner_pairs USING (community_id))"""


@query(COHESION + " => SELECT * FROM coh")
def cohesion(spark: SparkSession, d: str) -> DataFrame:
    return K.cohesion(P.commerce_edges(spark, d), P.commerce_communities(spark, d))


@query(
    """m AS (SELECT community_id, node_id, type, label, row_number() OVER (PARTITION BY community_id ORDER BY CASE WHEN type = 'package' THEN 0 WHEN type IN ('function', 'struct') THEN 1 ELSE 2 END, node_id) AS rn
      FROM communities JOIN nodes ON id = node_id)
    => SELECT community_id, CASE WHEN label = '' THEN node_id ELSE label END AS label FROM m WHERE rn = 1"""
)
def community_labels(spark: SparkSession, d: str) -> DataFrame:
    return K.community_labels(P.commerce_communities(spark, d), P.commerce_nodes(spark, d))


@query(DEGREES + " => SELECT community_id, type, id, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY community_id, type ORDER BY coalesce(degree, 0) DESC, id)::INTEGER AS rank FROM nodes JOIN communities ON node_id = id LEFT JOIN deg USING (id)")
def community_members(spark: SparkSession, d: str) -> DataFrame:
    return K.community_members(P.commerce(spark, d), P.commerce_communities(spark, d))


@query("SELECT id, label, type, (SELECT coalesce(min(label), 'Community 2') FROM nodes JOIN communities ON node_id = id WHERE community_id = 2 AND type = 'package') AS community_label FROM nodes JOIN communities ON node_id = id WHERE community_id = 2")
def get_community(spark: SparkSession, d: str) -> DataFrame:
    return K.get_community(P.commerce_communities(spark, d), P.commerce_nodes(spark, d), 2)


def _forest_sql(kinds: str) -> str:
    """Containment makes a forest, where every two nodes have one path at most; a path never turns back."""
    return f"""own AS (SELECT id, label, type FROM nodes WHERE type IN ({kinds})),
    links AS (SELECT DISTINCT src AS a, dst AS b FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges) WHERE src IN (SELECT id FROM own) AND dst IN (SELECT id FROM own)),
    trail AS (SELECT [a, b] AS path FROM links UNION ALL SELECT list_append(path, b) FROM trail JOIN links ON a = path[-1] AND b <> path[-2]),
    inner_ids AS (SELECT unnest(path[2:-2]) AS id FROM trail WHERE len(path) > 2),
    between AS (SELECT id, label, type, count(*)::DOUBLE AS score FROM inner_ids JOIN own USING (id) GROUP BY ALL)"""


def _hierarchy(spark: SparkSession, d: str, *kinds: str) -> Graph:
    g = P.commerce(spark, d)
    nodes = g.nodes.where(F.col("type").isin(*kinds))
    return Graph(nodes, inside(g.edges, nodes.select("id")))


@query(_forest_sql("'package', 'file', 'interface', 'struct'") + " => SELECT * FROM between", recursive=True)
def betweenness(spark: SparkSession, d: str) -> DataFrame:
    return C.betweenness(_hierarchy(spark, d, "package", "file", "interface", "struct"), exclude_edges=(), exclude_nodes=())


@query(_forest_sql("'package', 'file', 'interface'") + " => SELECT * FROM between", recursive=True)
def betweenness_small(spark: SparkSession, d: str) -> DataFrame:
    return C.betweenness(_hierarchy(spark, d, "package", "file", "interface"), exclude_edges=(), exclude_nodes=())


@query()
def betweenness_rank(spark: SparkSession, d: str) -> DataFrame:
    return C.ranked(C.betweenness(P.events(spark, d), exclude_edges=(), exclude_nodes=()))


def _hits_sql(rounds: int) -> str:
    out = ["link AS (SELECT DISTINCT src, dst FROM edges)", "h0 AS MATERIALIZED (SELECT DISTINCT src AS id, 1.0::DOUBLE AS x FROM link)"]
    for r in range(rounds):
        out.append(f"a{r} AS MATERIALIZED (SELECT id, x / sqrt(sum(x * x) OVER ()) AS x FROM (SELECT dst AS id, sum(x) AS x FROM link JOIN h{r} ON id = src GROUP BY dst))")
        out.append(f"h{r + 1} AS MATERIALIZED (SELECT id, x / sqrt(sum(x * x) OVER ()) AS x FROM (SELECT src AS id, sum(x) AS x FROM link JOIN a{r} ON id = dst GROUP BY src))")
    select = f"SELECT coalesce(h.id, a.id) AS id, round(coalesce(h.x, 0), 6) AS hub, round(coalesce(a.x, 0), 6) AS authority FROM h{rounds} h FULL JOIN a{rounds - 1} a ON a.id = h.id"
    return ", ".join(out) + " => " + select


@query(_hits_sql(24), graph="events")
def hits(spark: SparkSession, d: str) -> DataFrame:
    return C.hits(P.events(spark, d).edges).select("id", F.round("hub", 6).alias("hub"), F.round("authority", 6).alias("authority"))


SURPRISE = """s AS (
  SELECT e.src, e.dst, e.type, confidence, score AS s, a.source_file <> '' AND b.source_file <> '' AND a.source_file <> b.source_file AS files, coalesce(ca.community_id <> cb.community_id, false) AS apart,
    confidence = 'INFERRED' AND score > 0 AND score < 0.7 AS unsure
  FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst LEFT JOIN communities ca ON ca.node_id = e.src LEFT JOIN communities cb ON cb.node_id = e.dst
  WHERE e.type NOT IN ('contains', 'imports') AND a.type NOT IN ('package', 'file') AND b.type NOT IN ('package', 'file')),
t AS (SELECT src, dst, type, (CASE confidence WHEN 'AMBIGUOUS' THEN 3.0 WHEN 'INFERRED' THEN 2.0 ELSE 1.0 END + CASE WHEN files THEN 2.5 ELSE 0 END + CASE WHEN apart THEN 2.0 ELSE 0 END + CASE WHEN unsure THEN 1.0 ELSE 0 END)::DOUBLE AS score,
    concat_ws('; ', CASE confidence WHEN 'AMBIGUOUS' THEN 'ambiguous' WHEN 'INFERRED' THEN 'inferred' END, CASE WHEN files THEN 'other file' END, CASE WHEN apart THEN 'other community' END, CASE WHEN unsure THEN 'low score' END) AS why FROM s)"""


@query(SURPRISE + " => SELECT * FROM t")
def surprises(spark: SparkSession, d: str) -> DataFrame:
    return I.surprises(P.commerce(spark, d), P.commerce_communities(spark, d))


@query(SURPRISE + " => SELECT * FROM t ORDER BY score DESC, src, dst, type LIMIT 10")
def surprises_top(spark: SparkSession, d: str) -> DataFrame:
    return I.surprises(P.commerce(spark, d), P.commerce_communities(spark, d), top=10)


BRIDGES = """q AS (SELECT src, dst, coalesce(a.community_id, 0) AS a, coalesce(b.community_id, 0) AS b FROM edges LEFT JOIN communities a ON a.node_id = src LEFT JOIN communities b ON b.node_id = dst),
  bridges AS (SELECT id, count(DISTINCT c) AS n_communities FROM (SELECT src AS id, a AS c FROM q UNION ALL SELECT src, b FROM q UNION ALL SELECT dst, a FROM q UNION ALL SELECT dst, b FROM q)
    WHERE id NOT IN (SELECT id FROM nodes WHERE type = 'file') GROUP BY id HAVING count(DISTINCT c) >= 2)"""


@query(BRIDGES + " => SELECT * FROM bridges")
def question_bridges(spark: SparkSession, d: str) -> DataFrame:
    return I.question_bridges(P.commerce(spark, d), P.commerce_communities(spark, d))


@query(
    """x AS (SELECT src, dst, type FROM edges WHERE confidence = 'AMBIGUOUS' ORDER BY src, dst, type LIMIT 2),
    y AS (SELECT string_agg(a.label || ' -> ' || b.label, ', ' ORDER BY src, dst) AS p FROM x JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst)
    => SELECT 'ambiguous_edges' AS kind, '' AS subject, (SELECT count(*) FROM edges WHERE confidence = 'AMBIGUOUS') AS n, 'Which of the uncertain links hold, such as ' || p || '?' AS question FROM y"""
)
def questions_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    return I.question_ambiguous(P.commerce(spark, d))


@query(
    BRIDGES
    + """, top AS (SELECT id, label, row_number() OVER (ORDER BY n_communities DESC, id) AS r FROM bridges JOIN nodes USING (id) QUALIFY r <= 3)
    => SELECT 'bridge_nodes' AS kind, '' AS subject, (SELECT count(*) FROM bridges) AS n,
      'Are ' || (SELECT string_agg(label, ', ' ORDER BY r) FROM top WHERE r < 3) || ' and ' || (SELECT label FROM top WHERE r = 3) || ' meant to join communities?' AS question"""
)
def questions_bridges(spark: SparkSession, d: str) -> DataFrame:
    return I.question_bridge_nodes(P.commerce(spark, d), P.commerce_communities(spark, d))


@query(
    """i AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM edges WHERE confidence = 'INFERRED' UNION ALL SELECT dst FROM edges WHERE confidence = 'INFERRED') GROUP BY id HAVING count(*) >= 3)
    => SELECT 'verify_inferred' AS kind, id AS subject, n, 'Do the ' || n || ' inferred links of ' || label || ' hold?' AS question FROM i JOIN nodes USING (id)"""
)
def questions_inferred(spark: SparkSession, d: str) -> DataFrame:
    return I.question_inferred(P.commerce(spark, d))


@query(
    DEGREES
    + """, iso AS (SELECT id, label FROM nodes LEFT JOIN deg USING (id) WHERE type NOT IN ('file', 'package', 'concept') AND coalesce(degree, 0) <= 1)
    => SELECT 'isolated_nodes' AS kind, '' AS subject, (SELECT count(*) FROM iso) AS n,
      'What ties ' || (SELECT CASE len(l) WHEN 1 THEN l[1] WHEN 2 THEN l[1] || ' and ' || l[2] ELSE l[1] || ', ' || l[2] || ' and ' || l[3] END FROM (SELECT list(label ORDER BY id) AS l FROM iso)) || ' to the rest?' AS question
    WHERE (SELECT count(*) FROM iso) > 0"""
)
def questions_isolated(spark: SparkSession, d: str) -> DataFrame:
    return I.question_isolated(P.commerce(spark, d))


@query(
    COHESION
    + """, names AS (SELECT community_id, arg_min(label, id) AS name FROM nodes JOIN communities ON node_id = id WHERE type = 'package' GROUP BY community_id)
    => SELECT 'low_cohesion' AS kind, community_id::VARCHAR AS subject, size AS n, 'Should ' || coalesce(name, 'Community ' || community_id) || ' be split into smaller parts?' AS question
    FROM coh LEFT JOIN names USING (community_id) WHERE size >= 5 AND cohesion < 0.15"""
)
def questions_cohesion(spark: SparkSession, d: str) -> DataFrame:
    return I.question_cohesion(P.commerce(spark, d), P.commerce_communities(spark, d))


_EVERY = " UNION ALL ".join(f"SELECT kind, subject, n, question FROM ({SQL[q]})" for q in ("questions_ambiguous", "questions_bridges", "questions_isolated", "questions_cohesion"))


@query(
    f"""every AS ({_EVERY} UNION ALL (SELECT kind, subject, n, question FROM ({SQL["questions_inferred"]}) ORDER BY n DESC, subject LIMIT 10))
    => SELECT kind, subject, n, question FROM every
    ORDER BY list_position(['ambiguous_edges', 'bridge_nodes', 'verify_inferred', 'isolated_nodes', 'low_cohesion'], kind), n DESC, subject LIMIT 10""",
    graph="",
)
def questions(spark: SparkSession, d: str) -> DataFrame:
    return I.questions(P.commerce(spark, d), P.commerce_communities(spark, d), top=10)


@query(
    """at_node AS (SELECT 'out' AS direction, dst AS id, type AS edge_type, confidence FROM edges WHERE src = 'part:5' UNION ALL SELECT 'in', src, type, confidence FROM edges WHERE dst = 'part:5'),
    r AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY id, edge_type, confidence)::INTEGER AS rank FROM at_node)
    => SELECT direction, id, label, edge_type, confidence, rank FROM r JOIN nodes USING (id) WHERE rank <= 20"""
)
def explain_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return I.explain_neighbors(P.commerce(spark, d), "part:5")


@query(
    _forest_sql("'package', 'file', 'interface'")
    + """, inner_edges AS (SELECT src, dst FROM edges WHERE src IN (SELECT id FROM own) AND dst IN (SELECT id FROM own)),
    d AS (SELECT id, count(*) AS degree, count(*) FILTER (inward) AS in_degree, count(*) FILTER (NOT inward) AS out_degree FROM (SELECT src AS id, false AS inward FROM inner_edges UNION ALL SELECT dst, true FROM inner_edges) GROUP BY id)
    => SELECT id, o.label, o.type, in_degree, out_degree, degree, degree >= (SELECT quantile_disc(degree, 0.9) FROM d) AS is_hub, c.community_id, (SELECT count(*) FROM communities x WHERE x.community_id = c.community_id) AS community_size,
      b.score, (SELECT count(*) + 1 FROM between x WHERE x.score > b.score OR x.score = b.score AND x.id < b.id) AS rank
    FROM own o JOIN d USING (id) JOIN communities c ON c.node_id = id JOIN between b USING (id) WHERE id = 'nation:3'""",
    recursive=True,
)
def explain(spark: SparkSession, d: str) -> DataFrame:
    g = _hierarchy(spark, d, "package", "file", "interface")
    return I.explain(g, "nation:3", P.commerce_communities(spark, d), C.betweenness(g, exclude_edges=(), exclude_nodes=()))


@query(DEGREES + " => SELECT id, label, type, in_degree, out_degree, community_id FROM nodes JOIN deg USING (id) JOIN communities ON node_id = id WHERE id = 'supplier:3'")
def node_detail(spark: SparkSession, d: str) -> DataFrame:
    return I.node_detail(P.commerce(spark, d), P.commerce_communities(spark, d), "supplier:3")


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("nodes", F.array_join("nodes", ","))


def _pattern_sql(kind: str, confidence: str, where: str, targets: str = "") -> str:
    own = f"""own AS (SELECT id, label, package, signature FROM nodes WHERE {where}),
      tgt AS (SELECT src AS id, string_agg(dst, ',' ORDER BY dst) AS t FROM edges WHERE type IN ({targets or "''"}) GROUP BY src)"""
    return own + f" => SELECT '{kind}' AS type, id, label AS name, ({confidence})::DOUBLE AS confidence, package AS location, id || coalesce(',' || t, '') AS nodes FROM own LEFT JOIN tgt USING (id)"


@query(_pattern_sql("factory", "0.8", "type = 'function' AND starts_with(label, 'New') AND contains(signature, ')')", "'returns', 'creates'"), graph="code")
def pat_factory(spark: SparkSession, d: str) -> DataFrame:
    return _shown(D.factories(P.code(spark, d)))


@query(
    _pattern_sql("singleton", "0.7", "type IN ('variable', 'constant') AND regexp_matches(lower(label), 'instance|default|global') AND (SELECT count(*) FROM edges WHERE dst = nodes.id) >= 3"), graph="code"
)
def pat_singleton(spark: SparkSession, d: str) -> DataFrame:
    return _shown(D.singletons(P.code(spark, d)))


@query(
    _pattern_sql(
        "handler", "CASE WHEN regexp_matches(signature, 'ResponseWriter|Request') THEN 0.95 WHEN contains(signature, 'Context') THEN 0.8 ELSE 0.6 END",
        "type IN ('function', 'method') AND regexp_matches(lower(label), 'handle|serve|endpoint|route')",
    ),
    graph="code",
)
def pat_handler(spark: SparkSession, d: str) -> DataFrame:
    return _shown(D.handlers(P.code(spark, d)))


@query(_pattern_sql("repository", "0.85", "type IN ('struct', 'interface') AND regexp_matches(lower(label), 'repo|store|dao|storage')", "'has_method', 'contains'"), graph="code")
def pat_repository(spark: SparkSession, d: str) -> DataFrame:
    return _shown(D.repositories(P.code(spark, d)))


@query(
    """f AS (SELECT o.id, o.label, o.package, string_agg(m.id, ',' ORDER BY m.id) AS t FROM nodes o JOIN edges e ON e.src = o.id AND e.type = 'has_method' JOIN nodes m ON m.id = e.dst AND contains(m.signature, o.label)
      WHERE o.type = 'struct' AND regexp_matches(lower(o.label), 'builder|options') GROUP BY ALL HAVING count(*) >= 2)
    => SELECT 'builder' AS type, id, label AS name, 0.9::DOUBLE AS confidence, package AS location, id || ',' || t AS nodes FROM f""",
    graph="code",
)
def pat_builder(spark: SparkSession, d: str) -> DataFrame:
    return _shown(D.builders(P.code(spark, d)))


@query(DEGREES + " => SELECT id, label, in_degree, out_degree, degree FROM deg JOIN nodes USING (id) WHERE degree >= 10", graph="code")
def pat_hubs(spark: SparkSession, d: str) -> DataFrame:
    return D.hub_nodes(P.code(spark, d), top=None)


@query(DEGREES + " => SELECT id, label, in_degree, out_degree, degree FROM deg JOIN nodes USING (id) WHERE degree >= 10 ORDER BY degree DESC, id LIMIT 10", graph="code")
def pat_hubs_top(spark: SparkSession, d: str) -> DataFrame:
    return D.hub_nodes(P.code(spark, d))


@query(
    """kw AS (FROM (VALUES ('presentation', 'handler|controller|api|http|grpc|rest'), ('business', 'service|usecase|domain|core|business'), ('data', 'repo|store|dao|database|db')) AS k(layer, words)),
    m AS (SELECT layer, id, row_number() OVER (PARTITION BY layer ORDER BY id)::INTEGER AS rank FROM nodes JOIN kw ON regexp_matches(lower(package), words) WHERE package <> '')
    => SELECT layer, id, rank FROM m WHERE rank <= 10 AND (SELECT count(DISTINCT layer) FROM m) >= 2""",
    graph="code",
)
def pat_layers(spark: SparkSession, d: str) -> DataFrame:
    return D.layer_members(P.code(spark, d))


@query(
    """s AS (SELECT package, count(*) AS nodes FROM nodes WHERE package <> '' GROUP BY package HAVING count(*) >= 5),
    i AS (SELECT a.package, count(*) AS inner_edges FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.package = b.package AND a.package <> '' GROUP BY a.package)
    => SELECT package, nodes, inner_edges FROM s JOIN i USING (package) WHERE inner_edges / nodes >= 2.0""",
    graph="code",
)
def pat_clusters(spark: SparkSession, d: str) -> DataFrame:
    return D.clusters(P.code(spark, d))


GOD = """god AS (SELECT o.id, o.label AS name, count(*) FILTER (e.type IN ('has_method', 'contains') AND t.type IN ('function', 'method')) AS methods, count(*) AS dependencies
  FROM nodes o JOIN edges e ON e.src = o.id LEFT JOIN nodes t ON t.id = e.dst WHERE o.type IN ('struct', 'class') GROUP BY ALL)"""


@query(GOD + " => SELECT *, CASE WHEN methods >= 30 OR dependencies >= 50 THEN 'high' ELSE 'medium' END AS severity FROM god WHERE methods >= 20 OR dependencies >= 30", graph="code")
def anti_god_object(spark: SparkSession, d: str) -> DataFrame:
    return D.god_objects(P.code(spark, d))


CYCLES = "cyc AS (SELECT DISTINCT x.src AS a, x.dst AS b FROM edges x JOIN edges y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst AND x.type IN ('calls', 'imports', 'uses') AND y.type IN ('calls', 'imports', 'uses'))"


@query(CYCLES + " => SELECT * FROM cyc", graph="code")
def anti_circular(spark: SparkSession, d: str) -> DataFrame:
    return D.circular_dependencies(P.code(spark, d))


@query(CYCLES + " => SELECT * FROM cyc", graph="events")
def anti_circular_events(spark: SparkSession, d: str) -> DataFrame:
    return D.circular_dependencies(P.events(spark, d))


DEAD = """dead AS (SELECT id, label AS name FROM nodes WHERE type IN ('function', 'method') AND lower(label) NOT IN ('main', 'init') AND NOT starts_with(lower(label), 'test') AND NOT regexp_matches(label, '^[A-Z]')
  AND id NOT IN (SELECT dst FROM edges))"""


@query(DEAD + " => SELECT * FROM dead", graph="code")
def anti_dead_code(spark: SparkSession, d: str) -> DataFrame:
    return D.dead_code(P.code(spark, d))


def _n(name: str, most: int | None = None) -> str:
    count = f"(SELECT count(*) FROM ({SQL[name]}))"
    return count if most is None else f"least({most}, {count})"


@query(
    f"""cost AS (SELECT severity FROM ({SQL["anti_god_object"]}) UNION ALL SELECT 'high' FROM range({_n("anti_circular", 10)}) UNION ALL SELECT 'low' FROM range({_n("anti_dead_code", 20)}))
    => SELECT {_n("pat_factory", 15)} + {_n("pat_singleton")} + {_n("pat_handler", 20)} + {_n("pat_repository")} + {_n("pat_builder")} + {_n("pat_hubs_top")} + {_n("pat_clusters")}
      + (SELECT count(DISTINCT layer) FROM ({SQL["pat_layers"]})) AS patterns, count(*) AS anti_patterns,
      greatest(0, 100 - coalesce(sum(CASE severity WHEN 'high' THEN 10 WHEN 'medium' THEN 5 ELSE 2 END), 0))::DOUBLE AS health_score FROM cost""",
    graph="",
)
def health_score(spark: SparkSession, d: str) -> DataFrame:
    return D.health(P.code(spark, d))


def _simple(e: str) -> str:
    base = rf"regexp_replace(regexp_replace(regexp_replace(trim({e}), '^\*', ''), '^\[\]', ''), '^.*\.', '')"
    return f"CASE lower({base}) WHEN 'context' THEN 'Context' WHEN 'ctx' THEN 'Context' WHEN 'error' THEN 'error' WHEN 'err' THEN 'error' WHEN 'string' THEN 'string' WHEN 'str' THEN 'string' WHEN 'int' THEN 'int' WHEN 'int32' THEN 'int' WHEN 'int64' THEN 'int' WHEN 'bool' THEN 'bool' ELSE {base} END"


SIGNATURES = rf"""sg AS (SELECT id, regexp_replace(signature, '^func ', '') AS s FROM nodes WHERE type IN ('function', 'method') AND signature <> ''),
  cut AS (SELECT id, s, instr(s, '(') AS a, length(s) - instr(reverse(s), ')') + 1 AS z FROM sg WHERE contains(s, '(') AND contains(s, ')')),
  ty AS (SELECT id, [{_simple("string_split_regex(trim(p), '\\s+')[-1]")} FOR p IN string_split(s[a + 1:z - 1], ',') IF trim(p) <> ''] AS ps, {_simple("s[z + 1:]")} AS r FROM cut WHERE z > a),
  norm AS (SELECT id, '(' || array_to_string(ps, ',') || ')->' || r AS pattern FROM ty WHERE len(ps) > 0 OR r <> ''),
  sim AS (SELECT pattern, count(*) AS n, string_agg(id, ',' ORDER BY id) AS nodes FROM norm GROUP BY pattern HAVING count(*) >= 2)"""


@query(SIGNATURES + " => SELECT id, pattern FROM norm", graph="code")
def normalized_signatures(spark: SparkSession, d: str) -> DataFrame:
    own = P.code(spark, d).nodes.where((F.col("type") == "function") & (attr("signature") != ""))
    return own.select("id", S.normalize_signature(attr("signature")).alias("pattern")).where("pattern <> ''")


@query(SIGNATURES + " => SELECT pattern, n, nodes FROM sim ORDER BY n DESC, pattern LIMIT 20", graph="code")
def reuse_signatures(spark: SparkSession, d: str) -> DataFrame:
    return _shown(R.similar_signatures(P.code(spark, d).nodes))


DUPLICATES = """dup AS (SELECT label AS name, count(*) AS n, array_to_string(list_sort(list(DISTINCT package) FILTER (package <> '')), ',') AS packages, count(DISTINCT package) FILTER (package <> '') AS np, string_agg(id, ',' ORDER BY id) AS nodes
  FROM nodes WHERE label <> '' AND label NOT IN ('New', 'Init', 'Close', 'Open', 'Read', 'Write', 'String', 'Error', 'Get', 'Set', 'main', 'init', 'run', 'start')
  GROUP BY label HAVING count(*) >= 2 AND count(DISTINCT package) FILTER (package <> '') >= 2)"""


@query(DUPLICATES + " => SELECT name, n, packages, nodes FROM dup")
def reuse_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return _shown(R.duplicate_names(P.commerce_nodes(spark, d), top=None)).withColumn("packages", F.array_join("packages", ","))


SHARED = """dep AS (SELECT src, string_agg(dst, ',' ORDER BY dst) AS deps, count(*) AS k FROM edges WHERE type IN ('calls', 'imports', 'uses') GROUP BY src HAVING count(*) >= 3),
  shared AS (SELECT deps, any_value(k)::INTEGER AS n_deps, string_agg(src, ',' ORDER BY src) AS nodes FROM dep GROUP BY deps HAVING count(*) >= 2)"""


@query(SHARED + " => SELECT * FROM shared", graph="events")
def reuse_shared_deps(spark: SparkSession, d: str) -> DataFrame:
    return _shown(R.shared_dependencies(P.events(spark, d).edges, top=None)).withColumn("deps", F.array_join("deps", ","))


CANDIDATES = f"""{SIGNATURES}, {DUPLICATES}, {SHARED},
  sim_top AS (SELECT * FROM sim ORDER BY n DESC, pattern LIMIT 20), dup_top AS (SELECT * FROM dup ORDER BY n DESC, name LIMIT 20), shared_top AS (SELECT * FROM shared ORDER BY n_deps DESC, string_split(deps, ',') LIMIT 10),
  candidate AS (
    SELECT 'extract_interface' AS kind, pattern AS subject, nodes, 'medium' AS priority FROM sim_top WHERE n >= 4 UNION ALL SELECT 'consolidate', name, nodes, 'low' FROM dup_top WHERE np >= 3
    UNION ALL SELECT 'extract_service', replace(deps, ',', '|'), nodes, 'high' FROM shared_top WHERE n_deps >= 5 AND len(string_split(nodes, ',')) >= 3)"""


@query(CANDIDATES + " => SELECT * FROM candidate", graph="code")
def reuse_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _shown(R.refactor_candidates(P.code(spark, d)))


@query(CANDIDATES + " => SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM sim_top) AS similar_groups, (SELECT count(*) FROM dup_top) AS duplicate_groups, (SELECT count(*) FROM candidate) AS candidates", graph="code")
def reuse_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.reuse_summary(P.code(spark, d))


_STOP = "(" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + ")"
_TERMS = rf"""tokens AS (SELECT id, t AS term FROM (SELECT id, unnest(regexp_extract_all(lower(label || ' ' || coalesce(doc, '') || ' ' || package || ' ' || signature || ' ' || id || ' ' || source_file || '  ' || type), '[\p{{L}}\p{{Nd}}_]+')) AS t FROM nodes) WHERE t NOT IN {_STOP}),
  lens AS (SELECT id, count(*) AS length FROM tokens GROUP BY id),
  hits AS (SELECT term, id, count(*) AS tf FROM tokens WHERE {{cond}} GROUP BY term, id),
  dfs AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
  found AS (SELECT h.id, round(sum(sqrt(tf) * (1 + ln((SELECT count(*) FROM nodes) / (1 + df))) / sqrt(length)), 6) AS score FROM hits h JOIN dfs USING (term) JOIN lens USING (id) GROUP BY h.id)"""
WORDS = "tion mentoiier"


def _terms(cond: str) -> str:
    return _TERMS.replace("{cond}", cond)


@query(_terms("term IN ('tion', 'mentoiier')") + " => SELECT id, type, score FROM found JOIN nodes USING (id)", graph="corpus")
def search_match(spark: SparkSession, d: str) -> DataFrame:
    return X.match(X.build(P.corpus(spark, d).nodes), WORDS).select("id", "type", "score")


@query(_terms("levenshtein(regexp_replace(term, '[^\\x00-\\x7F]', '#', 'g'), 'tion') <= 1") + " => SELECT id, type, score FROM found JOIN nodes USING (id)", graph="corpus")
def search_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return X.fuzzy(X.build(P.corpus(spark, d).nodes), "tion", 1).select("id", "type", "score")


@query(_terms("term IN ('tion', 'mentoiier')") + " => SELECT id, type, score FROM found JOIN nodes USING (id) WHERE type IN ('en', 'fr')", graph="corpus")
def search_typed(spark: SparkSession, d: str) -> DataFrame:
    return X.match(X.build(P.corpus(spark, d).nodes), WORDS, ("en", "fr")).select("id", "type", "score")


@query(
    _terms("term IN ('tion', 'mentoiier')")
    + """ => SELECT id, type, label, score, CASE WHEN length(doc) > 150 THEN substring(doc, 1, 150) || '...' ELSE doc END AS snippet, (SELECT count(*) FROM found) AS total, (SELECT count(*) FROM found) > 25 AS truncated
    FROM found JOIN nodes USING (id) ORDER BY score DESC, id LIMIT 20 OFFSET 5""",
    graph="corpus",
)
def search_page(spark: SparkSession, d: str) -> DataFrame:
    return X.page(X.match(X.build(P.corpus(spark, d).nodes), WORDS), 20, 5)


@query(_terms("term IN ('tion', 'mentoiier')") + " => SELECT type, count(*) AS n FROM found JOIN nodes USING (id) GROUP BY type ORDER BY n DESC, type LIMIT 10", graph="corpus")
def search_facets(spark: SparkSession, d: str) -> DataFrame:
    return X.facets(X.match(X.build(P.corpus(spark, d).nodes), WORDS))


@query(_terms("true") + " => SELECT (SELECT count(*) FROM nodes) AS docs, count(DISTINCT term) AS terms, count(*) AS postings FROM hits")
def search_stats(spark: SparkSession, d: str) -> DataFrame:
    return X.stats(X.build(P.commerce_nodes(spark, d)))


@query("SELECT type, id, CASE WHEN label = '' OR label = id THEN NULL ELSE label END AS label, nullif(package, '') AS package, nullif(source_file, '') AS file FROM nodes")
def toon_nodes(spark: SparkSession, d: str) -> DataFrame:
    return toon.node_rows(P.commerce_nodes(spark, d))


@query("SELECT type, src AS \"from\", dst AS \"to\", CASE WHEN confidence NOT IN ('', 'EXTRACTED') THEN confidence END AS confidence, CASE WHEN confidence NOT IN ('', 'EXTRACTED') AND score > 0 THEN score END AS confidence_score FROM edges")
def toon_edges(spark: SparkSession, d: str) -> DataFrame:
    return toon.edge_rows(P.commerce_edges(spark, d))


@query(
    """ends AS (SELECT DISTINCT id FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) WHERE id NOT IN (SELECT id FROM nodes))
    => SELECT 'nodes' AS element, id, label, type, false AS placeholder, NULL::VARCHAR AS source, NULL::VARCHAR AS target FROM nodes UNION ALL SELECT 'nodes', id, split_part(id, ':', 2), 'unknown', true, NULL, NULL FROM ends
    UNION ALL SELECT 'edges', src || '->' || dst || ':' || type, NULL, type, false, src, dst FROM edges""",
    graph="dangling",
)
def cyto_elements(spark: SparkSession, d: str) -> DataFrame:
    return cytoscape.elements(P.commerce(spark, d, without_pending=True))


@query("SELECT count(*) FILTER (src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)) AS written, count(*) FILTER (NOT (src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes))) AS skipped FROM edges", graph="dangling")
def graphml_edge_counts(spark: SparkSession, d: str) -> DataFrame:
    return graphml.edge_counts(P.commerce(spark, d, without_pending=True))


_Q = "replace(replace({0}, '\\', '\\\\'), '''', '\\''')"


def _prop(key: str, e: str) -> str:
    return f"CASE WHEN {e} <> '' THEN ', {key}: ''' || {_Q.format(e)} || '''' ELSE '' END"


@query(
    "SELECT id, 'CREATE (:' || upper(type[1]) || type[2:] || ':Node {id: ''' || "
    + _Q.format("id")
    + " || ''', type: ''' || type || ''''"
    + "".join(f" || {_prop(k, e)}" for k, e in (("label", "label"), ("doc", "doc"), ("package", "package"), ("path", "CASE WHEN type = 'file' THEN label ELSE '' END"), ("signature", "signature"), ("source_file", "source_file")))
    + " || '});' AS statement FROM nodes"
)
def cypher_nodes(spark: SparkSession, d: str) -> DataFrame:
    return cypher.node_statements(P.commerce_nodes(spark, d))


@query(
    """SELECT src, dst, 'MATCH (a:Node {id: ''' || src || '''}), (b:Node {id: ''' || dst || '''}) CREATE (a)-[:' || upper(type) || ' {confidence: ''' || confidence || '''' ||
    CASE WHEN score > 0 THEN ', confidence_score: ' || printf('%.6f', score) ELSE '' END || '}]->(b);' AS statement FROM edges"""
)
def cypher_edges(spark: SparkSession, d: str) -> DataFrame:
    return cypher.edge_statements(P.commerce_edges(spark, d))


@query(
    DEGREES
    + """, top AS (SELECT id, label, degree FROM deg JOIN nodes USING (id) WHERE degree >= 3 ORDER BY degree DESC, id LIMIT 20)
    => SELECT 'hub' AS page, replace(id, ':', '_') AS name, degree AS n FROM top UNION ALL SELECT 'community', 'community-' || community_id, count(*) FROM communities GROUP BY community_id"""
)
def vault_pages(spark: SparkSession, d: str) -> DataFrame:
    return vault.pages(P.commerce(spark, d), P.commerce_communities(spark, d))
