import pytest
from graphs import graph, rows
from pyspark.sql import functions as F

from weftgraph.functions import scalars as S
from weftgraph.model import Graph
from weftgraph.operators import aggregates as A
from weftgraph.operators import communities as K
from weftgraph.operators import filters as W
from weftgraph.operators import insights as I
from weftgraph.operators import joins as J
from weftgraph.operators import patterns as D
from weftgraph.operators import reuse as R
from weftgraph.operators import search as X


def one(spark, function, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string").withColumn("i", F.monotonically_increasing_id())
    return [r["y"] for r in df.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


def test_scalars(spark):
    assert one(spark, S.normalize_signature, "func handleAuth(ctx context.Context, id string) error", "func New(opts *Options) *Client", "func () error", "func f()", "", "f)(") == [
        "(Context,string)->error", "(Options)->Client", "()->error", "", "", "",
    ]
    assert one(spark, S.simplify_type, "[]*T", "*[]T", " ctx ", "int64", "a.b.C", "") == ["*T", "T", "Context", "int", "C", ""]
    assert one(spark, lambda c: S.make_id("go_func_", c), 'a/b\\c:d*e?f"g<h>i|j k.l') == ["go_func_a_b_c_d_e_f_g_h_i_j_k.l"]
    assert one(spark, S.sanitize_doc_id, "A/b-c.D e") == ["a_b_c_d_e"] and one(spark, S.compact_id, "func_pkg_a", "x_func_") == ["pkg_a", "x_func_"]
    assert one(spark, S.cypher_string, "it's \\ a\nb\r") == ["it\\'s \\\\ a\\nb\\r"]
    assert one(spark, S.cypher_label, "method_call", "", "3d", "function") == ["MethodCall", "Node", "N3d", "Function"] and one(spark, S.cypher_key, "a-b.c") == ["a_b_c"]
    assert one(spark, S.slugify, "My Service_1!") == ["my-service-1"] and one(spark, S.vault_name, "a:b/c") == ["a_b_c"]
    assert one(spark, S.estimate_tokens, "", "one two, three_four!", None) == [0, 5, 0] and one(spark, S.label_tokens, "a_b.c", "", "x") == [4, 0, 1]
    assert one(spark, lambda c: S.format_bytes(c.cast("bigint")), "5", "1536", "3145728") == ["5 B", "1.5 KB", "3.0 MB"]
    assert one(spark, lambda c: S.format_number(c.cast("bigint")), "999", "1500", "2500000") == ["999", "1.5K", "2.5M"]
    assert one(spark, lambda c: S.join_max(F.split(c, ","), 3), "a", "a,b", "a,b,c", "a,b,c,d") == ["a", "a and b", "a, b and c", "a, b, c"]
    assert one(spark, S.classify_doc, "README.md", "docs/x.md", "my-spec.md", "arch/design.txt", "api.md", "notes.md", "LICENSE") == ["readme", "documentation", "specification", "architecture", "api_reference", "general", "license"]
    assert one(spark, S.repo_name, "https://h.org/o/r.git", "h.org/o/r/") == ["r", "r"] and one(spark, S.normalize_extension, "GO", ".Ts", "") == [".go", ".ts", ""]
    assert one(spark, S.strip_fence, "x\n```json\n{}\n```\ny", "```\n[1]\n```", " {} ") == ["{}", "[1]", "{}"]


def test_filters(spark):
    g = graph(spark, [], [("a", "b", "calls"), ("b", "c", "calls"), ("a", "c", "imports"), ("d", "a", "references")])

    def n(**k):
        return W.filter_edges(g.edges, **k).count()

    assert (n(), n(node_id="a"), n(src="a"), n(type="calls"), n(types=["imports"], type="calls"), n(node_id="a", type="calls")) == (4, 3, 2, 2, 3, 1)
    cut = W.filter_edges(g.edges, limit=4).collect()
    assert len(cut) == 4 and all(r["truncated"] for r in cut) and not W.filter_edges(g.edges, limit=5).first()["truncated"]
    p = graph(spark, [(i, "function") for i in ("func_main", "func_helper", "func_process", "type_User")], [])
    assert W.partial_matches(p.nodes, "func").count() == 3 and W.partial_matches(p.nodes, "func", 2).count() == 2
    assert W.partial_matches(p.nodes, "").count() == 0 and W.partial_matches(p.nodes, "user").count() == 0 and W.partial_matches(p.nodes, "user", 5, True).count() == 1


def test_subgraphs(spark):
    at = lambda f: {"source_file": f}
    g = graph(spark, [("n1", "function", "n1", at("/home/user/api/a.go")), ("n2", "function", "n2", at("/home/user/api/b.go")), ("n3", "function", "n3", at("/home/user/web/c.go"))], [("n1", "n2", "calls"), ("n1", "n3", "calls")])
    sub = W.subgraph_by_path(g, "/home/user/api/")
    assert sub.nodes.count() == 2 and sub.edges.count() == 1 and W.subgraph_by_path(g, "").edges.count() == 2
    s = graph(spark, [("system:x", "system"), ("svc:a", "service"), ("repo:r", "repository"), ("f", "function")], [("system:x", "svc:a", "contains"), ("svc:a", "f", "contains")])
    assert W.system_subgraph(s).nodes.count() == 3 and W.system_subgraph(s).edges.count() == 1 and W.has_system_node(s.nodes) and not W.has_system_node(g.nodes)
    o = graph(spark, [("n1", "function")], [("n1", "svc:missing", "calls"), ("n1", "odd", "calls")])
    assert rows(J.placeholders(o)) == [("odd", "odd", "unknown"), ("svc:missing", "missing", "service")]
    m = graph(spark, [("svc:a", "service", "My Api")], [("svc:a", "repo:https://h.org/o/api.git", "links_to")])
    sources = spark.createDataFrame([(0, "/src/web"), (1, "/src/api"), (2, "/other/api")], "ordinal int, path string")
    assert rows(J.service_mappings(m, sources)) == [("My Api", "my-api", "https://h.org/o/api.git", "/src/api")]
    assert J.service_mappings(graph(spark, [], []), sources).count() == 3


def test_merge_validate_chunk(spark):
    g = graph(spark, [("a", "function"), ("b", "function")], [("a", "b", "calls")])
    nodes = spark.createDataFrame([("b", "concept", "B", {}, 0), ("c", "concept", "C1", {}, 1), ("c", "concept", "C2", {}, 2)], "id string, type string, label string, attrs map<string,string>, ordinal bigint")
    assert rows(J.merge_nodes(g.nodes, nodes).select("id", "label")) == [("a", "a"), ("b", "b"), ("c", "C1")]
    schema = "src string, dst string, type string, confidence string, confidence_score double, reason string, ordinal bigint"
    sem = spark.createDataFrame([("a", "b", "calls", "INFERRED", 0.5, "r", 0), ("a", "b", "similar_to", "AMBIGUOUS", 0.4, "r", 1), ("a", "b", "similar_to", "INFERRED", 0.9, "r", 2)], schema)
    assert rows(J.merge_edges(g.edges, sem).select("type", "confidence", "confidence_score")) == [("calls", "EXTRACTED", 0.0), ("similar_to", "AMBIGUOUS", 0.4)]
    J.validate_semantic(sem)
    bad = spark.createDataFrame([("a", "b", "x", "INFERRED", 1.5, "", 3), ("a", "", "x", "INFERRED", 0.5, "", 1), ("a", "b", "x", "EXTRACTED", 0.5, "", 2), ("a", "b", "x", "maybe", 0.5, "", 4)], schema)
    assert J.semantic_violations(bad).count() == 4
    with pytest.raises(ValueError, match="edge 1: missing dst"):
        J.validate_semantic(bad)
    files = spark.createDataFrame([(f"f{i:02}",) for i in range(7)], "path string")
    assert [r["chunk"] for r in J.chunk(files, 3, "path").orderBy("path").collect()] == [0, 0, 0, 1, 1, 1, 2]


def test_detectors(spark):
    sig = lambda s: {"signature": s, "package": "p"}
    g = graph(spark, [("f", "function", "NewClient", sig("func NewClient() *Client")), ("h", "function", "handleRequest", sig("func (w http.ResponseWriter)")), ("r", "struct", "UserRepository")], [("f", "Client", "returns")])
    assert rows(D.factories(g).select("id", "nodes")) == [("f", ["f", "Client"])] and D.handlers(g).first()["confidence"] == 0.95 and D.repositories(g).first()["id"] == "r"
    god = graph(spark, [("s", "struct")] + [(f"m{i}", "method") for i in range(25)], [("s", f"m{i}", "has_method") for i in range(25)])
    assert rows(D.god_objects(god)) == [("s", "s", 25, 25, "medium")]
    hub = graph(spark, [("h", "function")], [(f"c{i}", "h", "calls") for i in range(15)])
    assert D.hub_nodes(hub).first()["degree"] == 15
    cyc = graph(spark, [("a", "function"), ("b", "function")], [("a", "b", "imports"), ("b", "a", "imports"), ("a", "a", "calls")])
    assert rows(D.circular_dependencies(cyc)) == [("a", "b")]
    dead = graph(spark, [("u", "function", "unused"), ("m", "function", "main"), ("x", "function", "Exported"), ("c", "function", "called")], [("m", "c", "calls")])
    assert rows(D.dead_code(dead)) == [("u", "unused")]
    assert D.health(graph(spark, [], [])).first()["health_score"] == 100.0


def test_reuse(spark):
    pkg = lambda p, s="": {"package": p, "signature": s}
    g = graph(spark, [("a", "function", "Parse", pkg("p1", "func Parse(s string) error")), ("b", "function", "Parse", pkg("p2", "func Parse(t string) error")), ("c", "function", "New", pkg("p1")), ("d", "function", "New", pkg("p2"))], [(x, y, "calls") for x in "ab" for y in ("k", "l", "m")])
    assert rows(R.similar_signatures(g.nodes)) == [("(string)->error", 2, ["a", "b"])]
    assert rows(R.duplicate_names(g.nodes)) == [("Parse", 2, ["p1", "p2"], ["a", "b"])]
    assert rows(R.shared_dependencies(g.edges)) == [(["k", "l", "m"], 3, ["a", "b"])]


def test_insights(spark):
    at = lambda f: {"source_file": f}
    g = graph(spark, [("a", "function", "a", at("a.go")), ("b", "function", "b", at("b.go")), ("c", "function", "c", at("a.go")), ("p", "package")], [("a", "b", "calls", "INFERRED", 0.5), ("a", "c", "calls"), ("p", "a", "documents"), ("a", "gone", "calls")])
    com = spark.createDataFrame([("a", 0), ("b", 1)], "node_id string, community_id int")
    assert rows(I.surprises(g, com).select("src", "dst", "score")) == [("a", "b", 2 + 2.5 + 2 + 1.0), ("a", "c", 1.0)]
    assert J.cross_file_edges(g).count() == 1
    empty = graph(spark, [], [])
    assert [r["kind"] for r in I.questions(empty, com.limit(0)).collect()] == ["no_signal"]
    assert I.explain(g, "nobody").count() == 0 and I.explain(g, "a").first()["degree"] == 4


def test_search(spark):
    def doc(d, p):
        return {"doc": d, "package": p}

    g = graph(spark, [("n1", "function", "handleAuth", doc("Handles user authentication", "auth")), ("n2", "function", "validateToken", doc("Validates tokens for authentication", "auth")), ("n3", "struct", "User", doc("A user", "models"))], [])
    ix = X.build(g.nodes)
    assert {r["id"] for r in X.match(ix, "Authentication").collect()} == {"n1", "n2"} and {r["id"] for r in X.match(ix, "auth the").collect()} == {"n1", "n2"}
    assert X.match(ix, "nonsense").count() == 0 and X.match(ix, "").count() == 0 and X.match(ix, "user", ["struct"]).count() == 1
    assert {r["id"] for r in X.fuzzy(ix, "authentcation", 2).collect()} == {"n1", "n2"}
    p = X.page(X.match(ix, "user auth"), 1, 1).collect()
    assert len(p) == 1 and p[0]["total"] == 3 and p[0]["truncated"]
    assert one(spark, lambda c: X.highlight(c, ["user"]), "A User, users") == ["A <mark>User</mark>, users"]


def test_counts_of_odd_graphs(spark):
    none = graph(spark, [], [])
    assert A.god_nodes(none).count() == 0 and {r["name"]: r["n"] for r in A.graph_summary(none).collect()} == {"nodes": 0, "edges": 0}
    loop = graph(spark, [("a", "function")], [("a", "a", "calls")])
    assert rows(A.degrees(loop.edges)) == [("a", 1, 1, 2)] and rows(A.edge_type_breakdown(loop.edges, "a")) == [("calls", 2)]
    assert rows(A.isolated_nodes(graph(spark, [("x", "function"), ("p", "package")], []))) == [("x", "x", "function", 0)]


def test_edges_joined_in_pieces(spark):
    """Text that is joined piece by piece, equal edges and groups of several pieces included."""
    edges = [(f"a{i * 7 % 50:02}", f"b{i % 3}", "calls" if i % 4 else "uses") for i in range(120)]
    g = graph(spark, [], edges)
    want = {t: ",".join(sorted(f"{a}|{b}" for a, b, k in edges if k == t)) for t in ("calls", "uses")}
    assert dict(rows(A.edges_joined(g.edges, rows=9))) == want
    assert A.edges_joined(g.edges.limit(0)).count() == 0


def test_rows_are_spread_by_number(spark):
    from weftgraph.sources.projections import spread

    df = spark.range(1000).selectExpr("id", "id % 40 AS k")
    assert spread(df, "k", rows=100).rdd.getNumPartitions() == 10 and spread(df.limit(0), "k").count() == 0
    assert spread(df, "k", rows=100).selectExpr("k", "spark_partition_id() AS p").distinct().count() == 40


def test_edges_of_tables_that_grow_are_spread(spark, tmp_path, monkeypatch):
    """Orders, customers and pairs of part and supplier, too: no task groups more than its part of them."""
    from weftgraph.sources import projections as P

    seen, own = [], P.spread
    monkeypatch.setattr(P, "spread", lambda df, *keys, rows=250: seen.append(keys) or own(df, *keys, rows=rows))
    e = P.commerce_edges(spark, "/root/testdata/sf0.001").where("type IN ('calls', 'references', 'uses')")
    assert {("c_custkey",), ("o_orderkey",), ("l_partkey", "l_suppkey")} <= set(seen)
    part = e.withColumn("p", F.spark_partition_id()).groupBy("p", "type").count()
    assert 100 < part.agg({"count": "max"}).first()[0] < 400


def test_members_of_a_community_are_ranked_in_many_tasks(spark):
    ids = [f"n{i:03}" for i in range(90)]
    g = graph(spark, [(i, "function" if n % 3 else "struct") for n, i in enumerate(ids)], [(ids[n], ids[n * n % 50], "calls") for n in range(80)])
    com = spark.createDataFrame([(i, n % 2) for n, i in enumerate(ids)], "node_id string, community_id int")
    every = K.community_members(g, com)
    assert "Window" not in every._jdf.queryExecution().optimizedPlan().toString() and dict(every.dtypes)["rank"] == "int"
    want, groups = [], {}
    for c, t, i, d, _ in rows(every):
        groups.setdefault((c, t), []).append((-d, i))
    for (c, t), own in groups.items():
        want += [(c, t, i, -d, n + 1) for n, (d, i) in enumerate(sorted(own))]
    assert sorted(rows(every)) == sorted(want) and len(want) == 90
    assert sorted(rows(K.community_members(g, com, 4))) == sorted(x for x in want if x[-1] <= 4)


def test_inputs_of_many_steps_are_computed_once(spark):
    """Questions and health read the edges as a written table, however many parts of them do."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    g = graph(spark, [("a", "package"), ("b", "function"), ("c", "function")], [("a", "b", "calls", "AMBIGUOUS"), ("b", "c", "uses", "INFERRED", 0.5)])
    watched = Graph(g.nodes, g.edges.mapInArrow(count, g.edges.schema))
    communities = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1)], "node_id string, community_id int")
    assert I.questions(watched, communities).count() > 0 and seen.value == 2
    assert D.health(watched).count() == 1 and seen.value == 4


def test_shared_dependencies_with_equal_digests(spark):
    """Repeated edges cancel in the digest: the lists must decide."""
    edges = [("a", x, "calls") for x in ("p", "p", "q", "r")] + [("b", x, "calls") for x in ("s", "s", "q", "r")] + [("c", x, "uses") for x in ("p", "q", "p", "r")]
    got = R.shared_dependencies(graph(spark, [], edges).edges).collect()
    assert [(r["deps"], r["n_deps"], r["nodes"]) for r in got] == [(["p", "p", "q", "r"], 4, ["a", "c"])]
