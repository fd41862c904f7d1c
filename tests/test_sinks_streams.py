import gzip
import json
import time
import xml.etree.ElementTree as ET

import pytest
from graphs import graph, rows

from weftgraph.sinks import cypher, cytoscape, graphml, report, site, toon, vault
from weftgraph.sources import enhance
from weftgraph.sources.store import GraphStore
from weftgraph.streaming import watch


@pytest.fixture(scope="module")
def g(spark):
    return graph(
        spark, [("svc:a", "service", "it's \"A\" <&>", {"package": "p", "empty": ""}), ("func_b", "function", "b"), ("c", "function", "")],
        [("svc:a", "func_b", "calls", "INFERRED", 0.5), ("func_b", "rds:gone", "uses"), ("c", "func_b", "calls")],
    )


def test_toon(spark, g, tmp_path):
    text = toon.render(g)
    assert "nodes: 3" in text and 'svc:a,"it\'s \\"A\\" <&>",p,' in text.replace('"svc:a"', "svc:a") and "INFERRED,0.5" in text.replace('"', "")
    assert "INFERRED" not in toon.render(g, compact=True) and "    b" in toon.render(g, compact=True)
    toon.write(g, str(tmp_path / "t"), gzipped=True)
    assert spark.read.text(str(tmp_path / "t")).count() == 6
    toon.write_gzipped(str(tmp_path / "x.gz"), text)
    assert gzip.open(tmp_path / "x.gz", "rt").read() == text
    assert toon.format_value({"a": [1, {"b": "x: y"}], "c": {}, "d": True}) == 'a:\n  - 1\n  -\n    b: "x: y"\nc: {}\nd: true'
    with pytest.raises(ValueError):
        toon.format_value({}, "xml")


def test_cypher(g):
    got = {r["id"]: r["statement"] for r in cypher.node_statements(g.nodes).collect()}
    assert got["svc:a"] == "CREATE (:Service:Node {id: 'svc:a', type: 'service', label: 'it\\'s \"A\" <&>', package: 'p'});" and got["c"] == "CREATE (:Function:Node {id: 'c', type: 'function'});"
    assert any(r["statement"].endswith("CREATE (a)-[:CALLS {confidence: 'INFERRED', confidence_score: 0.500000}]->(b);") for r in cypher.edge_statements(g.edges).collect())


def test_graphml(g, spark, tmp_path):
    assert rows(graphml.edge_counts(g)) == [(2, 1)]
    root = ET.fromstring(graphml.render(g, directed=False).encode())
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    assert len(root.findall(f".//{ns}node")) == 3 and len(root.findall(f".//{ns}edge")) == 2 and root.find(f"{ns}graph").get("edgedefault") == "undirected"
    graphml.write(g, str(tmp_path / "gml"))
    assert spark.read.text(str(tmp_path / "gml/2-edges")).count() == 2


def test_cytoscape(g, spark):
    e = {r["id"]: r for r in cytoscape.elements(g).collect()}
    assert e["rds:gone"]["placeholder"] and (e["rds:gone"]["label"], e["rds:gone"]["type"]) == ("gone", "database") and e["c"]["label"] == "c"
    page = cytoscape.page(g)
    data = json.loads(page.split('application/json">')[1].split("</script>")[0].replace("<\\/", "</"))
    assert len(data) == 7 and next(x for x in data if x["data"]["id"] == "svc:a")["data"]["package"] == "p"
    with pytest.raises(ValueError):
        cytoscape.page(graph(spark, [("x:", "function", "")], []))


def test_vault_and_reports(g, spark, tmp_path):
    com = spark.createDataFrame([("svc:a", 0), ("func_b", 0), ("c", 1)], "node_id string, community_id int")
    assert vault.write(g, com, str(tmp_path / "v"), min_degree=1) == 5 and (tmp_path / "v/nodes/svc_a.md").exists() and "func_b" in (tmp_path / "v/communities/community-0.md").read_text()
    assert "| calls | 2 |" in report.summary(g) and "## surprises" in report.report(g, communities=com) and "# b" in report.explanation(g, "func_b", com)
    assert report.explanation(g, "nobody") == "no node nobody\n"


def test_watch(spark, tmp_path):
    src, store = tmp_path / "src", GraphStore(spark, str(tmp_path / "g"))
    src.mkdir()
    (src / "a.go").write_text("package a\nfunc One() {}\n")

    def run():
        watch.watch_tree(spark, str(src), store, str(tmp_path / "ck")).awaitTermination(120)
        return {r["label"] for r in store.load().nodes.where("type = 'function'").collect()}

    assert run() == {"One"}
    time.sleep(1.1)
    (src / "b.go").write_text("package a\nfunc Two() { One() }\n")
    assert run() == {"One", "Two"}
    left = watch.drop_vanished(store.load(), spark.createDataFrame([("b.go",)], "rel string"))
    assert {r["label"] for r in left.nodes.where("type = 'function'").collect()} == {"Two"}


def test_streams(spark, tmp_path):
    g = graph(spark, [], [("a", "b", "calls"), ("b", "b", "calls")])
    g.edges.drop("attrs").write.parquet(str(tmp_path / "e"))
    seen = []
    stream = spark.readStream.schema("src string, dst string").parquet(str(tmp_path / "e"))
    watch.running_degrees(stream, str(tmp_path / "ck"), lambda df: seen.extend(rows(df))).awaitTermination(120)
    assert sorted(seen) == [("a", 0, 1), ("b", 2, 1)]
    ev = spark.sql("select * from values ('x', timestamp'2024-01-01 00:00:00'), ('x', timestamp'2024-01-01 00:00:00.3'), ('x', timestamp'2024-01-01 00:00:02') as t(path, ts)")
    assert sorted(r["n"] for r in watch.bursts(ev).collect()) == [1, 2]


def test_site_and_bundle(spark, tmp_path):
    at = {"source_file": "/src/api/a.go"}
    s = graph(spark, [("system:x", "system", "X"), ("svc:a", "service", "Api"), ("f", "function", "f", at), ("helm:h", "helm_chart", "h")], [("system:x", "svc:a", "contains"), ("svc:a", "repo:h.org/o/api.git", "links_to"), ("helm:h", "svc:a", "deploys")])
    com = spark.createDataFrame([("f", 0)], "node_id string, community_id int")
    sources = spark.createDataFrame([(0, "/src/api")], "ordinal int, path string")
    assert site.write(s, str(tmp_path / "s"), sources, com, infrastructure=False) == ["index.html", "services/api.html", "communities/0.html"]
    assert '"f"' in (tmp_path / "s/services/api.html").read_text() and "helm" not in (tmp_path / "s/index.html").read_text()
    assert site.write_bundle(s, str(tmp_path / "b"))[0] == "SUMMARY.md" and gzip.open(tmp_path / "b/graph.toon.gz", "rt").read().startswith("stats:")


def test_prompts():
    asked = enhance.prompts([f"f{i}.go" for i in range(60)], "/src")
    assert len(asked) == 3 and "Part 3 of 3" in asked[2] and "f59.go" in asked[2] and enhance.chunks([], 5) == []
    assert enhance.select(["a/b.go", "b.go", "ab.go"], "b.go") == ["a/b.go", "b.go"]
