import json

import pytest
from graphs import graph, rows
from pyspark.sql import functions as F

from weftgraph.sources import ingest as N
from weftgraph.sources import store as M
from weftgraph.sources.extractors import base
from weftgraph.sources.extractors.golang import Go, base_type
from weftgraph.sources.extractors.java import Java
from weftgraph.sources.extractors.markdown import Markdown
from weftgraph.sources.extractors.swift import Swift
from weftgraph.sources.extractors.systemspec import SystemSpec
from weftgraph.sources.extractors.typescript import TypeScript

GO = '''package shop

import (
	"fmt"
	h "net/http" // imported "not this"
)

// Order is what a customer asks for.
type Order struct {
	Base
	ID    int64
	Lines []*Line `json:"lines"`
}

type Saver interface {
	fmt.Stringer
	Save(o Order) error
}

const Limit, other = 5, "func fake() {"
var _ = 1

// Total adds up. It is exact.
func (o *Order) Total(r Rate) (sum int, err error) {
	fmt.Println("call() in a string") // call2()
	return add(o.ID, 1), nil
}

func add(a, b int) int { return a + b }
'''

JAVA = """package com.x;
import java.util.List;
@RestController
@RequestMapping("/api")
public class Shop extends Base<T> implements Runnable, com.y.Other<A, B> {
    @Autowired private Repo repo;
    int n = compute(1);
    @GetMapping("/items") public List<String> items(int a) { return repo.find(a); }
    @PostMapping
    void add() { if (n > 1) { save(); } }
    class Inner { void hidden() {} }
}
interface Api { void call(); }
enum Kind { A, B }
"""

TS = """import { a, b } from './mod';
import c from "other";
export class Cart extends Base implements Priced {
  constructor(private x: number) { this.init(); }
  async total(y: string): Promise<number> { return sum(this.lines.map(f)); }
}
interface Priced { price: number }
export type Id = string;
function sum(v: number[]): number { return go(v); }
const twice = (n: number) => n * 2;
"""

SWIFT = """import Foundation
protocol Drawable { func draw() }
class Shape: Base, Drawable { init(x: Int) { setup() }
  func draw() { render("x") } }
struct Point { }
enum Side { case left }
extension Shape: Hashable { func hash() { } }
func top(a: Int) -> Int { return helper(a) }
"""

MD = "lost `Nothing`\n# First part\nuses `Order` and `Order.Total`, again `Order`\n```go\nfunc run(x) {\ntype Job struct\n```\n## Second\n~ `lower`\n"


def parts(x):
    return {(n[0], n[1]) for n in x.nodes}, {(e[0], e[1], e[2]) for e in x.edges}


def test_go():
    x = Go().extract("a/shop.go", GO)
    nodes, edges = parts(x)
    assert nodes == {
        ("go_file_a_shop.go", "file"), ("go_pkg_shop", "package"), ("go_pkg_fmt", "package"), ("go_pkg_net_http", "package"), ("go_type_Order", "struct"), ("go_type_Saver", "interface"),
        ("go_method_go_type_Saver.Save", "method"), ("go_constant_a_shop.go.Limit", "constant"), ("go_constant_a_shop.go.other", "constant"), ("go_method_Order.Total", "method"), ("go_func_a_shop.go.add", "function"),
    }
    f = "go_file_a_shop.go"
    assert {e for e in edges if e[0] != f} == {
        ("go_type_Order", "go_type_Base", "extends"), ("go_type_Order", "go_type_Line", "references"), ("go_type_Saver", "go_type_fmt.Stringer", "extends"), ("go_type_Saver", "go_method_go_type_Saver.Save", "contains"),
        ("go_method_Order.Total", "go_type_Order", "method_of"), ("go_method_Order.Total", "go_call_fmt.Println", "calls"), ("go_method_Order.Total", "go_func_a_shop.go.add", "calls"),
    }
    assert (f, "go_pkg_shop", "contains") in edges and (f, "go_pkg_net_http", "imports") in edges
    total = next(n for n in x.nodes if n[0] == "go_method_Order.Total")
    assert total[3]["signature"] == "func (o *Order) Total(r Rate) (sum int, err error)" and total[3]["doc"] == "Total adds up. It is exact." and total[3]["receiver"] == "Order"
    assert [base_type(t) for t in ("*T", "[]*T", "map[string]T", "chan int", "pkg.T", "[3]int", "func(a)")] == ["T", "T", "map", "chan", "pkg.T", "int", "func"]


def test_java():
    nodes, edges = parts(x := Java().extract("Shop.java", JAVA))
    assert {n for n in nodes if n[1] not in ("file", "package")} == {
        ("java_class_Shop", "class"), ("java_annotation_RestController", "annotation"), ("java_annotation_RequestMapping", "annotation"), ("java_method_java_class_Shop.items", "method"),
        ("java_method_java_class_Shop.add", "method"), ("java_route__items", "route"), ("java_route__post", "route"), ("java_interface_Api", "interface"), ("java_method_java_interface_Api.call", "method"), ("java_enum_Kind", "enum"),
    }
    assert {("java_class_Shop", "java_class_Base", "extends"), ("java_class_Shop", "java_interface_Runnable", "implements"), ("java_class_Shop", "java_interface_Other", "implements"),
            ("java_class_Shop", "java_class_Repo", "injects"), ("java_method_java_class_Shop.items", "java_call_find", "calls"), ("java_method_java_class_Shop.add", "java_call_save", "calls")} <= edges
    assert next(n for n in x.nodes if n[0] == "java_class_Shop")[3]["layer"] == "controller"


def test_typescript():
    nodes, edges = parts(TypeScript().extract("cart.ts", TS))
    assert nodes == {
        ("ts_file_cart.ts", "file"), ("ts_module_._mod", "module"), ("ts_module_other", "module"), ("ts_class_Cart", "class"), ("ts_method_ts_class_Cart.constructor", "method"), ("ts_method_ts_class_Cart.total", "method"),
        ("ts_interface_Priced", "interface"), ("ts_type_Id", "type"), ("ts_func_cart.ts.sum", "function"), ("ts_func_cart.ts.twice", "function"),
    }
    assert {("ts_class_Cart", "ts_class_Base", "extends"), ("ts_class_Cart", "ts_interface_Priced", "implements"), ("ts_method_ts_class_Cart.total", "ts_call_sum", "calls"),
            ("ts_method_ts_class_Cart.total", "ts_call_this.lines.map", "calls"), ("ts_func_cart.ts.sum", "ts_call_go", "calls")} <= edges


def test_swift():
    nodes, edges = parts(Swift().extract("s.swift", SWIFT))
    assert {("swift_module_Foundation", "module"), ("swift_protocol_Drawable", "interface"), ("swift_class_Shape", "class"), ("swift_struct_Point", "struct"), ("swift_enum_Side", "enum"), ("swift_extension_Shape_s.swift", "extension"),
            ("swift_method_swift_class_Shape.draw", "method"), ("swift_method_swift_class_Shape.init", "method"), ("swift_func_s.swift.top", "function")} <= nodes
    assert {("swift_class_Shape", "swift_protocol_Base", "implements"), ("swift_extension_Shape_s.swift", "swift_class_Shape", "extends"), ("swift_extension_Shape_s.swift", "swift_protocol_Hashable", "implements"),
            ("swift_method_swift_class_Shape.draw", "swift_call_render", "calls"), ("swift_func_s.swift.top", "swift_call_helper", "calls")} <= edges


def test_markdown_and_system():
    nodes, edges = parts(Markdown().extract("docs/x.md", MD))
    assert nodes == {("doc_file_docs_x_md", "file"), ("doc_concept_docs_x_md_first_part", "concept"), ("doc_concept_docs_x_md_second", "concept")}
    assert {e[1:] for e in edges if e[0].endswith("first_part")} == {("type_Order", "documents"), ("method_Order.Total", "documents"), ("func_run", "describes"), ("type_Job", "describes")}
    spec = json.dumps({"name": "s", "description": "d", "services": {"api": {"image": "i", "repo": {"url": "u"}, "connections": {"db-service": {}}}, "db-service": {"image": "j", "aws": {"rds": [{"name": "main"}]}}}})
    nodes, edges = parts(SystemSpec().extract("system.json", spec))
    assert {n[1] for n in nodes} == {"system", "service", "database"} and len(nodes) == 4 and ("svc:api", "repo:u", "links_to") in edges
    assert not SystemSpec().can_extract("config.json", '{"key": 1}') and not SystemSpec().can_extract("x.json", "{")


def test_registry():
    class Own(Go):
        pass

    class Later(Go):
        pass

    r = base.default_registry()
    assert r.get_by_path("x/y.TSX").language == "typescript" and r.get_by_path("none") is None and ".md" in r.extensions() and "swift" in r.languages()
    r.register(Own, base.THICK)
    r.register(Go)
    assert type(r.get("go")) is Own
    r.register(Later, base.THICK)
    assert type(r.get_by_language("go")) is Later and r.can_extract("a.go")


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "src"
    for name, text in {"a/shop.go": GO, "a/shop_test.go": GO, "vendor/v.go": GO, ".git/x.go": GO, "Shop.java": JAVA, "docs/x.md": MD, "system.json": "{}", "bad.bin": "x", "deep/build/b.ts": TS, "cart.ts": TS}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


def test_tree_and_cache(spark, tree, tmp_path):
    assert {r["rel"] for r in N.list_files(spark, str(tree)).select("rel").collect()} == {"a/shop.go", "a/shop_test.go", "Shop.java", "docs/x.md", "system.json", "bad.bin", "cart.ts"}
    assert [r["rel"] for r in N.source_files(spark, str(tree)).collect()] == ["a/shop.go"] and N.source_tokens(spark, str(tree)).first()["files"] == 1
    assert rows(N.doc_files(spark, str(tree)).select("path", "type")) == [("docs/x.md", "documentation")]
    cache = N.Cache(spark, str(tmp_path / "cache"))
    g, first = N.extract_tree(spark, str(tree), cache)
    assert (first["files"], first["hits"], first["errors"]) == (4, 0, 0) and g.nodes.where("id = 'go_type_Order'").count() == 1
    _, again = N.extract_tree(spark, str(tree), cache)
    assert (again["hits"], again["misses"]) == (4, 0)
    (tree / "a/shop.go").write_text(GO + "\nfunc more() {}\n")
    g, third = N.extract_tree(spark, str(tree), cache)
    assert (third["hits"], third["misses"]) == (3, 1) and g.nodes.where("label = 'more'").count() == 1
    cache.clear()
    assert cache.size() == 0


def test_a_failing_extractor_is_counted(spark, tree):
    class Broken(Go):
        def extract(self, path, text):
            raise RuntimeError("no")

    parsed = N.parse(N.list_files(spark, str(tree)).select("rel", "content"), N.Parser(custom=((".go", Broken),)))
    s = N.stats(parsed)
    assert s["errors"] == 1 and s["by_language"]["go"] == 1


def test_store(spark, tmp_path):
    s = M.GraphStore(spark, str(tmp_path / "g"))
    assert s.load().nodes.count() == 0
    s.upsert(graph(spark, [("a", "function", "old", {"source_file": "x.go"}), ("b", "function")], [("a", "b", "calls"), ("a", "b", "calls")]))
    s.upsert(graph(spark, [("a", "function", "new", {"source_file": "x.go"})], [("b", "a", "uses", "INFERRED", 0.5)]))
    g = s.load()
    assert rows(g.nodes.select("id", "label")) == [("a", "new"), ("b", "b")] and rows(g.edges.select("src", "dst", "type", "confidence_score")) == [("a", "b", "calls", 0.0), ("b", "a", "uses", 0.5)]
    M.write_json(g, str(tmp_path / "json"))
    back = M.read_json(spark, str(tmp_path / "json"))
    assert rows(back.edges.select("src", "dst", "type")) == rows(g.edges.select("src", "dst", "type")) and rows(back.nodes) == rows(g.nodes)
    s.replace_source(graph(spark, [("c", "function", "c", {"source_file": "x.go"})], []), "x.go")
    assert rows(s.load().nodes.select("id")) == [("b",), ("c",)] and rows(s.load().edges.select("src", "dst")) == [("b", "a")]
    assert M.list_projects(str(tmp_path)) == [str(tmp_path / "g")]


def test_manifest(tmp_path):
    path = str(tmp_path / "m" / "manifest.json")
    m = M.Manifest.load(path)
    assert m.directed and not m.sources
    m.add(M.Source("/x", "1"))
    m.add(M.Source("/x", "2"))
    m.add(M.source_of(str(tmp_path)))
    m.save(path)
    m = M.Manifest.load(path)
    assert [s.commit for s in m.sources] == ["2", ""] and m.get("/y") is None and m.stale_count() == 2 and m.remove("/x") and not m.remove("/x")


def test_semantic_answer(spark):
    answer = 'Here:\n```json\n{"nodes": [{"id": "c", "type": "concept", "label": "C"}], "edges": [{"from": "a", "to": "c", "type": "similar_to", "confidence": "INFERRED", "confidence_score": 0.8, "reason": "r"}]}\n```'
    n, e = N.semantic_json(spark, answer)
    assert n.count() == 1 and e.first()["dst"] == "c" and e.where(F.col("confidence_score") == 0.8).count() == 1
    with pytest.raises(ValueError):
        N.semantic_json(spark, "no JSON")
