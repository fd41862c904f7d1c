import itertools
import random
from collections import deque

import pytest
from graphs import graph, rows
from pyspark.sql import functions as F

from weftgraph.checkpoints import saved_by
from weftgraph.operators import centrality as C
from weftgraph.operators import communities as K
from weftgraph.operators import traversal as T
from weftgraph.operators.order import numbered


def brute_betweenness(ids, pairs):
    near = {i: set() for i in ids}
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    score = dict.fromkeys(ids, 0.0)
    for s in ids:
        dist, count, todo = {s: 0}, {s: 1}, deque([s])
        while todo:
            v = todo.popleft()
            for w in near[v]:
                if w not in dist:
                    dist[w], count[w] = dist[v] + 1, 0
                    todo.append(w)
                if dist[w] == dist[v] + 1:
                    count[w] += count[v]
        for t in ids:
            if t != s and t in dist:
                back = {t: 0}
                paths = {t: 1}
                for v in sorted(dist, key=dist.get, reverse=True):
                    if v in paths:
                        for w in near[v]:
                            if dist.get(w, -1) == dist[v] - 1:
                                paths[w] = paths.get(w, 0) + paths[v]
                for v in paths:
                    if v not in (s, t):
                        score[v] += count[v] * paths[v] / count[t]
                del back
    return {k: v for k, v in score.items() if v > 1e-9}


def test_betweenness_of_known_graphs(spark):
    path = graph(spark, [(x, "function") for x in "ABC"], [("A", "B", "calls"), ("B", "C", "calls")])
    assert [(r["id"], r["score"]) for r in C.betweenness(path).collect()] == [("B", 2.0)]
    assert C.betweenness(path, halve=True).first()["score"] == 1.0
    excl = graph(spark, [("p", "package"), ("A", "function"), ("B", "function")], [("p", "A", "contains"), ("p", "B", "contains"), ("A", "B", "calls")])
    assert C.betweenness(excl).count() == 0
    ring = graph(spark, [(x, "function") for x in "ABXCD"], [(a, b, "calls") for a, b in ("AB", "AX", "BX", "CD", "CX", "DX")])
    com = spark.createDataFrame([("A", 1), ("B", 1), ("X", 1), ("C", 2), ("D", 2)], "node_id string, community_id int")
    scores = C.betweenness(ring)
    assert rows(C.touched_communities(ring, scores, com)) == [("X", [1, 2])]
    top = C.ranked(scores).first()
    assert (top["rank"], top["is_top"]) == (1, True)


@pytest.mark.parametrize("seed", [1, 2])
def test_betweenness_against_brute_force(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{i}" for i in range(14)]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(24)]
    g = graph(spark, [(i, "function") for i in ids], [(a, b, "calls") for a, b in pairs])
    got = {r["id"]: r["score"] for r in C.betweenness(g).collect()}
    assert got == pytest.approx(brute_betweenness(ids, pairs))
    assert {r["id"]: r["score"] for r in C.betweenness(g, pivots=99).collect()} == pytest.approx(got)


def test_betweenness_folds_trees_and_equal_nodes(spark):
    """Trees on a core with nodes of equal neighbours, a forest, a pair; sources are only what is left of them."""
    rng = random.Random(5)
    hubs, users = ["a", "b", "c"], [f"u{i:02}" for i in range(12)]
    pairs = [("a", "b"), ("b", "c")] + [(u, h) for i, u in enumerate(users) for h in hubs if i % 7 + 1 & 1 << hubs.index(h)]
    hung = [(f"t{i}", rng.choice(users + hubs + [f"t{j}" for j in range(i)])) for i in range(15)]
    forest = [("x0", "x1"), ("x1", "x2"), ("x1", "x3"), ("x3", "x4"), ("y0", "y1")]
    pairs += hung + forest
    ids = sorted({x for p in pairs for x in p})
    g = graph(spark, [(i, "function") for i in ids], [(a, b, "calls") for a, b in pairs])
    assert {r["id"]: r["score"] for r in C.betweenness(g).collect()} == pytest.approx(brute_betweenness(ids, pairs))
    links = spark.createDataFrame([x for a, b in forest for x in ((a, b), (b, a))], "tail string, head string")
    assert C._fold(links)[2].count() == 0
    same = spark.createDataFrame([x for i in range(200) for h in "pq" for x in ((f"u{i}", h), (h, f"u{i}"))], "tail string, head string")
    assert C._twins(same, same.select("tail").distinct().selectExpr("tail AS v", "1D AS w"))[1].count() == 2


def test_empty_and_edgeless_graphs(spark):
    none, bare = graph(spark, [], []), graph(spark, [("A", "function")], [])
    for g in (none, bare):
        assert C.betweenness(g).count() == 0 and K.louvain(g).count() == 0 and C.hits(g.edges).count() == 0
        assert T.bfs(g, "A", 2).count() == g.nodes.count() == T.connected_components(g.nodes, g.edges).count()
        assert T.shortest_path(g, "A", "B").count() == 0 and T.dfs(g, "A", 2).count() == g.nodes.count()


def test_traversals_against_brute_force(spark):
    rng = random.Random(3)
    ids = [f"n{i:02}" for i in range(20)]
    edges = {(rng.choice(ids), rng.choice(ids), rng.choice(("calls", "uses"))) for _ in range(30)}
    g = graph(spark, [(i, "function") for i in ids], sorted(edges))
    for direction, types in itertools.product(("out", "in", "both"), ((), ("calls",))):
        steps = [(a, b) for a, b, t in edges if not types or t in types]
        steps = {"out": steps, "in": [(b, a) for a, b in steps], "both": steps + [(b, a) for a, b in steps]}[direction]
        depth, level = {"n00": 0}, ["n00"]
        for d in range(1, 4):
            level = sorted({b for a, b in steps if a in level and b not in depth})
            depth |= dict.fromkeys(level, d)
        assert dict(rows(T.bfs(g, "n00", 3, direction, types))) == depth
        reach = {r["id"] for r in T.dfs(g, "n00", 3, direction, types).collect()}
        assert "n00" in reach and reach <= set(depth)
        end = max(depth, key=lambda x: (depth[x], x))
        path = [r["id"] for r in T.shortest_path(g, "n00", end, direction, types).orderBy("step").collect()]
        assert len(path) == depth[end] + 1 and all((a, b) in steps for a, b in zip(path, path[1:]))
    group = {i: i for i in ids}
    for _ in ids:
        for a, b, _t in edges:
            group[a] = group[b] = min(group[a], group[b])
    assert dict(rows(T.connected_components(g.nodes, g.edges))) == group


def test_neighbors_and_loops(spark):
    g = graph(spark, [("A", "function"), ("B", "function")], [("A", "A", "calls"), ("A", "B", "calls"), ("A", "B", "calls"), ("A", "gone", "calls"), ("B", "A", "uses")])
    assert rows(T.neighbors(g, "A").select("id", "edge_type", "direction")) == [("A", "calls", "out"), ("B", "calls", "out"), ("B", "uses", "in")]


def test_louvain_finds_cliques(spark):
    names = {c: [f"{c}{i}" for i in range(6)] for c in "xyz"}
    edges = [(a, b, "calls") for own in names.values() for a, b in itertools.combinations(own, 2)] + [("x0", "y0", "calls"), ("y1", "z1", "calls")]
    g = graph(spark, [(i, "function") for own in names.values() for i in own], edges)
    found = dict(rows(K.louvain(g, tolerance=0.0)))
    assert len(set(found.values())) == 3 and all(len({found[i] for i in own}) == 1 for own in names.values())
    com = K.louvain(g, tolerance=0.0)
    assert K.modularity(g.edges, com).first()[0] > 0.5
    assert [r["cohesion"] for r in K.cohesion(g.edges, com).collect()] == [1.0] * 3

    def value(at):
        m, vol = len(edges), {}
        for a, b, _ in edges:
            for x in (a, b):
                vol[at[x]] = vol.get(at[x], 0) + 1
        return sum(at[a] == at[b] for a, b, _ in edges) / m - sum(v * v for v in vol.values()) / (4 * m * m)

    assert all(value(found | {i: c}) <= value(found) for i in found for c in set(found.values()))  # no single move gains


def test_louvain_round_against_brute_force(spark):
    """Links stay in their buckets, only nodes whose turn it is are weighed, and they go where most is gained."""
    rng = random.Random(8)
    pairs = {tuple(sorted(rng.sample(range(30), 2))) for _ in range(70)}
    w = {(a, b): float(rng.randint(1, 3)) for a, b in pairs}
    w |= {(b, a): x for (a, b), x in w.items()}
    c, k, total = {u: rng.randint(0, 6) for u, _ in w}, {}, sum(w.values())
    for (u, _), x in w.items():
        k[u] = k.get(u, 0.0) + x
    near = saved_by(spark.createDataFrame([(u, v, x, u) for (u, v), x in w.items()], "u long, v long, w double, turn long"), "v", 3)
    label = spark.createDataFrame([(u, c[u], k[u], u) for u in c], "u long, c long, k double, turn long")
    plan = near.join(label.select(F.col("u").alias("v"), "c").hint("shuffle_hash"), "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and not spark.sql("SHOW TABLES").where("tableName LIKE 'step_%'").count()
    out, gained = K._moved(label, near, total, 1.0, 2, 1, 3)
    want, most = dict(c), 0.0
    for u in (u for u in c if (u + 1) % 2 == 0):
        gain = {t: round(sum(x for (a, b), x in w.items() if a == u and c[b] == t) - k[u] * sum(k[v] for v in c if c[v] == t and v != u) / total, 9) for t in {c[b] for a, b in w if a == u} | {c[u]}}
        want[u] = min(gain, key=lambda t: (-gain[t], t != c[u], t))
        most += gain[want[u]] - gain[c[u]]
    assert {r["u"]: r["c"] for r in out.collect()} == want != c and gained == pytest.approx(most)


def test_hits(spark):
    g = graph(spark, [], [("a", "c", "calls"), ("b", "c", "calls"), ("b", "d", "calls")])
    got = {r["id"]: (r["hub"], r["authority"]) for r in C.hits(g.edges).collect()}
    assert max(got, key=lambda k: got[k][0]) == "b" and max(got, key=lambda k: got[k][1]) == "c" and got["c"][0] == 0


def test_star_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(64)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in T.star_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent if any(find(y) == find(x) and y != x for y in parent)}
    assert T.star_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_numbered(spark):
    rng = random.Random(2)
    rows_ = [(rng.randint(0, 50), i) for i in range(500)]
    df = spark.createDataFrame(rows_, "a int, b int").repartition(7)
    got = {(r["a"], r["b"]): r["n"] for r in numbered(df, "n", "a", "b").collect()}
    assert got == {x: i + 1 for i, x in enumerate(sorted(rows_))} and numbered(df.limit(0), "n", "a").count() == 0
