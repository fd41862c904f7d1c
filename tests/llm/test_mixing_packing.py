import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from conftest_llm import docs_of, rows_of
from pyspark.sql import functions as F

from weftgraph.llm import huffman as H
from weftgraph.llm import mixing as M
from weftgraph.llm import packing as P


def brute_cell(t):
    t = t or ""
    marks = len(re.findall(r"[!-/0-9:-@\[-`{-~]", t)) / max(len(t), 1)
    words = t.split(" ")
    return sum(marks >= b for b in M.MARKS) * (len(M.DISTINCT) + 1) + sum(len(set(words)) / len(words) >= b for b in M.DISTINCT)


def brute_mix(rows, targets, budget, labels):
    """One sort for each source. rows: (doc_id, text, source); labels: (doc_id, quality)."""
    low = {}
    for i, q in labels:
        if i is not None and q is not None:
            low[i] = min(q, low.get(i, 9))
    kinds = collections.defaultdict(list)
    for i, t, _ in rows:
        if i in low:
            kinds[brute_cell(t)].append(low[i] > 0)
    by = collections.defaultdict(list)
    for i, t, s in rows:
        n = len(re.findall(r"[^ \t\n\r]+", t or ""))
        found = kinds[brute_cell(t)]
        w = max((sum(found) + 1) / (len(found) + 2), M.MIN_WEIGHT)
        u = (int(hashlib.md5(f"{M.SEED}:{'' if i is None else i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        by[s].append((-math.log(u) / w, i is None, i or 0, n))
    totals = {s: sum(x[3] for x in v) for s, v in by.items()}
    weight = {s: (targets.get(s, 0.0) if targets is not None else totals[s] ** M.TEMPERATURE) for s in by}
    out = {}
    for s, v in by.items():
        if totals[s]:
            goal = math.floor((budget if budget is not None else sum(totals.values())) * (weight[s] / sum(weight.values())))
            epochs, rest = divmod(goal, totals[s])
            run = 0
            for k, none, i, n in sorted(v):
                run += n
                c = epochs + (run <= rest)
                if c:
                    out[(None if none else i, s)] = c
    return out


@pytest.mark.parametrize("targets,budget", [(None, None), ({"a": 1, "b": 3, "c": 0}, None), ({"a": 1.0}, 900), ({"b": 2, "c": 1}, 60_000)])
def test_mix_against_brute_force(spark, syllables, targets, budget):
    rng = random.Random(3)
    rows = [(i, syllables(rng.randint(0, 80), i) + rng.choice(["", " 12!! 34", " the the" * 60]), rng.choice("aaaab" + "c")) for i in range(400)]
    marked = [(i, int(not rows[i][1].endswith("34"))) for i in range(0, 400, 2)] + [(None, 1), (0, 0), (3, None), (9999, 1)]
    labels = spark.createDataFrame(marked, "doc_id bigint, quality int")
    df = docs_of(spark, rows)
    got = {(r["doc_id"], r["source"]): r["copies"] for r in rows_of(M.mix_sources(df, targets, budget, labels=labels))}
    assert got == brute_mix(rows, targets, budget, marked)
    emitted = M.mixed_documents(df, targets=targets, budget=budget, labels=labels)
    assert emitted.columns == df.columns
    assert collections.Counter((r["doc_id"], r["source"]) for r in rows_of(emitted)) == collections.Counter(got)


def test_targets_are_met(spark, syllables):
    rows = [(i, syllables(50, i), "ab"[i % 3 == 0]) for i in range(600)]
    got = rows_of(M.mix_sources(docs_of(spark, rows), {"a": 1, "b": 1}))
    tokens = {s: sum(r["n_tokens"] * r["copies"] for r in got if r["source"] == s) for s in "ab"}
    assert abs(tokens["a"] - 15_000) <= 50 and abs(tokens["b"] - 15_000) <= 50
    assert min(r["copies"] for r in got if r["source"] == "b") >= 1  # a complete epoch first


def test_quality_weighs(spark):
    good, bad = "plain words of prose here", "1234 !!!! 5678 #### 9999"
    rows = [(i, good if i % 2 else bad, "a") for i in range(2000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, quality int")
    got = rows_of(M.mix_sources(docs_of(spark, rows), {"a": 1}, budget=2500, labels=labels))
    assert len(got) == 500 and sum(r["doc_id"] % 2 for r in got) > 450
    assert 200 < sum(r["doc_id"] % 2 for r in rows_of(M.mix_sources(docs_of(spark, rows), {"a": 1}, budget=2500))) < 300


def test_mix_odd_cases(spark, odd_docs, no_docs):
    out = M.mixed_documents(odd_docs)
    assert out.columns == odd_docs.columns and out.count() > 0
    assert M.mix_sources(no_docs).count() == 0 and M.mixed_documents(no_docs).count() == 0
    assert M.mix_sources(no_docs, {}).count() == 0 and M.mix_sources(odd_docs, {}).count() == 0
    only_null = odd_docs.where("source is null")
    assert [r["copies"] for r in rows_of(M.mix_sources(only_null))] == []  # no tokens
    twice = docs_of(spark, [(1, "a b c", "s")] * 4)
    assert M.mixed_documents(twice, targets={"s": 1}).count() == 4
    assert M.mixed_documents(twice, targets={"s": 1}, budget=24).count() == 8
    assert M.mixed_documents(twice, targets={"s": 1}, budget=23).count() == 4  # equal rows stay together
    weighed = M.mix_sources(docs_of(spark, [(i, "a b", "s") for i in range(8)]), {"s": 1}, 6, weight=F.when(F.col("doc_id") < 3, 1e6))
    assert sorted(r["doc_id"] for r in rows_of(weighed)) == [0, 1, 2]


def brute_pack(sizes, window):
    """Levels in a list of open windows; the sum of squares is computed anew for each choice."""
    open_, where, opened = [], [], 0

    def squares(levels):
        c = collections.Counter(x for x in levels if 0 < x < window)
        return sum(v * v for v in c.values())

    for s in sizes:
        best = None
        for h in sorted({lv for _, lv in open_} | {0}, reverse=True):
            if h + s <= window:
                levels = [lv for _, lv in open_]
                if h:
                    levels.remove(h)
                cost = squares([*levels, h + s])
                if best is None or cost < best[0]:
                    best = (cost, h)
        h = best[1]
        if h:
            k = max(i for i, (_, lv) in enumerate(open_) if lv == h)
            b = open_.pop(k)[0]
        else:
            b, opened = opened, opened + 1
        where.append((b, h))
        if h + s < window:
            open_.append((b, h + s))
    return where


def test_sum_of_squares_against_brute_force():
    rng = random.Random(6)
    for window in (5, 12, 40):
        sizes = [rng.randint(1, window) for _ in range(300)]
        packer = P.Packer(window)
        assert [packer.place(s) for s in sizes] == brute_pack(sizes, window)


def check_packed(rows, out, window):
    """Pieces make up each row's ids, windows are filled from 0 without gaps, and each stream is packed by the rule."""
    enc = H.encoder(H.load_ranks(H.VOCABULARY))
    want = collections.Counter((i, enc.decode(enc.encode(t or ""))) for i, t in rows)
    got, streams, windows = collections.defaultdict(list), collections.defaultdict(list), collections.defaultdict(list)
    for r in sorted(out, key=lambda r: (r["row_id"], r["piece"])):
        ids = np.frombuffer(r["tokens"], "<u2").tolist()
        assert len(ids) == r["n_tokens"] <= window and (r["window_id"] is None) == (r["start"] is None) == (not ids)
        got[(r["row_id"], r["doc_id"])].append(ids)
        if ids:
            streams[r["row_id"] >> 40].append((len(ids), (r["window_id"] & (2**40 - 1), r["start"])))
            assert r["window_id"] >> 40 == r["row_id"] >> 40
            windows[r["window_id"]].append((r["start"], ids, r["row_id"], r["piece"]))
    assert collections.Counter((i, enc.decode(sum(ids, []))) for (_, i), ids in got.items()) == want
    for s in streams.values():
        assert [w for _, w in s] == brute_pack([n for n, _ in s], window)
    for spans in windows.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[0] + len(a[1]) == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][0] + len(spans[-1][1]) <= window
    return windows


def test_pack_against_brute_force(spark, syllables):
    rng = random.Random(7)
    rows = [(i, syllables(int(rng.lognormvariate(3, 1)), i)) for i in range(400)] + [(None, "a b"), (None, "a b"), (5, None), (5, "")]
    df = docs_of(spark, rows).repartition(3)
    packed = P.pack(df, window=64)
    windows = check_packed(rows, rows_of(packed), 64)
    assert len({w >> 40 for w in windows}) == 3
    report = rows_of(P.pack_report(packed, 64))[0]
    assert report["windows"] == len(windows) and report["filled"] > 0.95
    assert "Exchange" not in P.pack(docs_of(spark, rows))._jdf.queryExecution().executedPlan().toString()


def test_pack_odd_cases(spark, odd_docs, no_docs):
    out = rows_of(P.pack(odd_docs))
    assert P.pack(no_docs).count() == 0
    check_packed([(r["doc_id"], r["text"]) for r in rows_of(odd_docs)], out, P.WINDOW)
    assert len({r["row_id"] for r in out}) == odd_docs.count()
