import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import docs_of, rows_of
from pyspark.sql import functions as F

from weftgraph.llm import exact_dedup as E
from weftgraph.llm import line_dedup as L
from weftgraph.llm import near_dedup as N


def key(x):
    return (x is None, x or 0)


def test_exact_against_brute_force(spark, syllables):
    rng = random.Random(2)
    base = [syllables(rng.randint(1, 30), i) for i in range(40)] + [syllables(40, 99) + f" template {i}" for i in range(9)]
    rows = [(i, rng.choice(["", " ", "\n"]) + rng.choice(base).replace(" ", rng.choice([" ", "  ", "\n"]))) for i in rng.sample(range(10_000), 300)]
    rows += [(20_000 + i, base[0] if i % 2 else base[1] + " ") for i in range(200)]
    rows += [(None, base[0]), (5, base[0]), (5, base[0]), (7, None), (8, None), (None, None)]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t if t is None else " ".join(t.split())].append(i)
    first = {t: min(x for x in v if x is not None) for t, v in groups.items()}
    want = sorted((key(i), key(i if t is None else first[" ".join(t.split())])) for i, t in rows)
    df = docs_of(spark, rows)
    for least in (E.HOT_COUNT, 20, 10_000):  # two hot groups, many, none
        assert len(E.hot_groups(df, least=least)) == {20: 2, 10_000: 0}.get(least, 2)
        got = rows_of(E.exact_duplicates(df, least=least))
        assert sorted((key(r["doc_id"]), key(r["canonical_id"])) for r in got) == want
        stay = sorted([key(x) for t, x in first.items() if t is not None] + [key(i) for i in groups[None]])
        assert sorted(key(r["doc_id"]) for r in got if not r["is_duplicate"]) == stay
        assert sorted(key(r["doc_id"]) for r in rows_of(E.drop_exact_duplicates(df, least=least))) == stay


def test_exact_nulls_and_templates_spread(spark, syllables):
    head = syllables(60, 7)
    docs = docs_of(spark, [(i, None) for i in range(4000)] + [(10_000 + i, f"{head} {i} {head}") for i in range(4000)]).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    sizes = [r["count"] for r in rows_of(E.drop_exact_duplicates(docs).where("text IS NOT NULL").groupBy(F.spark_partition_id()).count())]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 4000 and max(sizes) < 2000


def test_exact_odd_cases(spark, odd_docs, no_docs):
    got = rows_of(E.exact_duplicates(odd_docs.select("doc_id", "text", "weft_key")))
    assert len(got) == odd_docs.count()
    dup = sorted((r["doc_id"], r["canonical_id"]) for r in got if r["is_duplicate"])
    assert dup == [(1, 1), (2, 1), (5, 4), (6, 4), (8, 7)]  # nulls equal nothing
    kept = E.drop_exact_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 5
    assert E.exact_duplicates(no_docs).count() == 0 and E.drop_exact_duplicates(no_docs).count() == 0


def test_exact_one_exchange(spark, odd_docs):
    plan = E.drop_exact_duplicates(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan


def brute_lines(rows):
    """rows: (doc_id, text hash, text); what stays of each distinct pair of id and hash, in order of first places."""
    seen, gone, by = {}, collections.defaultdict(set), {}
    for i, tag, t in sorted(set(rows), key=lambda r: (key(r[0]), r[1])):
        units = by[(i, tag)] = re.split(r"(?<=\n)|(?<=[.!?] )", t)
        ls = [x.strip(" \t\r\n") for x in units]
        for p in range(len(ls) - 2):
            w = tuple(ls[p : p + 3])
            if any(w) and seen.setdefault(w, (i, tag, p)) != (i, tag, p):
                gone[(i, tag)] |= {p, p + 1, p + 2}
    return {k: ("".join(x for p, x in enumerate(u) if p not in gone[k]), len(gone[k])) for k, u in by.items()}


def lines_against_brute_force(spark, rows):
    docs = docs_of(spark, rows)
    tags = {r["text"]: r["tag"] for r in rows_of(docs.selectExpr("text", "xxhash64(text) AS tag"))}
    want = brute_lines([(i, tags[t], t) for i, t in rows])
    got = sorted((key(r["doc_id"]), r["text"], r["removed_lines"]) for r in rows_of(L.line_dedup(docs)))
    assert got == sorted((key(i), *want[(i, tags[t])]) for i, t in rows)


def test_lines_against_brute_force(spark):
    rng = random.Random(4)
    units = ["a\n", "b\n", "c \n", " c\n", "d. ", "d.\n", "\n", "e! ", "f? ", ". ", "g", "\x01h. "]
    lines_against_brute_force(spark, [(i, "".join(rng.choice([*units, f"u{rng.random()}\n"]) for _ in range(rng.randint(0, 14)))) for i in range(120)])
    # ids that are null or shared by different texts, and repeated rows
    rows = [(rng.choice([None, 1, 2, 3]), "".join(rng.choice(units) for _ in range(rng.randint(0, 9)))) for _ in range(80)]
    lines_against_brute_force(spark, rows + rows[:9])


def test_lines_of_null_ids_are_told_apart(spark):
    got = sorted((r["text"], r["removed_lines"]) for r in rows_of(L.line_dedup(docs_of(spark, [(None, "a\nb\nc\nfirst"), (None, "a\nb\nc\nsecond")]))))
    assert sorted(n for _, n in got) == [0, 3]


def test_lines_passage_within_paragraphs(spark, syllables):
    passage = " ".join(syllables(12, 900 + i).capitalize() + "." for i in range(5))  # 60 words
    rows = [(i, f"{syllables(20, i).capitalize()}. {passage} {syllables(20, 50 + i).capitalize()}.") for i in range(3)]
    got = {r["doc_id"]: r for r in rows_of(L.line_dedup(docs_of(spark, rows)))}
    assert got[0]["text"] == rows[0][1] and [got[i]["text"] for i in (1, 2)] == [rows[i][1].replace(passage + " ", "") for i in (1, 2)]


def test_lines_odd_cases(spark, odd_docs, no_docs):
    got = rows_of(L.line_dedup(odd_docs))
    assert len(got) == odd_docs.count() and L.line_dedup(no_docs).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert by[3]["text"] is None and by[4]["text"] == "" and by[7]["removed_lines"] == 2999  # of 3,000 equal lines and the empty end
    assert by[8]["text"] == "" and by[8]["removed_lines"] == 3002
    twice = docs_of(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "x\na\nb\nc\ny"), (None, "a\nb\nc\nz")])
    got = sorted(((r["doc_id"] or 99), r["text"], r["removed_lines"]) for r in rows_of(L.line_dedup(twice)))
    assert got == [(1, "a\nb\nc", 0), (1, "a\nb\nc", 0), (2, "x\ny", 3), (99, "z", 3)]


def multiset(text, k=3):
    w = re.findall(r"\w+", text.lower())
    return collections.Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else collections.Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_registers_are_unbiased(syllables):
    a = syllables(400, 1) + " hot hot hot" * 40
    w = a.split()
    for share in (0.1, 0.3, 0.6):
        hits, m = [], 512
        for seed in range(6):
            rng = random.Random(seed)
            b = " ".join(x if rng.random() > share / 3 else f"new{seed}{i}" for i, x in enumerate(w)) + " hot hot hot" * rng.randint(0, 60)
            doc, sh, n = N.shingles(pa.array([a, b]))
            s = N.bag_minhash(doc, sh, n, 2, m)
            hits.append((float((s[0] == s[1]).mean()), jaccard(multiset(a), multiset(b))))
        err = np.mean([x - y for x, y in hits])
        assert abs(err) < 4 * np.sqrt(0.25 / (m * len(hits))), hits


def test_multiplicity_matters():
    texts = pa.array(["a b c " * 500, "a b c " * 250, "a b c " * 500])
    s = N.bag_minhash(*N.shingles(texts), 3, 1024)
    assert (s[0] == s[2]).all() and abs((s[0] == s[1]).mean() - jaccard(multiset(texts[0].as_py()), multiset(texts[1].as_py()))) < 0.07


def test_overlap_of_packed_multisets(syllables):
    a, b = syllables(300, 3) + " x y z" * 70_000, syllables(300, 3) + " x y z" * 90_000 + " end"
    pa_, pb = (N._pack(*N.shingles(pa.array([t])), 1)[0] for t in (a, b))
    assert N.overlap(pa_, pb) == pytest.approx(jaccard(multiset(a), multiset(b)), abs=1e-9)
    assert N.overlap(pa_, pa_) == 1.0


def brute_groups(rows):
    sets = [(i, multiset(t or "")) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = [(x, y) for x, y in itertools.combinations(range(len(rows)), 2) if sets[x][1] and sets[y][1] and jaccard(sets[x][1], sets[y][1]) >= N.THRESHOLD]
    for x, y in pairs:
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(rows))], pairs


def test_near_against_brute_force(spark, syllables):
    rng = random.Random(8)
    texts = [syllables(rng.randint(1, 120), i) for i in range(60)]
    for i in range(140):
        w = rng.choice(texts).split()
        texts.append(" ".join(x if rng.random() > 0.06 else "edit" + str(rng.random())[2:6] for x in w) + rng.choice(["", " tail words here"]))
    rows = list(enumerate(texts))
    group, pairs = brute_groups(rows)
    got = {r["doc_id"]: r["group_id"] for r in rows_of(N.near_duplicates(docs_of(spark, rows)))}
    linked = sum(got[x] == got[y] for x, y in pairs)
    assert linked >= 0.9 * len(pairs)
    wrong = sum(group[x] != group[y] for x, y in itertools.combinations(range(len(rows)), 2) if got[x] == got[y])
    assert wrong == 0 and len(pairs) > 100


def test_near_large_group_of_variants(spark, syllables):
    base = syllables(150, 77).split()
    rng = random.Random(9)
    rows = [(i, " ".join(w if rng.random() > 0.02 else f"v{i}" for w in base)) for i in range(800)] + [(900 + i, syllables(150, 500 + i)) for i in range(50)]
    got = rows_of(N.near_duplicates(docs_of(spark, rows)))
    assert sum(not r["is_duplicate"] for r in got) == 51 and {r["group_id"] for r in got if r["doc_id"] < 800} == {0}


def test_near_pages_of_one_template(spark, syllables, monkeypatch):
    """Unlike pages that share a bucket through their template aren't compared with each other, and links among them are found."""
    rng = random.Random(12)
    frame = syllables(70, 1)
    rows = [(i, f"{frame} {syllables(80, 100 + i)}") for i in range(300)]
    for i in range(40):
        w = rows[i][1].split()
        rows.append((1000 + i, " ".join(x if k < 70 or rng.random() > 0.04 else f"n{k}" for k, x in enumerate(w))))
    compared, real = [], N.verify
    monkeypatch.setattr(N, "verify", lambda pairs, *a: (compared.append(pairs.count()), real(pairs, *a))[1])
    got = {r["doc_id"]: r["group_id"] for r in rows_of(N.near_duplicates(docs_of(spark, rows)))}
    assert sum(compared) < 10 * len(rows)
    group, pairs = brute_groups(rows)
    linked = [got[rows[x][0]] == got[rows[y][0]] for x, y in pairs]
    assert len(pairs) >= 35 and sum(linked) >= 0.9 * len(pairs)
    assert all(group[x] == group[y] for x, y in itertools.combinations(range(len(rows)), 2) if got[rows[x][0]] == got[rows[y][0]])


def test_prefixes_lose_no_pair(syllables):
    rng = random.Random(3)
    base = syllables(60, 5).split()
    texts = [" ".join(x if rng.random() > p else f"z{rng.randint(0, 30)}" for x in base) + " a b c" * rng.randint(0, 9) for p in (0, 0.05, 0.1, 0.2, 0.3) for _ in range(8)]
    sets = [multiset(t) for t in texts]
    order = np.array(random.Random(4).choices(range(50), k=N.SLOTS))
    doc, item, size = N.prefixes(pa.array(texts), order)
    assert {d: n for d, n in zip(doc.tolist(), size.tolist())} == {i: sum(m.values()) for i, m in enumerate(sets)}
    own = [set(item[doc == i].tolist()) for i in range(len(texts))]
    alike = [(x, y) for x, y in itertools.combinations(range(len(texts)), 2) if jaccard(sets[x], sets[y]) >= N.THRESHOLD]
    assert len(alike) > 50 and all(own[x] & own[y] for x, y in alike)


def test_verify_salts_hubs(spark, syllables):
    texts = [syllables(30, 1) + f" tail {i}" for i in range(50)] + [syllables(30, 100 + i) for i in range(50)]
    held = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string")
    pairs = spark.createDataFrame([(0, i) for i in range(1, 100)] + [(7, 9), (60, 70)], "a bigint, b bigint")
    assert sorted((r["a"], r["b"]) for r in rows_of(N.verify(pairs, held, 9))) == [(0, i) for i in range(1, 50)] + [(7, 9)]


def test_signatures_dont_depend_on_batches(syllables):
    texts = [syllables(5 * i, i) + " a b" * i for i in range(60)]
    whole = N.band_hashes(N.bag_minhash(*N.shingles(pa.array(texts)), len(texts)))
    for i, t in enumerate(texts):
        alone = N.bag_minhash(*N.shingles(pa.array([t])), 1)
        assert (N.band_hashes(alone)[0] == whole[i]).all()


def test_words_in_segments(monkeypatch):
    from weftgraph.llm import textvec as V

    rng = random.Random(6)
    texts = pa.array(["".join(rng.choices(["a", "bc", "é", " ", "\n", "_", "9", "!"], k=rng.randint(0, 60))) for _ in range(80)] + [None, "", "x" * 500])
    h, at = V.words(texts)
    for size in (1, 3, 17, 64):
        monkeypatch.setattr(V, "SEGMENT", size)
        h2, at2 = V.words(texts)
        assert (h == h2).all() and (at == at2).all()


def test_near_odd_cases(spark, odd_docs, no_docs):
    got = rows_of(N.near_duplicates(odd_docs))
    assert len(got) == odd_docs.count()
    dup = sorted((key(r["doc_id"]), r["group_id"]) for r in got if r["is_duplicate"])
    assert dup == [((False, 1), 1), ((False, 2), 1), ((False, 8), 7)]
    kept = N.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 3
    assert N.near_duplicates(no_docs).count() == 0 and N.drop_near_duplicates(no_docs).count() == 0
