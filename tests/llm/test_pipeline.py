import random

import numpy as np
from conftest_llm import docs_of, rows_of

import corpus_pipeline as P
from weftgraph.llm import huffman as H
from weftgraph.llm import queries


def _write(spark, tmp_path, docs, labels=()):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages_take_effect(spark, tmp_path, syllables):
    rng = random.Random(1)
    rows = [(i, syllables(80, i), "ab"[i % 4 == 0]) for i in range(200)]
    rows += [(1000 + i, rows[i][1].replace(" ", "  "), "a") for i in range(20)]
    rows += [(2000 + i, " ".join(w if j and rng.random() > 0.03 else "edited" for j, w in enumerate(rows[40 + i][1].split())), "a") for i in range(20)]
    rows += [(3000 + i, syllables(80, 700 + i) + " you stupid idiot", "b") for i in range(10)]
    d = _write(spark, tmp_path, docs_of(spark, rows))
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, d)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = rows_of(docs)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {k: sorted(r["doc_id"] for r in v) for k, v in seen.items()}
    assert ids["toxicity"] == sorted(r[0] for r in rows if r[0] < 3000)
    assert ids["exact_dedup"] == sorted(r[0] for r in rows if r[0] < 1000 or 2000 <= r[0] < 3000)
    assert ids["near_dedup"] == list(range(200))
    assert set(ids["mixing"]) <= set(range(200)) and len(ids["mixing"]) != len(set(ids["mixing"]))
    enc = H.encoder(H.load_ranks(H.VOCABULARY))
    packed = {}
    for r in sorted(seen["packing"], key=lambda r: (r["row_id"], r["piece"])):
        packed.setdefault((r["doc_id"], r["row_id"]), []).extend(np.frombuffer(r["tokens"], "<u2").tolist())
    texts = {r[0]: r[1] for r in rows}
    assert sorted(i for i, _ in packed) == ids["mixing"] and all(enc.decode(t) == texts[i] for (i, _), t in packed.items())
    key = lambda r: (r["doc_id"], r["piece"], r["tokens"])
    assert sorted(map(key, rows_of(P.run(spark, d)))) == sorted(map(key, seen["packing"]))


def test_odd_and_empty_tables(spark, tmp_path, odd_docs, no_docs):
    odd, none = tmp_path / "odd", tmp_path / "none"
    odd.mkdir()
    none.mkdir()
    extra = odd_docs.drop("a.b")
    d = _write(spark, odd, extra)
    assert P.run(spark, d).count() > 0
    docs = odd_docs
    for (name, stage), n in zip(P.STAGES[:-1], (16, 11, 11, None)):
        docs = stage(spark, docs, d)
        assert docs.columns == odd_docs.columns
        left = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] is None) for r in rows_of(docs))
        if name == "exact_dedup":  # of copies the smallest id stays, nulls equal nothing
            assert left == [(False, i, i == 3) for i in (1, 1, 3, 4, 7, 9, 10, 11, 12)] + [(True, 0, False), (True, 0, True)]
        assert n is None or len(left) == n
    assert P.run(spark, _write(spark, none, no_docs)).count() == 0


def test_each_operator_has_its_query():
    names = list(queries.queries())
    assert [n for n in names if n.startswith("op")] == names[:10] and [int(n[2:].split("_")[0]) for n in names[:10]] == list(range(1, 11))
