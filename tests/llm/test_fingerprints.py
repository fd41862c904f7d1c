import hashlib
import random

import numpy as np
from conftest_llm import docs_of, rows_of

from weftgraph.llm import fingerprints as P


def brute(text):
    v = [0] * P.LANES
    n = 0
    for line in (text or "").split("\n"):
        line = line.strip(" \t\r\f\v")
        if line:
            n += 1
            h = hashlib.shake_128(line.encode()).digest(2 * P.LANES)
            for i in range(P.LANES):
                v[i] = (v[i] + h[2 * i] + 256 * h[2 * i + 1]) % 65536
    return n, np.array(v, "<u2").tobytes()


def test_against_brute_force(spark, odd_docs, no_docs, syllables):
    lines = [syllables(7, i) for i in range(30)]
    rng = random.Random(1)
    docs = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 12)))) for i in range(60)]
    for df in (docs_of(spark, docs), odd_docs.select("doc_id", "text")):
        want = sorted((str(r["doc_id"]), *brute(r["text"])) for r in rows_of(df))
        got = sorted((str(r["doc_id"]), r["n_paragraphs"], bytes(r["lanes"])) for r in rows_of(P.fingerprints(df)))
        assert got == want
    assert P.fingerprints(no_docs).count() == 0 and P.fingerprints(odd_docs).count() == odd_docs.count()


def test_order_insert_delete_merge():
    a, b = "one\ntwo\nthree\ntwo", "two\ntwo\nthree\none"
    lanes = P.total(P.paragraphs(a)).tobytes()
    assert lanes == P.total(P.paragraphs(b)).tobytes() != P.total(P.paragraphs("one\ntwo\nthree")).tobytes()
    less = P.delete(lanes, "two")
    assert less == P.total(P.paragraphs("three\none\ntwo")).tobytes() and P.insert(less, "two") == lanes
    assert P.merge(P.total([b"one"]).tobytes(), P.total([b"x", b"y"]).tobytes()) == P.total([b"y", b"one", b"x"]).tobytes()
    assert P.total([]).tobytes() == bytes(2 * P.LANES)


def test_slices_sum_up():
    parts = [str(i).encode() for i in range(P.SLICE + 7)]
    assert (P.total(parts) == P.total(parts[:9]) + P.total(parts[9:])).all()


def test_equal_sets(spark):
    d = docs_of(spark, [(5, "a\nb"), (2, "b\n a "), (9, "a\nb\nb"), (3, ""), (4, None), (2, "b\na")])
    got = sorted((r["doc_id"], r["same_as"]) for r in rows_of(P.equal_sets(P.fingerprints(d))))
    assert got == [(2, 2), (2, 2), (3, 3), (4, 3), (5, 2), (9, 9)]
