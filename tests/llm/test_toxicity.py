import itertools
import re

import numpy as np
import pytest
from conftest_llm import docs_of, rows_of

from weftgraph.llm import toxicity as T


def damerau(a, b, k):
    """Optimal string alignment distance where the first letter of ``a`` isn't left out."""
    inf = 99
    d = [[inf] * (len(b) + 1) for _ in range(len(a) + 1)]
    d[0][0] = 0
    for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
        best = d[i][j]
        if j:
            best = min(best, d[i][j - 1] + 1)
        if i > 1:
            best = min(best, d[i - 1][j] + 1)
        if i and j:
            best = min(best, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and a[i - 1] != a[i - 2]:
            best = min(best, d[i - 2][j - 2] + 1)
        d[i][j] = best
    return d[len(a)][len(b)]


def test_automaton_against_edit_distance():
    auto = T.build()
    letters = "idotmrnabsc"
    rng = np.random.default_rng(3)
    words = set(T.TERMS)
    for t in T.TERMS:
        for _ in range(150):
            w = list(t)
            for _ in range(rng.integers(0, 3)):
                i, op, c = rng.integers(0, len(w)), rng.integers(0, 4), letters[rng.integers(0, len(letters))]
                if op == 0:
                    w[i] = c
                elif op == 1:
                    w.insert(i, c)
                elif op == 2 and len(w) > 2:
                    del w[i]
                elif i + 1 < len(w):
                    w[i], w[i + 1] = w[i + 1], w[i]
            words.add("".join(w))
    words = sorted(w for w in words if not re.search(r"(.)\1\1", w))
    found = {w: T.score_texts(auto, [w])[0] for w in words}
    for w in words:
        costs = {t: damerau(t, w, 2) for t in T.TERMS}
        fits = [c for t, c in costs.items() if c <= T.edits(t)]
        assert bool(found[w]) == bool(fits), (w, costs)


def test_misspelled_folded_and_stems():
    auto = T.build(T.TERMS, ("chón", "lowei"))

    def hits(text):
        return [auto.terms[h[1]] for h in T.score_texts(auto, [text])[0]]

    assert hits("Idi0t, IDIOOOOT and idoit") == ["idiot"] * 3
    assert hits("pàthètic $tupid") == ["pathetic", "stupid"]
    assert hits("chónes chones Loweischaft ulowei") == ["chón", "lowei"]
    assert hits("oron is the patio") == [] and hits("of an idiom") == ["idiot"]  # which context_score takes for an ordinary word


def test_quotation_counts_less_than_abuse():
    auto = T.build()

    def score(text):
        return sum(h[2] for h in T.score_texts(auto, [text])[0])

    assert score("you are an idiot") > score("there is an idiot") > score("the word idiot") > score('the review says "what an idiot" here')
    assert score('The term "idiot" has a history.') < T.THRESHOLD <= score("you idiot")


def test_table_and_filter_agree(spark, odd_docs, no_docs):
    rows = rows_of(T.toxicity(odd_docs, stems=()))
    assert len(rows) == odd_docs.count() and not any(r["toxic"] for r in rows)
    assert all(r["score"] == 0.0 and r["hits"] == 0 and r["terms"] == [] for r in rows)
    kept = T.drop_toxic(odd_docs, stems=())
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert T.toxicity(no_docs, stems=()).count() == 0 and T.drop_toxic(no_docs, stems=()).count() == 0
    long = "word " * 300_000 + "idiot moron"
    d = docs_of(spark, [(1, long), (2, "fine text"), (3, "stupid clown"), (3, "stupid clown")])
    assert sorted(r["doc_id"] for r in rows_of(T.toxicity(d, stems=())) if r["toxic"]) == [1, 3, 3]
    assert [r["doc_id"] for r in rows_of(T.drop_toxic(d, stems=()))] == [2]


def test_stems_are_learned(spark, syllables):
    d, lab = [], []
    for i in range(200):
        toxic = i % 5 == 0
        d.append((i, syllables(60, i) + (f" quzzo{'abcdefgh'[i % 8]} " if toxic else "")))
        lab.append((i, 1, int(toxic)))
    copies = [(1000 + i, "copied wibblewobble " + syllables(60, 999)) for i in range(40)]
    lab += [(1000 + i, 1, 1) for i in range(40)] + [(None, 1, 1), (5, None, None), (77777, 0, 1)]
    docs, labels = docs_of(spark, d + copies), spark.createDataFrame(lab, "doc_id bigint, quality int, toxic int")
    stems = T.learn_stems(docs, labels)
    assert stems == ("quzzo",)  # copies of one text give no support
    assert len([r for r in rows_of(T.toxicity(docs, labels)) if r["toxic"]]) == 40
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert T.learn_stems(docs, none) == ()


def test_stems_of_a_small_language_and_of_frequent_use(spark, syllables):
    d, lab = [], []
    for i in range(300):
        toxic, lang = i % 10 == 0, "de" if i % 5 == 0 else "en"
        # the commonest word of all texts, which once stood for the whole text; the stem also comes up once in a few clean texts
        text = "dem " + syllables(60, i) + (f" vurno{'abcdef'[i % 6]} " * 3 if toxic else " vurnost " if i % 35 == 5 else "")
        d.append((i, text, lang, "s", len(text)))
        lab.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(d, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame(lab, "doc_id bigint, quality int, toxic int")
    stems = T.fit_stems(docs, labels)
    assert stems == {"vurno": 0.5}
    assert sorted(r["doc_id"] for r in rows_of(T.toxicity(docs, labels)) if r["toxic"]) == list(range(0, 300, 10))


def test_verdict_on_a_single_misspelled_term(spark):
    toxic = ["you idoit", "so disgustng, you know", "you are wrothless", "tu es stupidd", "a grantlove", "granotlven"]
    clean = ["your lower back", "you are closer to it", "you have an idiom", 'the word "idoit" was yours', "there is an idoit", "gratnlvoen here"]
    d = docs_of(spark, list(enumerate(toxic + clean)))
    rows = rows_of(T.toxicity(d, stems={"grantolv": 1.25}))
    assert sorted(r["doc_id"] for r in rows if r["toxic"]) == list(range(len(toxic)))
    assert len(rows_of(T.drop_toxic(d, stems={"grantolv": 1.25}))) == len(clean)
    auto = T.build(T.TERMS, ("grantolv",), frozenset(["grantolv"]))
    assert T.score_texts(auto, ["grantlove"]) == [[]] and len(T.score_texts(auto, ["grantolve"])[0]) == 1


@pytest.mark.parametrize("n", [1, 2, 50])
def test_batches_dont_matter(n, syllables):
    auto = T.build()
    texts = [syllables(30, i) + (" you moron " if i % 7 == 0 else "") + syllables(5, i + 100) for i in range(50)]
    whole = T.score_texts(auto, texts)
    parts = [x for i in range(0, 50, n) for x in T.score_texts(auto, texts[i : i + n])]
    assert whole == parts


def test_letters_of_other_scripts():
    auto = T.build(T.TERMS, ("дурак", "バカ者め", "llll"))

    def hits(text):
        return [auto.terms[h[1]] for h in T.score_texts(auto, [text])[0]]

    assert hits("Ты ДУРАК, дурраки") == ["дурак"] and hits("дуракии") == ["дурак"] and hits("バカ者め!") == ["バカ者め"]
    assert hits("домик другой поток привет") == [] and hits("llllama") == ["llll"]


@pytest.mark.parametrize("piece", [1, 7, 100])
def test_pieces_dont_matter(piece, syllables):
    auto = T.build()
    texts = [syllables(30, i) + (" you mooron " if i % 3 == 0 else "") for i in range(20)] + ["", "x" * 500 + " idiot"]
    assert [x.tolist() for x in T._matches(auto, texts, piece)] == [x.tolist() for x in T._matches(auto, texts)]
