import collections
import heapq
import itertools
import json
import math
import random
import re

import numpy as np
import pytest
from conftest_llm import docs_of, rows_of
from pyspark.sql import functions as F

from weftgraph.llm import chat as C
from weftgraph.llm import huffman as H
from weftgraph.llm import lm_scoring as L
from weftgraph.llm import queries


def brute_scores(rows):
    """rows: (doc_id, text, held)"""
    tok = [re.findall(r"\w+", (t or "").lower()) for _, t, _ in rows]

    def count(which):
        one, two = collections.Counter(), collections.Counter()
        for w, (_, _, h) in zip(tok, rows):
            if w and h in which:
                one.update([*w, None])
                two.update(zip([None, *w], [*w, None]))
        return one, two

    (t1, t2), (_, h2), (a1, a2) = count({False}), count({True}), count({True, False})

    def arr(c, ks):
        return np.array([c[k] for k in ks], float)

    pairs = list(h2)
    cells = L.held_out_cells(arr(t2, pairs), arr(t1, [p[0] for p in pairs]), arr(t1, [p[1] for p in pairs]), arr(h2, pairs), float(sum(t1.values())))
    rows_ = np.array([(k[0], v[1] / v[0], v[2] / v[0], v[0]) for k, v in sorted(cells.items())]).reshape(-1, 4)
    weights = L.learn_weights(rows_, 1 / max(1, len(a1)))
    out = []
    n_all = sum(a1.values())
    for w, (i, _, _) in zip(tok, rows):
        if not w:
            out.append((i, 0, None))
            continue
        b = list(zip([None, *w], [*w, None]))
        o1, o2, lp = collections.Counter([*w, None]), collections.Counter(b), 0.0
        for v, x in b:  # all counts less the text's own
            c2, cv, cw = a2[(v, x)] - o2[(v, x)], a1[v] - o1[v], a1[x] - o1[x]
            lam = weights[min(L.BUCKETS - 1, cv.bit_length())]
            lp += math.log(max(lam[0] / len(a1) + lam[1] * (cw / (n_all - len(b)) if n_all > len(b) else 0) + lam[2] * (c2 / cv if cv else 0), 1e-300))
        out.append((i, len(b), lp))
    return out


def test_weights_by_plain_expectation_maximisation():
    rng = random.Random(2)
    for _ in range(5):
        seen = [(rng.random() / 50, rng.choice([0, rng.random()]), rng.randint(1, 9)) for _ in range(40)]  # p(word), p(word | context), count
        lam, p1 = [1 / 3] * 3, 0.001
        for _ in range(1000):
            part = [[n * a * b / sum(x * y for x, y in zip(lam, (p1, p2, p3))) for a, b in zip(lam, (p1, p2, p3))] for p2, p3, n in seen]
            lam = [sum(c) / sum(n for *_, n in seen) for c in zip(*part)]
        got = L.learn_weights(np.array([(4, p2, p3, n) for p2, p3, n in seen]), p1)
        assert got[4] == pytest.approx(lam, abs=1e-4) and got[3] == pytest.approx(lam, abs=1e-4)  # an unseen bucket has the weights of all


def test_repeating_itself_doesnt_help(spark, syllables):
    rows = [(i, syllables(40, i)) for i in range(200)] + [(900, "qua qua que que " * 40), (901, syllables(160, 5000))]
    got = {r["doc_id"]: r["perplexity"] for r in rows_of(L.lm_scores(docs_of(spark, rows)))}
    assert got[900] > got[901]


@pytest.mark.parametrize("shards", [1, 7])
def test_lm_against_brute_force(spark, syllables, shards, monkeypatch):
    rng = random.Random(1)
    rows = [(i, rng.choice([syllables(rng.randint(1, 60), i % 90), "", None, "?!"]) if i % 9 == 0 else syllables(rng.randint(1, 200), i)) for i in range(300)] + [(7, "again the same"), (7, "again the same")]
    df = docs_of(spark, rows)
    flag = F.pmod(F.xxhash64("doc_id"), F.lit(L.HELD_OUT)) == 0
    want = brute_scores([tuple(r) for r in df.select("doc_id", "text", flag).collect()])
    got = [(r["doc_id"], r["n_tokens"], r["log_prob"]) for r in rows_of(L.lm_scores(df, shards=shards))]

    def k(x):
        return (x[0], x[1], x[2] or 0)

    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=k), sorted(want, key=k)):
        assert g[:2] == w[:2] and (g[2] is None) == (w[2] is None)
        assert g[2] is None or g[2] == pytest.approx(w[2], rel=1e-9)


def test_lm_odd_cases(spark, odd_docs, no_docs):
    got = rows_of(L.lm_scores(odd_docs))
    assert len(got) == odd_docs.count() and L.lm_scores(no_docs).count() == 0
    assert sum(r["log_prob"] is None for r in got) == 6
    one = rows_of(L.lm_scores(docs_of(spark, [(1, "a"), (2, None)])))
    assert sorted(r["n_tokens"] for r in one) == [0, 2]


def test_lm_likes_what_it_knows(spark, syllables):
    rows = [(i, syllables(100, i % 40) if i % 3 else syllables(100, i)) for i in range(240)] + [(999, " ".join(f"odd{i}" for i in range(100)))]
    got = {r["doc_id"]: r["perplexity"] for r in rows_of(L.lm_scores(docs_of(spark, rows)))}
    assert got[999] == max(got.values()) and got[1] < got[42]  # ids that 3 divides have a text of their own from 42 on


def test_weights_maximise_likelihood():
    rng = np.random.default_rng(0)
    cells = np.stack((np.full(200, 4), rng.random(200) * 0.01, rng.random(200), rng.integers(1, 50, 200)), axis=1)
    lam = L.learn_weights(cells, 1e-5)[4]

    def ll(x):
        return (cells[:, 3] * np.log(x[0] * 1e-5 + x[1] * cells[:, 1] + x[2] * cells[:, 2])).sum()

    assert lam.sum() == pytest.approx(1) and (lam >= 0).all()
    grid = [ll(np.array([a, b, 1 - a - b])) for a, b in itertools.product(np.linspace(0, 0.5, 26), repeat=2) if a + b < 1]
    assert ll(lam) >= max(grid) - 1e-6


def huffman_cost(counts):
    h = [c for c in counts if c]
    heapq.heapify(h)
    total = 0
    while len(h) > 1:
        s = heapq.heappop(h) + heapq.heappop(h)
        total += s
        heapq.heappush(h, s)
    return total


def best_limited(counts, limit):
    """The cheapest length-limited prefix code by trying all lengths (small alphabets)."""
    best = None
    for ls in itertools.product(range(1, limit + 1), repeat=len(counts)):
        if sum(2.0**-x for x in ls) <= 1:
            c = sum(a * b for a, b in zip(ls, counts))
            best = c if best is None else min(best, c)
    return best


def test_code_lengths_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(60):
        c = rng.integers(0, 10 ** int(rng.integers(1, 6)), int(rng.integers(2, 80)))
        if (c > 0).sum() > 1:
            assert (H.code_lengths(c, 40).astype(int) * c).sum() == huffman_cost(c.tolist())
    for _ in range(10):
        c = np.sort(rng.integers(1, 500, 5)) ** 2
        n = H.code_lengths(c, 3)
        assert n.max() <= 3 and (n.astype(int) * c).sum() == best_limited(c.tolist(), 3)
    assert H.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0] and H.code_lengths(np.zeros(4, int)).tolist() == [0] * 4


def test_codes_are_canonical_and_prefix_free():
    lengths = H.code_lengths(np.random.default_rng(4).integers(0, 1000, 300))
    codes = H.canonical_codes(lengths)
    words = sorted((int(n), i, format(int(codes[i]), f"0{int(n)}b")) for i, n in enumerate(lengths) if n)
    text = [w for _, _, w in words]
    assert text == sorted(text) and all(not b.startswith(a) for a, b in zip(text, text[1:]))


def test_blocks_decode_from_any_checkpoint():
    rng = np.random.default_rng(5)
    ids = (rng.zipf(1.3, 200_000) % 5000).astype(np.uint16)
    lengths = H.code_lengths(np.bincount(ids, minlength=5000))
    sizes = np.array([0, 1, H.STRIDE, H.STRIDE + 1, 32768, 0, 50_000, 5])
    done = H.encode_blocks(ids[: sizes.sum()], sizes, lengths, H.canonical_codes(lengths))
    dec, at = H.Decoder(lengths), 0
    for (bits, marks, payload), n in zip(done, sizes):
        assert len(payload) == (bits + 7) // 8 and len(marks) == -(-n // H.STRIDE)
        assert (dec.block(payload, marks, n) == ids[at : at + n]).all()
        if n > H.STRIDE:  # from the second checkpoint alone
            assert (dec.block(payload, marks[1:], n - H.STRIDE) == ids[at + H.STRIDE : at + n]).all()
        at += n


def test_round_trip(spark, odd_docs, no_docs, syllables):
    df = odd_docs.select("doc_id", "text").union(docs_of(spark, [(100 + i, syllables(50, i) + " éà😀\n\n") for i in range(30)]).select("doc_id", "text"))
    out = rows_of(H.huffman(df))
    book = next(r for r in out if r["kind"] == "codebook")
    dec, enc = H.Decoder(np.frombuffer(book["payload"], np.uint8)), H.encoder(H.load_ranks(H.VOCABULARY))
    blocks = [r for r in out if r["kind"] == "block"]
    assert book["n_tokens"] == sum(r["n_tokens"] for r in blocks)
    texts = collections.defaultdict(list)
    for r in rows_of(df):
        texts[r["doc_id"]].append(r["text"] or "")
    for i, want in texts.items():
        mine = sorted((r for r in blocks if r["doc_id"] == i), key=lambda r: r["block"])
        if len(want) == 1:
            assert enc.decode(np.concatenate([dec.block(r["payload"], r["checkpoints"], r["n_tokens"]) for r in mine]).tolist()) == want[0]
    empty = rows_of(H.huffman(no_docs))
    assert len(empty) == 1 and empty[0]["kind"] == "codebook" and not any(empty[0]["payload"])


def test_ids_of_long_texts_are_those_of_the_whole(syllables):
    enc = H.encoder(H.load_ranks(H.VOCABULARY))
    rng = random.Random(3)
    parts = ["a", "word", " ", "  ", "\n", "\u00a0", "\u3000 ", "\t\t", "'s", "12", "!?", "é", "\x1c", " x", "    "]
    for _ in range(300):
        text = "".join(rng.choices(parts, k=rng.randint(0, 40)))
        assert H.tokenise(enc, text, rng.randint(1, 9), rng.randint(2, 6)).tolist() == enc.encode(text), repr(text)
    text = syllables(60_000, 1)
    assert len(text) > 250_000 and H.tokenise(enc, text, 100_000).tolist() == enc.encode(text)
    assert H.tokenise(enc, "x" * 300_000, 1_000).tolist() == enc.encode("x" * 300_000)
    blanks = H.tokenise(enc, "a" + " " * 1_000_000 + "x")  # more than the pattern's engine can go back over
    assert enc.decode(blanks.tolist()) == "a" + " " * 1_000_000 + "x" and blanks.tolist()[-1:] == enc.encode(" x")


LAYOUTS = [
    ({"id": 1, "messages": [{"role": "system", "content": "be kind"}, {"role": "USER", "content": "hi"}, {"role": "assistant", "content": "hello"}]}, "messages", [("system", "be kind"), ("user", "hi"), ("assistant", "hello")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, "messages_parts", [("user", "a\nb")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "sharegpt", [("user", "q"), ("assistant", "a")]),
    ({"instruction": "add", "input": "1 2", "output": "3"}, "instruction_input", [("user", "add\n\n1 2"), ("assistant", "3")]),
    ({"instruction": "add", "input": None, "output": "3"}, "instruction", [("user", "add"), ("assistant", "3")]),
    ({"instruction": "why", "context": "c", "response": "r"}, "instruction_response", [("user", "why\n\nc"), ("assistant", "r")]),
    ({"prompt": "p", "completion": "c", "extra": {"x": [1]}}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ({"system": "s", "prompt": "p", "response": ""}, "prompt_response", [("system", "s"), ("user", "p")]),
    ({"question": "q", "answer": "a", "context": "k"}, "question_answer", [("user", "k\n\nq"), ("assistant", "a")]),
    ({"data": {"prompt": {"text": "p"}, "reply": {"text": "r"}}}, "nested_chat", [("user", "p"), ("assistant", "r")]),
    ({"dialogue": ["a", "b", "c"]}, "dialogue", [("user", "a"), ("assistant", "b"), ("user", "c")]),
    ({"conv_id": 4, "turn": 3, "role": "Human", "text": "t"}, "flat_turn", [("user", "t")]),
]


def test_layouts(spark):
    records = [(json.dumps(r),) for r, _, _ in LAYOUTS] + [("nonsense",), (None,), ("[1]",), ('{"a": 1}',), ('{"prompt": "", "completion": ""}',)]
    out = rows_of(C.to_turns(spark.createDataFrame(records, "json string")))
    for record, name, turns in LAYOUTS:
        mine = [r for r in out if r["layout"] == name]
        assert [(r["role"], r["content"]) for r in sorted(mine, key=lambda r: r["turn"])] == turns, name
        assert {r["fingerprint"] for r in mine} == {C.fingerprint(C.paths(record))}
    assert sum(r["layout"] == C.UNKNOWN for r in out) == 4 and sum(r["layout"] == C.EMPTY for r in out) == 1
    assert next(r for r in out if r["layout"] == "flat_turn")["turn"] == 3


def test_fingerprint_is_of_paths_alone():
    a, b = {"x": [{"k": 1}, {"k": 2, "j": None}], "y": "v"}, {"y": "w", "x": [{"k": 9}]}
    assert C.fingerprint(C.paths(a)) == C.fingerprint(C.paths(b)) != C.fingerprint(C.paths({"y": 1}))


def test_chat_odd_cases(spark):
    rows = [(None, None, None, None), (1, 0, "user", ""), (1, 0, None, "no role"), (1, 0, None, "no role"), (2, 2**40, "Robot", "x" * 200_000), (3, None, "user", "no turn")]
    t = spark.createDataFrame([(*r, None) for r in rows], "conv_id bigint, turn bigint, role string, text string, layout string")
    out = rows_of(C.table_to_turns(t))
    assert len(out) == 6
    assert sorted(r["layout"] for r in out) == ["empty", "flat_turn", "flat_turn", "flat_turn", "unknown", "unknown"]
    assert {r["role"] for r in out} == {None, "user", "robot"}
    assert C.table_to_turns(t.limit(0)).count() == 0
    bad = spark.createDataFrame([('{"prompt": "\\ud800", "completion": "ok"}',), ("[" * 100_000,)], "json string")
    assert C.to_turns(bad).count() == 3


def _only(record):
    return [(n, r, c) for _, n, r, c, *_ in C.canonical(record if isinstance(record, str) else json.dumps(record), {})]


def test_chat_deep_nesting():
    for depth in (10, 900, 3_000, 100_000):
        deep = "[" * depth + '"a"' + "]" * depth
        got = _only('{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": ' + deep + "}]}")
        assert got in ([(0, "user", "q"), (1, "assistant", "a")], [(0, None, None)]) and (depth > 900 or got[0][1])
        obj = '{"k":' * depth + "1" + "}" * depth
        got = _only('{"prompt": "p", "completion": ' + obj + "}")
        assert got in ([(0, "user", "p"), (1, "assistant", obj)], [(0, None, None)])


def test_chat_keys_that_look_like_paths():
    assert C.canonical('{"data.prompt.text": "p", "data.reply.text": "r"}', {})[0][4] == C.UNKNOWN
    assert C.paths({"a.b": 1, "c[]": 2, "d\ne": 3, "f": {"g": [4]}}) == {r"a\.b", r"c\[\]", r"d\ne", "f.g[]"}
    assert C.fingerprint(C.paths({"a.b": 1})) != C.fingerprint(C.paths({"a": {"b": 1}}))


def test_chat_mixed_arrays_and_numbers():
    assert _only({"messages": [{"role": "system", "content": "s"}, "plain", None, ["x", {"text": "y"}, {"n": 1}], {"role": "ai", "content": 5}]}) == [
        (0, "system", "s"), (1, "user", "plain"), (2, "user", 'x\ny\n{"n":1}'), (3, "assistant", "5"),
    ]
    for turn, want in ((3, 3), (3.0, 3), ("3", 3), (" 4 ", 4), (2.5, 0), ("x", 0), (True, 0), (2**70, 0), (1e300, 0), ([], 0)):
        assert _only({"turn": turn, "text": "t", "x": 1}) == ([(want, "user", "t")] if turn != [] else [(0, None, None)])


def test_chat_query_over_layouts(spark):
    rows = [(i, t, r, x) for i in range(12) for t, r, x in ((0, "system", f"s{i}"), (1, "user", f'u"{i}\n'), (2, "assistant", f"ä{i}"))]
    out = rows_of(C.to_turns(queries.as_layouts(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))))
    assert {r["layout"] for r in out} == {"flat_turn", "messages", "sharegpt", "messages_parts", "prompt_response"}
    assert sorted((int(r["conv_id"]), r["role"], r["content"]) for r in out) == sorted((i, r, x) for i, _, r, x in rows)
