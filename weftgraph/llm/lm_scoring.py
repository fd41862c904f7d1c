"""Language-model scoring by deleted interpolation.

The model predicts each word, and the end of the text, from the word before it (the text's start
for the first):

    p(w | v) = l3(b) c(v, w) / c(v) + l2(b) c(w) / N + l1(b) / V

where b is the bucket of the context's frequency c(v), by powers of two. The mixture
weights of each bucket are learned by expectation-maximisation on held-out counts:
documents whose id hashes to one residue of ``HELD_OUT`` are held out, the estimates
come from the others. The scores then use the counts of all documents less all that the text itself
has of them, so that a text isn't scored by its own words, however often it repeats them.

Nothing is sampled or pruned, and no model is broadcast. The table is cut in blocks of about ``CHUNK``
bytes of text; a block is kept as its word indices and 64-bit word
hashes. Each block sends its distinct words and word pairs, with counts, to the
shards that own their hashes, and each shard answers each block with the
corpus-wide counts in the order of the question. A frequent pair thus costs one entry a
block, wherever it occurs, and no key is hot. What is gathered grows with the corpus;
it is spread over the shards, of about ``SHARD`` words each, so that a shard's size doesn't grow. The number of
messages is that of blocks times that of shards: for a corpus of hundreds of terabytes give a larger ``chunk`` and
fewer ``shards``, as the workers' memory allows (some fifteen times a block's bytes, thirty bytes for each word of a shard).

Cases: a null, empty or wordless text isn't counted and has n_tokens 0 and null
scores; repeated rows count as often as they occur and give repeated rows; an
empty table gives an empty result; without held-out documents, or with a bucket that none of
their contexts fall in, the weights are those of all buckets together, or equal ones.
Extra columns, also of clashing names, aren't read. A text of any length is scored in whole, as one block. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, released, shuffle_partitions
from .textvec import chunks, combine, mix64, words

HELD_OUT = 10
BUCKETS = 32
CHUNK = 8_000_000
#: Words of a shard, on average.
SHARD = 2_000_000
#: Cells of the held-out histogram for each power of two of a relative frequency.
CELLS = 4
EDGE = np.uint64(0xA0761D6478BD642F)  # the start and the end of a text
ONE = np.uint64(1)

INDEX = "block string, held boolean, ids array<bigint>, sizes array<int>, vocab binary, words binary"
QUESTION = "shard int, block string, held boolean, n int, keys binary, counts binary"
ANSWER = "block string, shard int, held boolean, all_counts binary, train_counts binary, types bigint, tokens bigint, train_tokens bigint"
SCORE = "doc_id bigint, n_tokens bigint, log_prob double, perplexity double"


def _squeeze(x: np.ndarray) -> bytes:
    """Little-endian numbers by byte planes, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _open(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def _index(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            for part in chunks(batch, "text", chunk):
                h, bounds = words(part.column("text"))
                sizes = np.diff(bounds)
                held = part.column("held").to_numpy(zero_copy_only=False)
                vocab, idx = np.unique(h, return_inverse=True)
                for flag in (False, True):
                    mine = np.flatnonzero((held == flag) & (sizes > 0))
                    if len(mine):
                        chosen = np.repeat((held == flag) & (sizes > 0), sizes)
                        used, local = np.unique(idx[chosen], return_inverse=True)
                        row = [f"{task}-{number}"], [flag], [part.column("doc_id").take(pa.array(mine)).to_pylist()], [sizes[mine].tolist()], [_squeeze(vocab[used])], [_squeeze(local.astype(np.uint32))]
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()))], names=["block", "held", "ids", "sizes", "vocab", "words"])
                        number += 1

    return run


class Block:
    """Words, contexts and sorted distinct keys of a block."""

    def __init__(self, sizes: np.ndarray, vocab: bytes, local: bytes):
        vocab, idx = _open(vocab, np.uint64), _open(local, np.uint32).astype(np.int64)
        edge = len(vocab)
        self.first = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))  # of each document's predictions
        n = int((sizes + 1).sum())
        ends = self.first + sizes
        word = np.empty(n, np.int64)
        is_end = np.zeros(n, bool)
        is_end[ends] = True
        word[is_end] = edge
        word[~is_end] = idx
        context = np.concatenate(([edge], word[:-1]))  # after an end comes the next text's start
        pair, self.of_token, self.n_pair = np.unique(context * (edge + 1) + word, return_inverse=True, return_counts=True)
        self.v, self.w = pair // (edge + 1), pair % (edge + 1)
        names = np.concatenate((vocab, [EDGE]))
        single = mix64(names) & ~ONE  # even keys are words, odd ones pairs
        double = combine(names[self.v], names[self.w]) | ONE
        keys = np.concatenate((single, double))
        counts = np.concatenate((np.bincount(word, minlength=edge + 1), self.n_pair))
        self.order = np.argsort(keys)
        self.keys, self.counts, self.n_words = keys[self.order], counts[self.order].astype(np.uint32), len(single)

    def looked_up(self, answer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """c(v, w), c(v) and c(w) for each distinct pair, from counts in the keys' order."""
        c = np.empty(len(answer), np.float64)
        c[self.order] = answer
        return c[self.n_words :], c[self.v], c[self.w]

    def by_text(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, own c(v, w), own c(v), own c(w)) of each distinct pair of each text."""
        n_pairs, n_words = len(self.v), self.n_words
        key = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(self.of_token)))) * n_pairs
        key += self.of_token
        key, own = np.unique(key, return_counts=True)
        text, pair = key // n_pairs, key % n_pairs
        # a word is as often a context as it is a word, and each text has one start and one end
        of_word = text * n_words + self.w[pair]
        order = np.argsort(of_word, kind="stable")
        names, at = np.unique(of_word[order], return_index=True)
        sums = np.add.reduceat(own[order], at)
        return text, pair, own, sums[np.searchsorted(names, text * n_words + self.v[pair])], sums[np.searchsorted(names, of_word)]


def _block(row: dict) -> Block:
    return Block(np.asarray(row["sizes"], np.int64), row["vocab"], row["words"])


def _ask(shards: int):
    edges = np.array([(i << 64) // shards for i in range(1, shards)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _block(row)
                cut = np.concatenate(([0], np.searchsorted(b.keys, edges), [len(b.keys)]))
                sent = np.flatnonzero(np.diff(cut))
                spans = [slice(cut[s], cut[s + 1]) for s in sent]
                arrays = [
                    pa.array(sent.astype(np.int32)), pa.array([row["block"]] * len(sent)), pa.array([row["held"]] * len(sent)), pa.array(np.diff(cut)[sent].astype(np.int32)),
                    pa.array([_squeeze(b.keys[s]) for s in spans], pa.binary()), pa.array([_squeeze(b.counts[s]) for s in spans], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["shard", "block", "held", "n", "keys", "counts"])

    return run


def _answer(key: tuple, asked: pa.Table) -> pa.Table:
    sizes = asked["n"].to_numpy().astype(np.int64)
    held = asked["held"].to_numpy()
    keys = np.concatenate([_open(x.as_py(), np.uint64) for x in asked["keys"]])
    counts = np.concatenate([_open(x.as_py(), np.uint32) for x in asked["counts"]]).astype(np.int64)
    train = np.where(np.repeat(held, sizes), 0, counts)
    order = np.argsort(keys)
    sorted_keys = keys[order]
    new = np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))
    first = np.flatnonzero(new)
    group = np.empty(len(keys), np.int64)
    group[order] = np.cumsum(new) - 1
    total, kept = np.add.reduceat(counts[order], first), np.add.reduceat(train[order], first)
    cut = np.concatenate(([0], np.cumsum(sizes)))
    every = [_squeeze(total[group[a:z]]) for a, z in zip(cut[:-1], cut[1:])]
    of_train = [_squeeze(kept[group[a:z]]) if h else None for a, z, h in zip(cut[:-1], cut[1:], held)]
    single = (sorted_keys[first] & ONE) == 0
    shard = key[0].as_py()
    n = len(sizes)
    return pa.table(
        {
            "block": pa.array([*asked["block"].to_pylist(), None], pa.string()),
            "shard": pa.array([shard] * (n + 1), pa.int32()),
            "held": pa.array([*held.tolist(), None], pa.bool_()),
            "all_counts": pa.array([*every, None], pa.binary()),
            "train_counts": pa.array([*of_train, None], pa.binary()),
            "types": pa.array([None] * n + [int(single.sum())], pa.int64()),
            "tokens": pa.array([None] * n + [int(total[single].sum())], pa.int64()),
            "train_tokens": pa.array([None] * n + [int(kept[single].sum())], pa.int64()),
        }
    )


def bucket(context_count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the floor of the binary logarithm."""
    return np.minimum(BUCKETS - 1, np.where(context_count > 0, 1 + np.floor(np.log2(np.maximum(context_count, 1))), 0)).astype(np.int64)


def _cell(f: np.ndarray) -> np.ndarray:
    return np.where(f > 0, 1 + np.floor(-CELLS * np.log2(np.where(f > 0, f, 1))), 0).astype(np.int64)


def ratio(a: np.ndarray, b) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=np.asarray(b) > 0)


def learn_weights(cells: np.ndarray, f0: float, rounds: int = 1000) -> np.ndarray:
    """Weights (BUCKETS, 3) of uniform, word and pair estimates by EM.

    ``cells`` has rows (bucket, mean word estimate, mean pair estimate, held-out count).
    """

    def em(rows: np.ndarray) -> np.ndarray:
        lam = np.full(3, 1 / 3)
        p = np.stack((np.full(len(rows), f0), rows[:, 1], rows[:, 2]), axis=1)
        for _ in range(rounds):
            part = p * lam
            part *= (rows[:, 3] / np.maximum(part.sum(axis=1), 1e-300))[:, None]
            new = part.sum(axis=0) / max(part.sum(), 1e-300)
            if np.abs(new - lam).max() < 1e-12:
                return new
            lam = new
        return lam

    if not len(cells):
        return np.full((BUCKETS, 3), 1 / 3)
    every = em(cells)
    return np.stack([em(x) if len(x := cells[cells[:, 0] == b]) else every for b in range(BUCKETS)])


def held_out_cells(c2: np.ndarray, cv: np.ndarray, cw: np.ndarray, n: np.ndarray, tokens: float) -> dict[tuple[int, int, int], tuple[float, float, float]]:
    """Sums of (count, count * word estimate, count * pair estimate) by (bucket, cell of either estimate)."""
    f2, f3 = ratio(cw, tokens), ratio(c2, cv)
    key = (bucket(cv) * 4096 + _cell(f2)) * 4096 + _cell(f3)
    u, inv = np.unique(key, return_inverse=True)
    sums = [np.bincount(inv, x) for x in (n, n * f2, n * f3)]
    return {(int(k) >> 24, (int(k) >> 12) & 4095, int(k) & 4095): (float(a), float(b), float(c)) for k, a, b, c in zip(u, *sums)}


def log_probs(c2: np.ndarray, cv: np.ndarray, cw: np.ndarray, tokens: np.ndarray, types: int, weights: np.ndarray) -> np.ndarray:
    """ln p of each pair from the counts of the other texts."""
    lam = weights[bucket(cv)]
    p = lam[:, 0] / types + lam[:, 1] * ratio(cw, tokens) + lam[:, 2] * ratio(c2, cv)
    return np.log(np.maximum(p, 1e-300))


def _assembled(answers: pa.Table, column: str) -> np.ndarray:
    order = np.argsort(answers["shard"].to_numpy())
    col = answers[column].combine_chunks()
    return np.concatenate([_open(col[int(i)].as_py(), np.int64) for i in order]).astype(np.float64)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_tokens, log_prob, perplexity), one row for each document; n_tokens counts the text's end."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    index = durable(base.where("text is not null").select("doc_id", "text", held.alias("held")).mapInArrow(released(_index(chunk)), INDEX))
    if shards is None:
        n_words = index.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda n, x: n + x))).first()[0] or 0
        shards = max(2 * shuffle_partitions(spark), -(-n_words // SHARD))
    answers = durable(index.mapInArrow(released(_ask(shards)), QUESTION).groupBy("shard").applyInArrow(_answer, ANSWER))
    sums = answers.where("block is null").agg(F.sum("types"), F.sum("tokens"), F.sum("train_tokens")).first()
    types, tokens, train_tokens = (int(x or 0) for x in sums)
    replies = answers.where("block is not null").select("block", "shard", "held", "all_counts", "train_counts")

    def cells(key: tuple, block: pa.Table, reply: pa.Table) -> pa.Table:
        out: dict[tuple[int, int, int], np.ndarray] = {}
        for row in block.to_pylist():
            b = _block(row)
            for k, x in held_out_cells(*b.looked_up(_assembled(reply, "train_counts")), b.n_pair.astype(float), float(train_tokens)).items():
                out[k] = out.get(k, 0) + np.array(x)
        k, x = np.array(list(out), np.int32).reshape(-1, 3), np.array(list(out.values())).reshape(-1, 3)
        return pa.table({n: pa.array(c) for n, c in zip(("b", "q2", "q3", "n", "f2", "f3"), (*k.T, *x.T))})

    found = index.where("held").groupBy("block").cogroup(replies.where("held").groupBy("block"))
    found = found.applyInArrow(cells, "b int, q2 int, q3 int, n double, f2 double, f3 double").groupBy("b", "q2", "q3").agg(*(F.sum(c) for c in ("n", "f2", "f3")))
    rows = np.array([tuple(r) for r in found.collect()], np.float64).reshape(-1, 6)  # bounded by buckets and cells
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    weights = learn_weights(np.stack((rows[:, 0], rows[:, 4] / rows[:, 3], rows[:, 5] / rows[:, 3], rows[:, 3]), axis=1), 1 / max(types, 1))

    def score(key: tuple, block: pa.Table, reply: pa.Table) -> pa.Table:
        out = []
        for row in block.to_pylist():
            b = _block(row)
            n = np.asarray(row["sizes"], np.int64) + 1
            c2, cv, cw = b.looked_up(_assembled(reply, "all_counts"))
            text, pair, own2, own_v, own_w = b.by_text()
            lp = log_probs(c2[pair] - own2, cv[pair] - own_v, cw[pair] - own_w, float(tokens) - n[text], types, weights)
            total = np.bincount(text, own2 * lp, len(n))
            out.append(pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "n_tokens": pa.array(n), "log_prob": pa.array(total), "perplexity": pa.array(np.exp(np.minimum(-total / n, 700)))}))
        return pa.concat_tables(out)

    scored = index.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, SCORE)
    return scored.union(_unscored(base))


def _unscored(base: DataFrame) -> DataFrame:
    """Texts without a word, as :mod:`textvec` sees words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, bounds = words(batch.column("text"))
            yield batch.select(["doc_id"]).filter(pa.array(np.diff(bounds) == 0))

    # Few texts have no letter or digit of any kind; only these reach Python.
    bare = base.where(F.col("text").isNull() | ~F.col("text").rlike(r"[a-zA-Z0-9]"))
    none = bare.mapInArrow(released(run), "doc_id bigint")
    return none.select("doc_id", F.lit(0).cast("bigint").alias("n_tokens"), F.lit(None).cast("double").alias("log_prob"), F.lit(None).cast("double").alias("perplexity"))
