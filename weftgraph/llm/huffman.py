"""Token ids as canonical, length-limited Huffman code.

Texts become token ids by a public byte-pair vocabulary, whose path is a
parameter; the vocabulary is sent to the workers once. The ids are counted over the
whole table, the package-merge algorithm gives the best code of at most
``MAX_BITS`` bits a token for these counts, and canonical order makes the code a
function of its lengths, so that one byte an id is all that a decoder needs.

Each document is cut into independent blocks of ``BLOCK`` tokens, each padded to a
whole byte; ``checkpoints`` holds the bit offset of every ``STRIDE``-th token, from
which decoding can begin. The decoder looks ``MAX_BITS`` bits up in a table and
decodes all checkpoints of a block side by side.

The result has one row of kind ``codebook`` (doc_id null; payload: the length of each
id's code as one byte, 0 for an id that doesn't occur; n_tokens: all tokens) and a row of kind
``block`` for each block. Ids are written once to the checkpoint folder between
counting and coding, so that no text is tokenised twice.

Cases: a null or empty text is one block of 0 tokens; a single distinct id has a code of
1 bit; an empty table gives the codebook row with no codes; repeated rows are coded
each; extra columns aren't read; ids of documents are integers. A text of any length has the ids of
its whole: a long one is tokenised piece by piece, cut only where the vocabulary's pattern ends a token.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, released

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenisation pattern that goes with the vocabulary (that of GPT-2, as published).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_BITS = 18
BLOCK = 32_768
STRIDE = 1_024
#: Characters after which a text is cut at the next place where it may be.
PIECE = 1_000_000
#: Runs of blanks from this length on don't go through the pattern, whose lookahead overflows at some hundred thousand.
RUN = 20_000
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # what \s is in the pattern
SLICE = 1_000_000
SCHEMA = "kind string, doc_id bigint, block int, n_tokens bigint, n_bits bigint, checkpoints array<int>, payload binary"
_NAMES = ["kind", "doc_id", "block", "n_tokens", "n_bits", "checkpoints", "payload"]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encoder(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, piece: int = PIECE, run: int = RUN) -> Iterator[tuple[str, bool]]:
    """The text in parts, each with True if it is a single pre-token.

    The pattern ends a token at each blank that follows something else, whatever comes next, and
    in a run of blanks at its end or, if another character follows, before the last blank.
    """
    if len(text) <= min(piece, run):
        yield text, False
        return
    edge = re.compile(f"(?<=[^{_BLANK}])[{_BLANK}]")

    def cut(start: int, stop: int) -> Iterator[tuple[str, bool]]:
        while stop - start > piece and (m := edge.search(text, start + piece, stop)):
            yield text[start : m.start()], False
            start = m.start()
        if stop > start:
            yield text[start:stop], False

    at = 0
    for m in re.finditer(f"[{_BLANK}]{{{run},}}", text):
        end = m.end() - (m.end() < len(text))
        yield from cut(at, m.start())
        yield text[m.start() : end], True
        at = end
    yield from cut(at, len(text))


def tokenise(enc, text: str | None, piece: int = PIECE, run: int = RUN) -> np.ndarray:
    """The ids of the whole text."""
    parts = [np.asarray(enc._encode_single_piece(x), np.uint32) if single else enc.encode_to_numpy(x) for x, single in pieces(text or "", piece, run)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits, by package-merge; 0 where the count is 0."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts > 0)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 2**limit:
        raise ValueError(f"{n} symbols don't fit in codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64 if counts.sum() * limit >= 2**62 else np.int64)
    is_leaf: list[np.ndarray] = []
    items = leaf
    is_leaf.append(np.ones(n, bool))
    for _ in range(limit - 1):
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate((leaf, pairs))
        rank = np.argsort(merged, kind="stable")
        is_leaf.append(rank < n)
        items = merged[rank]
    take = 2 * (n - 1)
    lengths = np.zeros(n, np.int64)
    for flags in reversed(is_leaf):
        leaves = int(flags[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: in order of (length, id), each the last plus one, widened with zeros."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    size = lengths[order].astype(np.int64)
    codes = np.zeros(len(lengths), np.uint64)
    if len(order):
        top = int(size[-1])
        step = np.left_shift(1, top - size)  # as if all codes were of the longest length
        codes[order] = (np.concatenate(([0], np.cumsum(step)[:-1])) >> (top - size)).astype(np.uint64)
    return codes


def encode_blocks(ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> list[tuple[int, np.ndarray, bytes]]:
    """(bits, checkpoints, payload) of consecutive blocks of so many ids each."""
    if not len(ids):
        return [(0, np.zeros(0, np.int32), b"") for _ in sizes]
    first = np.concatenate(([0], np.cumsum(sizes)))
    size = lengths[ids].astype(np.int64)
    total = np.concatenate(([0], np.cumsum(size)))
    bits = total[first[1:]] - total[first[:-1]]
    words = (bits + 31) >> 5
    base = np.concatenate(([0], np.cumsum(words)))
    off = total[:-1] - np.repeat(total[first[:-1]], sizes)  # of each token within its block
    word = np.repeat(base[:-1], sizes) + (off >> 5)
    value = codes[ids] << (64 - (off & 31) - size).astype(np.uint64)
    n = int(base[-1]) + 1
    # codes never overlap, hence sums are unions, and below 2^53 the float sums are exact
    out = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n)
    out += np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n + 1)[:n]
    raw = out.astype(np.uint32).astype(">u4").tobytes()
    return [(int(b), off[a:z:STRIDE].astype(np.int32), raw[4 * w : 4 * w + ((int(b) + 7) >> 3)]) for a, z, b, w in zip(first[:-1], first[1:], bits, base[:-1])]


class Decoder:
    """Table-driven decoder for the canonical code of the given lengths."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, np.int64)
        self.top = int(lengths.max(initial=1))
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        span = np.left_shift(1, self.top - lengths[order])
        pad = (1 << self.top) - int(span.sum())
        self.symbol = np.concatenate((np.repeat(order, span), np.zeros(pad, np.int64)))
        self.length = np.concatenate((np.repeat(lengths[order], span), np.ones(pad, np.int64)))

    def block(self, payload: bytes, checkpoints, n_tokens: int) -> np.ndarray:
        """The ids of a block, all of its checkpoints decoded side by side."""
        if not n_tokens:
            return np.zeros(0, np.int64)
        data = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint64)
        window = sum(data[i : len(data) - 4 + i] << np.uint64(32 - 8 * i) for i in range(5))  # 40 bits from each byte
        at = np.asarray(checkpoints, np.int64).copy()
        out = np.zeros((len(at), STRIDE), np.int64)
        left = np.minimum(STRIDE, n_tokens - STRIDE * np.arange(len(at)))
        for j in range(int(left.max())):
            live = np.flatnonzero(left > j)
            p = at[live]
            key = ((window[p >> 3] >> (40 - self.top - (p & 7)).astype(np.uint64)) & np.uint64((1 << self.top) - 1)).astype(np.int64)
            out[live, j] = self.symbol[key]
            at[live] += self.length[key]
        return np.concatenate([row[:n] for row, n in zip(out, left)])


def token_ids(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids as little-endian 16-bit numbers, or 32-bit ones for vocabularies of more than 65,536."""
    ranks = load_ranks(vocabulary)
    kind = id_type(len(ranks))
    sent = docs.sparkSession.sparkContext.broadcast(ranks)  # of the vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 1_000):
                part = batch.slice(i, 1_000)
                ids = [tokenise(enc, t.as_py()).astype(kind).tobytes() for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(run), "doc_id bigint, ids binary")


def id_type(n_ids: int) -> str:
    return "<u2" if n_ids <= 2**16 else "<u4"


def id_counts(ids: DataFrame, n_ids: int) -> np.ndarray:
    """How often each id occurs; what comes to the driver is bounded by the vocabulary."""
    kind = id_type(n_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(n_ids, np.int64)
        for batch in batches:
            for x in batch.column(0):
                count += np.bincount(np.frombuffer(x.as_py(), kind), minlength=n_ids) if len(x.as_py()) > n_ids else 0
            short = b"".join(x.as_py() for x in batch.column(0) if len(x.as_py()) <= n_ids)
            count += np.bincount(np.frombuffer(short, kind), minlength=n_ids)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used])], names=["id", "n"])

    out = np.zeros(n_ids, np.int64)
    for i, n in ids.select("ids").mapInArrow(released(run), "id bigint, n bigint").groupBy("id").agg(F.sum("n")).collect():
        out[i] = n
    return out


def huffman(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """Rows of kind ``codebook`` and ``block`` as described above."""
    spark = docs.sparkSession
    n_ids = len(load_ranks(vocabulary))
    kind = id_type(n_ids)
    ids = durable(token_ids(docs, vocabulary, id_col, text_col))
    counts = id_counts(ids, n_ids)
    lengths = code_lengths(counts, max_bits)
    sent = spark.sparkContext.broadcast((lengths, canonical_codes(lengths)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lens, codes = sent.value
        for batch in batches:
            tokens = [np.frombuffer(x.as_py(), kind) for x in batch.column("ids")]
            start = 0
            while start < len(tokens):
                stop, size = start, 0
                while stop < len(tokens) and (stop == start or size + len(tokens[stop]) <= SLICE):
                    size += len(tokens[stop])
                    stop += 1
                yield from _slice(batch.column("doc_id").slice(start, stop - start), tokens[start:stop], lens, codes)
                start = stop

    blocks = ids.mapInArrow(released(run), SCHEMA)
    book = spark.createDataFrame([("codebook", None, -1, int(counts.sum()), None, None, lengths.tobytes())], SCHEMA)
    return blocks.union(book)


def _slice(doc_ids: pa.Array, tokens: list[np.ndarray], lens: np.ndarray, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
    per = np.array([max(1, -(-len(t) // BLOCK)) for t in tokens])
    row = np.repeat(np.arange(len(tokens)), per)
    number = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    sizes = np.minimum(BLOCK, np.array([len(t) for t in tokens])[row] - BLOCK * number)
    done = encode_blocks(np.concatenate(tokens), sizes, lens, codes)
    arrays = [
        pa.array(["block"] * len(row)), doc_ids.take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(sizes.astype(np.int64)),
        pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.list_(pa.int32())), pa.array([d[2] for d in done], pa.binary()),
    ]
    yield pa.RecordBatch.from_arrays(arrays, names=_NAMES)
