"""Packing documents into training windows by the sum-of-squares rule.

Documents become token ids of a public byte-pair vocabulary and arrive one by one. Of the
``window`` possible fill levels an array keeps how many open windows stand at each; a
piece of ``s`` tokens goes to the level ``h`` (0 opens a new window) that leaves the sum of
the squared counts smallest. With N(0) = N(window) = 0 by convention, moving a window from h to h + s
changes that sum by 2 (N(h + s) - N(h) + 1), or N(h + s) and N(h) alone where the other end
is a new or a full window; ties take the fullest level. A document longer than a
window fills whole windows first and its remainder is packed like others.

The rule is online, so a stream is what one task reads: each partition of the input, in the order of its
rows. Nothing is shuffled and no key decides where a row goes, so no id, source or group of copies can
be hot; a task keeps the levels and its batch, whatever the table's size. The placement
follows the partitions of the input (a written table's splits, the same at each reading with the same settings); at
most the windows that a task leaves open aren't full, which :func:`pack_report` measures.

The result has one row for each piece, with its token ids (little-endian, 16 bits, or 32 for vocabularies of more than
65,536): a window is its pieces in order of ``start``, a document its pieces of one ``row_id`` in order of ``piece``.
``row_id`` numbers the input's rows, so that the copies of a document that mixing emits are told apart.

Cases: a null or empty text has 0 tokens and takes no place (one row, window_id and start null, no ids);
repeated rows, null ids and ties are rows like others, placed one after another; an empty table gives
an empty result. A text of any length is packed in whole. Extra columns are not read. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released
from .huffman import VOCABULARY, encoder, id_type, load_ranks, tokenise

WINDOW = 2048
SCHEMA = "row_id bigint, doc_id bigint, piece int, window_id bigint, start int, n_tokens int, tokens binary"
#: Rows of an output batch, and tokens after which one ends.
ROWS, TOKENS = 1_000, 1_000_000
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
_NAMES = ["row_id", "doc_id", "piece", "window_id", "start", "n_tokens", "tokens"]


class Packer:
    """The level array and the open windows of one stream."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.open_at: list[list[int]] = [[] for _ in range(window + 1)]
        self.opened = 0

    def place(self, s: int) -> tuple[int, int]:
        """(window, start) of a piece of ``s`` tokens, 1 to ``window``."""
        window, counts = self.window, self.counts
        h = 0
        if s < window:
            # change of the sum of squares for h = 0 .. window - s
            cost = 2 * (counts[s:] - counts[: window - s + 1]) + 2
            cost[1:][counts[1 : window - s + 1] == 0] = np.iinfo(np.int64).max
            cost[0] = 2 * counts[s] + 1
            if counts[window - s]:
                cost[window - s] = 1 - 2 * counts[window - s]
            h = len(cost) - 1 - int(np.argmin(cost[::-1]))
        if h == 0:
            at, self.opened = self.opened, self.opened + 1
        else:
            at = self.open_at[h].pop()
            counts[h] -= 1
        if h + s < window:
            counts[h + s] += 1
            self.open_at[h + s].append(at)
        return at, h


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, doc_id, piece, window_id, start, n_tokens, tokens): where each piece of each document lies, and its ids."""
    ranks = load_ranks(vocabulary)
    kind = id_type(len(ranks))
    sent = docs.sparkSession.sparkContext.broadcast(ranks)  # of the vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(sent.value), Packer(window)
        base = TaskContext.get().partitionId() << 40
        row, held, out = 0, 0, []

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=_NAMES)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = tokenise(enc, text.as_py()).astype(kind)
                if not len(ids):
                    out.append((base + row, doc_id, 0, None, None, 0, b""))
                for piece, at in enumerate(range(0, len(ids), window)):
                    part = ids[at : at + window]
                    where, start = packer.place(len(part))
                    out.append((base + row, doc_id, piece, base + where, start, len(part), part.tobytes()))
                row, held = row + 1, held + len(ids)
                if len(out) >= ROWS or held >= TOKENS:
                    yield full()
                    held, out = 0, []
        if out:
            yield full()

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(run), SCHEMA)


def pack_report(packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row: pieces, windows, tokens and the share of the windows that is filled."""
    used = packed.where("window_id is not null")
    return used.agg(F.count(F.lit(1)).alias("pieces"), F.countDistinct("window_id").alias("windows"), F.sum("n_tokens").alias("tokens")).withColumn(
        "filled", F.col("tokens") / (F.col("windows") * window)
    )


__all__ = ["WINDOW", "Packer", "pack", "pack_report"]
