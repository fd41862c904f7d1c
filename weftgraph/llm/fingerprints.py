"""Document fingerprints by a homomorphic multiset hash.

A document is the multiset of its paragraphs (lines that aren't blank, without
blanks at their ends). Each paragraph is hashed by SHAKE-128 to a vector of
``LANES`` numbers of 16 bits, and the fingerprint is the vectors' sum modulo 2^16
in each lane. Hence documents with the same paragraphs in any order have equal
fingerprints, and a paragraph is inserted or deleted by adding or subtracting
its vector (:func:`insert`, :func:`delete`), without the rest of the document.

Cases: a null, empty or blank text is the empty multiset, whose vector is zero;
repeated paragraphs count as often as they occur; repeated rows give repeated
rows; an empty table gives an empty result; extra columns aren't read. A text
of any length is hashed in whole, in slices of paragraphs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANES = 256
#: Paragraphs that are summed at once, which bounds a worker's memory.
SLICE = 20_000
SCHEMA = "doc_id bigint, n_paragraphs bigint, digest string, lanes binary"
BLANK = " \t\r\f\v"


def paragraphs(text: str | None) -> list[bytes]:
    """Split at line feeds alone; str.splitlines would also split at other characters."""
    return [b for b in (p.strip(BLANK).encode("utf-8", "surrogatepass") for p in (text or "").split("\n")) if b]


def vectors(parts: Iterable[bytes]) -> np.ndarray:
    size = 2 * LANES
    joined = b"".join([hashlib.shake_128(p).digest(size) for p in parts])
    return np.frombuffer(joined, dtype="<u2").reshape(-1, LANES)


def total(parts: list[bytes]) -> np.ndarray:
    out = np.zeros(LANES, dtype="<u2")
    for i in range(0, len(parts), SLICE):
        out += vectors(parts[i : i + SLICE]).sum(axis=0, dtype="<u2")
    return out


def insert(lanes: bytes, paragraph: str) -> bytes:
    return (np.frombuffer(lanes, "<u2") + total(paragraphs(paragraph))).astype("<u2").tobytes()


def delete(lanes: bytes, paragraph: str) -> bytes:
    return (np.frombuffer(lanes, "<u2") - total(paragraphs(paragraph))).astype("<u2").tobytes()


def merge(a: bytes, b: bytes) -> bytes:
    """The fingerprint of two documents' paragraphs together."""
    return (np.frombuffer(a, "<u2") + np.frombuffer(b, "<u2")).astype("<u2").tobytes()


def digest(lanes: bytes) -> str:
    """A short name of a fingerprint, for joins and group-bys."""
    return hashlib.blake2b(lanes, digest_size=16).hexdigest()


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lanes, count = [], []
        for text in batch.column("text"):
            parts = paragraphs(text.as_py())
            count.append(len(parts))
            lanes.append(total(parts).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array([digest(x) for x in lanes], pa.string()), pa.array(lanes, pa.binary())],
            names=["doc_id", "n_paragraphs", "digest", "lanes"],
        )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_paragraphs, digest, lanes), one row for each document, without a shuffle."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_batches, SCHEMA)


def equal_sets(prints: DataFrame) -> DataFrame:
    """(doc_id, same_as): the smallest id whose document holds the same paragraphs; only fingerprints are shuffled."""
    first = prints.groupBy("digest", "n_paragraphs").agg(F.min("doc_id").alias("same_as"))
    return prints.select("doc_id", "digest", "n_paragraphs").join(first, ["digest", "n_paragraphs"]).select("doc_id", "same_as")
