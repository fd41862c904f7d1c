"""Vectorised word segmentation and hashing over Arrow string arrays.

Everything works on the UTF-8 bytes of a whole batch at once with NumPy, so that
no Python code runs for each word. Words are maximal runs of bytes that are
neither ASCII blanks, control characters nor ASCII punctuation; letters are
lower-cased first (Unicode simple lower-casing by Arrow).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = True
_WORD[97:123] = True
_WORD[65:91] = True
_WORD[128:] = True
_WORD[ord("_")] = True

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_POW = np.ones(1, dtype=np.uint64)
_IPOW = np.ones(1, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values (SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of two columns of hashes."""
    return mix64(a * np.uint64(0xD6E8FEB86659FD93) + mix64(b + np.uint64(0x632BE59BD9B4E019)))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _IPOW
    if len(_POW) < n:
        size = max(n, 2 * len(_POW))
        for name, base in (("_POW", _BASE), ("_IPOW", _INV)):
            full = np.full(size, base, dtype=np.uint64)
            full[0] = 1
            globals()[name] = np.multiply.accumulate(full)
    return _POW, _IPOW


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty. Offsets start at 0."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = texts.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


#: Bytes that are hashed at once, for which some fifty times their memory is needed.
SEGMENT = 1_000_000


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in text order, index of each text's first word with the end appended).

    Long inputs are worked through in segments that begin between words, so that a text of any length needs memory for
    its bytes and its words' hashes alone.
    """
    data, off = utf8(pc.utf8_lower(texts.cast(pa.large_string())))
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    hashes, starts, at = [], [], 0
    while at < n:
        end = at + SEGMENT
        while end < n and _WORD[data[end]]:  # on to the next byte that ends a word
            gap = np.flatnonzero(~_WORD[data[end : end + SEGMENT]])
            end = end + int(gap[0]) if len(gap) else end + SEGMENT
        end = min(end, n)
        h, s = _segment(data[at:end], off[np.searchsorted(off, at, side="right") : np.searchsorted(off, end)] - at)
        hashes.append(h)
        starts.append(s + at)
        at = end
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), off)


def _segment(data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the words of a segment that no word crosses; texts begin at ``edge``."""
    n = len(data)
    word = _WORD[data]
    inner = word[1:] & word[:-1]
    inner[edge[(edge > 0) & (edge < n)] - 1] = False  # a word never spans two texts
    starts = np.flatnonzero(word & ~np.concatenate(([False], inner)))
    ends = np.flatnonzero(word & ~np.concatenate((inner, [False]))) + 1
    power, inverse = _powers(n + 1)
    total = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[data] * power[:n], dtype=np.uint64)))
    return mix64((total[ends] - total[starts]) * inverse[starts]), starts


def chunks(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``limit`` bytes each, one row at least."""
    _, off = utf8(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(off, off[start] + limit, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def segment_ids(bounds: np.ndarray) -> np.ndarray:
    """The text index of each word, from the bounds that :func:`words` gives."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
