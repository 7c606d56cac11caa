"""Columnar word access to texts.

A *word* is a maximal run of ``a``-``z`` and ``0``-``9`` in the lower-cased text.
Texts arrive as Arrow string columns (already lower-cased by the JVM), and all word
boundaries and word hashes of a batch are found with a handful of numpy passes over
the bytes: no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multiplier of the polynomial hash modulo 2**64, and its inverse.
_B = 0x9E3779B97F4A7C15
_B_INV = pow(_B, -1, 1 << 64)
_IS_WORD = np.zeros(256, np.bool_)
_IS_WORD[ord("a") : ord("z") + 1] = True
_IS_WORD[ord("0") : ord("9") + 1] = True
#: Texts are handled in chunks of about this many bytes, to keep work arrays small.
CHUNK_BYTES = 1 << 20

_powers: dict[str, np.ndarray] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i < n (kept for the next chunk)."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        for name, base in (("up", _B), ("down", _B_INV)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (splitmix64's finaliser)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offsets = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, word offsets per text, start byte, end byte of each word)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64), none, none
    is_word = _IS_WORD[data]
    edge = np.zeros(n + 1, np.bool_)
    edge[offsets] = True
    before = np.empty(n, np.bool_)
    before[0] = False
    before[1:] = is_word[:-1]
    start = np.flatnonzero(is_word & (~before | edge[:-1]))
    after = np.empty(n, np.bool_)
    after[-1] = False
    after[:-1] = is_word[1:]
    end = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    up, down = _pow(n)
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum(data.astype(U64) * up, out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))
    return hashes, np.searchsorted(start, offsets), start, end


def chunks(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, texts, bytes, offsets) of consecutive runs of texts of about CHUNK_BYTES."""
    data, offsets = string_buffers(col)
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(offsets) - 1)
        yield first, last - first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, word offsets per text) of a whole column."""
    hashes, counts = [], [np.zeros(1, np.int64)]
    done = 0
    for _, _, data, offsets in chunks(col):
        h, o, _, _ = words_of_bytes(data, offsets)
        hashes.append(h)
        counts.append(o[1:] + done)
        done += len(h)
    return (np.concatenate(hashes) if hashes else np.zeros(0, U64)), np.concatenate(counts)


def distinct_sorted(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct word hashes of every text in rising order: (hashes, offsets, place of each word's first occurrence)."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    keep = np.ones(len(h), np.bool_)
    keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[keep], o[keep]
    return h, np.searchsorted(o, np.arange(len(offsets))), order[keep]


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum (wrapping) of every segment; empty segments give 0."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def ahead(values: np.ndarray, j: int, fill: int = 0) -> np.ndarray:
    """The value j places further on, ``fill`` beyond the end."""
    out = np.full(len(values), fill, values.dtype)
    if j < len(values):
        out[: len(values) - j] = values[j:]
    return out
