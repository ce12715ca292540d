"""Columnar text helpers: Arrow string columns as byte buffers, words as 64-bit hashes.

A word is a run of bytes outside a separator class; bytes above 0x7F always belong
to words, so UTF-8 sequences stay whole.  Every function works on whole columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at once; bounds the working arrays of one task.
SLICE_BYTES = 600_000

_rng = np.random.default_rng(20240607)
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = U64(0x9E3779B97F4A7C15)
_LANE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | U64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters as they are.
SAME = np.arange(256, dtype=np.uint8)
#: True for bytes of words when words are separated by white space only.
SPACE_WORD = np.ones(256, dtype=bool)
SPACE_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the offsets of its rows."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]] if len(bounds) else raw[:0], bounds - bounds[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``limit`` bytes: (first, last, bytes, offsets)."""
    raw, bounds = text_bytes(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, raw[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def word_places(raw: np.ndarray, bounds: np.ndarray, word_byte: np.ndarray = SPACE_WORD, case: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all rows (A-Z lower-cased unless ``case`` is ``SAME``), in order, their first bytes and their lengths in bytes."""
    inside = word_byte[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[bounds] = True
    before = np.zeros(len(raw), dtype=bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    if not len(starts):
        return np.zeros(0, U64), starts, np.zeros(0, np.int64)
    codes = _BYTE_CODE[case[raw[inside]]]
    first = (np.cumsum(inside) - 1)[starts]
    lengths = np.diff(np.append(first, len(codes)))
    powers = np.cumprod(np.full(int(lengths.max()), _BASE, dtype=U64))
    within = np.arange(len(codes)) - np.repeat(first, lengths)
    return mix(np.add.reduceat(codes * powers[within], first) + lengths.astype(U64)), starts, lengths


def word_hashes(raw: np.ndarray, bounds: np.ndarray, word_byte: np.ndarray = SPACE_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of each row, in order, and the offsets of rows in them."""
    hashes, starts, _ = word_places(raw, bounds, word_byte)
    return hashes, np.searchsorted(starts, bounds).astype(np.int64)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of each row and the row of each; a shorter row is one run."""
    counts = np.diff(bounds)
    n = len(words)
    parts, rows = [], []
    if n >= width:
        row_of = np.repeat(np.arange(len(counts)), counts)
        total = np.zeros(n - width + 1, dtype=U64)
        for k in range(width):
            total += words[k : n - width + 1 + k] * _LANE[k]
        whole = row_of[: n - width + 1] == row_of[width - 1 :]
        parts.append(mix(total[whole]))
        rows.append(row_of[: n - width + 1][whole])
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        total = np.zeros(len(short), dtype=U64)
        for k in range(width - 1):
            has = counts[short] > k
            total[has] += words[bounds[short[has]] + k] * _LANE[k]
        parts.append(mix(total + counts[short].astype(U64) * _LANE[63]))
        rows.append(short)
    if not parts:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(parts), np.concatenate(rows).astype(np.int64)


def gather_words(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The given words of each row joined by one space: one buffer and the offsets of the rows in it.

    ``row`` holds the row of each word, in rising order.
    """
    n = len(starts)
    last = np.ones(n, dtype=bool)
    last[:-1] = row[1:] != row[:-1]
    ends = np.cumsum(lengths + ~last)
    buffer = np.full(int(ends[-1]) if n else 0, 0x20, dtype=np.uint8)
    places = ends - lengths - ~last
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    buffer[np.repeat(places, lengths) + within] = raw[np.repeat(starts, lengths) + within]
    return buffer, np.concatenate([[0], ends])[np.searchsorted(row, np.arange(rows + 1))]
