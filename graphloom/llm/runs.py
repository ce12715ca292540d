"""Periodic runs of words: stretches that repeat a block of ``q`` words at least four times.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are equal) and a length of at least
``max(6, 4 q)`` that no neighbouring word extends.  They are found text by text, in tasks that see whole texts and share
nothing, so no row ever moves:

1. Scales.  At scale ``B`` = 1, 2, 4, ... the text is cut into blocks of ``B`` words that start every ``2 B`` words.  A run
   of period ``B <= q < 2 B`` is at least ``4 q`` long, so it holds a block together with its copy ``q`` words on.
2. Blocks.  A block is located in the window of the ``2 B - 1`` words behind it by the sum of squared differences at every
   shift, one convolution, computed as integers by a number-theoretic transform modulo ``PRIME``; many blocks are rows of one
   array.  A sum of zero is a shift without a mismatch.  Two exact rules leave out blocks that cannot find a new run: those
   whose first words do not come again at such a distance, and those inside a run of a smaller period, where a second
   period would make both multiples of a common one.
3. Seeds.  Every shift found is extended both ways, by bisection over prefix sums of word codes, to the longest
   stretch that keeps the period; what is long enough is compared word by word, so a chance equality never passes.
   The same stretch with a smaller period was found at a smaller scale and wins.

Work is O(n log^2 n) a text of n words.  Memory is that of a slice of texts, or of the longest text.

Defined results: a null, empty or wordless text has no run; a text of fewer than six words has none; a null id plants
nothing; rows that share an id are judged one by one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.textkit import SAME, U64, gather_words, mix, slices, word_places

#: 15 * 2**27 + 1, with the generator 31: transforms of up to 2**27 words.
PRIME, GENERATOR = 2013265921, 31
_P = U64(PRIME)
#: Elements of one array of blocks.
ROOM = 1 << 20
#: Words of a block's opening that must come again.
OPENING = 8
LEAST, TIMES = 6, 4
_BASE = U64(0xD1342543DE82EF95)


@cache
def _roots(half: int, *, inverse: bool = False) -> np.ndarray:
    """Powers 0 .. half-1 of a root of unity of order 2 * half."""
    root = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
    root = pow(root, -1, PRIME) if inverse else root
    powers = np.ones(half, dtype=U64)
    done = 1
    while done < half:
        step = U64(pow(root, done, PRIME))
        powers[done : 2 * done] = powers[:done] * step % _P
        done *= 2
    return powers


def transform(rows: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each row (a power of two long), its values in bit-reversed order."""
    rows, half = rows.copy(), rows.shape[1] // 2
    while half:
        pairs = rows.reshape(len(rows), -1, 2, half)
        left, right = pairs[:, :, 0].copy(), pairs[:, :, 1].copy()
        pairs[:, :, 0] = (left + right) % _P
        pairs[:, :, 1] = (left + (_P - right)) * _roots(half) % _P
        half //= 2
    return rows


def restore(rows: np.ndarray) -> np.ndarray:
    """The rows whose transform, in bit-reversed order, is given."""
    rows, half = rows.copy(), 1
    while half < rows.shape[1]:
        pairs = rows.reshape(len(rows), -1, 2, half)
        left, right = pairs[:, :, 0].copy(), pairs[:, :, 1] * _roots(half, inverse=True) % _P
        pairs[:, :, 0] = (left + right) % _P
        pairs[:, :, 1] = (left + (_P - right)) % _P
        half *= 2
    return rows * U64(pow(rows.shape[1], -1, PRIME)) % _P


def mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sum of squared differences, modulo ``PRIME``, of each block (B words) and its window (2 B - 1 words) at shifts 0 .. B-1."""
    n, size = blocks.shape
    turned = np.zeros((n, 2 * size), dtype=U64)
    turned[:, 0] = blocks[:, 0]
    turned[:, size + 1 :] = blocks[:, :0:-1]
    padded = np.zeros((n, 2 * size), dtype=U64)
    padded[:, :-1] = windows
    products = restore(transform(turned) * transform(padded) % _P)[:, :size]
    squares = np.zeros((n, 2 * size), dtype=U64)
    np.cumsum(windows * windows % _P, axis=1, out=squares[:, 1:])
    own = (blocks * blocks % _P).sum(axis=1, keepdims=True)
    both = own + squares[:, size:] - squares[:, :size]
    return (both + U64(2) * (_P - products)) % _P


class _Known:
    """Stretches found so far, asked whether one of them holds a given stretch."""

    def __init__(self) -> None:
        self.start = self.end = self.period = np.zeros(0, np.int64)
        self._reach = self.end

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        joined = [np.concatenate(x) for x in ((self.start, start), (self.end, end), (self.period, period))]
        order = np.argsort(joined[0], kind="stable")
        self.start, self.end, self.period = (x[order] for x in joined)
        self._reach = np.maximum.accumulate(self.end)

    def hold(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.start, start, side="right") - 1
        return (at >= 0) & (np.append(self._reach, 0)[at] >= end)


def _comes_again(codes: np.ndarray, blocks: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether the code at each block's start stands at a place from ``low`` to before ``high``."""
    n = np.int64(len(codes))
    _, rank = np.unique(codes, return_inverse=True)
    keys = np.sort(rank * n + np.arange(n))
    mine = rank[blocks] * n
    at = np.searchsorted(keys, mine + low)
    return (at < n) & (np.append(keys, 0)[at] < mine + high)


class _Prefixes:
    """Sums of word codes times powers, by which equal stretches have equal differences."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        self.power = np.ones(n + 1, dtype=U64)
        np.cumprod(np.full(n, _BASE, dtype=U64), out=self.power[1:])
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(mix(words) * self.power[:-1], out=self.sums[1:])

    def equal(self, a: np.ndarray, length: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Whether the stretches of ``length`` words at ``a`` and ``distance`` further on look equal."""
        b = a + distance
        return (self.sums[a + length] - self.sums[a]) * self.power[distance] == self.sums[b + length] - self.sums[b]


def _bisect(most: np.ndarray, holds) -> np.ndarray:
    """The largest length up to ``most`` for which ``holds`` is true; it is true for 0 and below every true length."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        good = holds(middle)
        low = np.where(good, middle, low)
        high = np.where(good, high, middle - 1)
    return low


def _exact(words: np.ndarray, first: int, last: int, at: int, distance: int) -> tuple[int, int]:
    """The stretch around the equal words ``at`` and ``at + distance`` that keeps the period, word by word."""
    start = at
    while start > first and words[start - 1] == words[start - 1 + distance]:
        start -= 1
    end = at + distance
    while end < last and words[end] == words[end - distance]:
        end += 1
    return start, end


def find_runs(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, start (within the text), length and period of every run, by text, start and period.

    ``words`` holds a number for each word of all texts, equal for equal words; ``bounds`` where each text begins and ends.
    """
    n, lengths = len(words), np.diff(bounds)
    known = _Known()
    longest = int(lengths.max()) if len(lengths) else 0
    if longest >= LEAST:
        values = np.unique(words, return_inverse=True)[1].astype(U64) + U64(1)
        prefixes, codes, width = _Prefixes(words), words, 1
    size = 1
    while longest >= max(LEAST, TIMES * size):
        while width < min(size, OPENING):
            longer = codes.copy()
            longer[: n - width] = mix(codes[: n - width] * U64(3) + codes[width:])
            codes, width = longer, 2 * width
        texts = np.flatnonzero(lengths >= max(LEAST, TIMES * size))
        counts = lengths[texts] // (2 * size)
        inside = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        blocks, of = np.repeat(bounds[texts], counts) + 2 * size * inside, np.repeat(texts, counts)
        last = bounds[of + 1]
        open_ = ~known.hold(blocks, np.minimum(blocks + 3 * size, last))
        blocks, of, last = blocks[open_], of[open_], last[open_]
        again = _comes_again(codes, blocks, blocks + size, np.minimum(blocks + 2 * size, last - size + 1))
        blocks, of = blocks[again], of[again]
        found = []
        step = max(1, ROOM // (2 * size))
        for k in range(0, len(blocks), step):
            found.append(_seeds(words, values, bounds, blocks[k : k + step], of[k : k + step], size, known, prefixes))
        if found:
            start, end, period = np.unique(np.concatenate(found, axis=1), axis=1)
            fresh = ~np.isin(start * (n + 1) + end, known.start * (n + 1) + known.end)
            known.add(start[fresh], end[fresh], period[fresh])
        size *= 2
    order = np.lexsort((known.period, known.start))
    start, end, period = known.start[order], known.end[order], known.period[order]
    text = np.searchsorted(bounds, start, side="right") - 1
    return text, start - bounds[text], end - start, period


def _seeds(words: np.ndarray, values: np.ndarray, bounds: np.ndarray, blocks: np.ndarray, of: np.ndarray, size: int, known: _Known, prefixes: _Prefixes) -> np.ndarray:
    """start, end and period (rows of an array) of the runs that the given blocks find."""
    n = len(words)
    block = values[blocks[:, None] + np.arange(size)]
    window = values[np.minimum(blocks[:, None] + size + np.arange(2 * size - 1), n - 1)]
    row, shift = np.nonzero(mismatches(block, window) == 0)
    at, distance, text = blocks[row], shift + size, of[row]
    use = (at + distance + size <= bounds[text + 1]) & ~known.hold(at, at + distance + size)
    at, distance, text = at[use], distance[use], text[use]
    first, last = bounds[text], bounds[text + 1]
    ahead = _bisect(last - at - distance, lambda k: prefixes.equal(at, k, distance))
    behind = _bisect(at - first, lambda k: prefixes.equal(at - k, k, distance))
    start, end = at - behind, at + distance + ahead
    long = end - start >= np.maximum(LEAST, TIMES * distance)
    runs = np.unique(np.stack([start[long], end[long], distance[long], first[long], last[long]]), axis=1)
    out = []
    for start, end, distance, first, last in runs.T.tolist():
        if not np.array_equal(words[start : end - distance], words[start + distance : end]):
            for at in range(start, end - distance, max(1, distance)):  # sums that agree by chance
                if words[at] == words[at + distance]:
                    a, b = _exact(words, first, last, at, distance)
                    if b - a >= max(LEAST, TIMES * distance):
                        out.append((a, b, distance))
        else:
            out.append((start, end, distance))
    return np.array(sorted(set(out)), dtype=np.int64).reshape(-1, 3).T


def planted(bounds: np.ndarray, crc: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """The place of the word that stands at each place, once periods are planted by the checksum of each text's id."""
    n = np.diff(bounds)
    places = np.arange(int(bounds[-1]))
    for k in np.flatnonzero(valid & (crc % 10 == 0) & (n > 0)).tolist():
        g, length = int(crc[k]) // 10, int(n[k])
        a = g % length
        p = 1 + (length - a) // (3 + g % 8)
        places[bounds[k] + a : bounds[k + 1]] = bounds[k] + a + np.arange(length - a) % p
    return places


OUT = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def judge_runs(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """Per document row: the number of runs, the longest one (ties: smallest start, then period), digests of all runs
    (``start,length,period`` and a line feed each) and of the text whose runs keep their first period only.

    With ``plant``, one id in ten, by its checksum, first has its end overwritten with a period.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, raw, bounds in slices(batch.column(1)):
                hashes, starts, sizes = word_places(raw, bounds, case=SAME)
                at = np.searchsorted(starts, bounds).astype(np.int64)
                if plant:
                    crc = batch.column(2).slice(first, last - first)
                    places = planted(at, crc.fill_null(0).to_numpy(), crc.is_valid().to_numpy(zero_copy_only=False))
                    hashes, starts, sizes = hashes[places], starts[places], sizes[places]
                yield _report(batch.column(0).slice(first, last - first), raw, hashes, starts, sizes, at)
            pa.default_memory_pool().release_unused()

    key = F.col(doc_id).cast("long")
    return documents.select(key.alias("doc_id"), F.col(text).alias("text"), F.crc32(key.cast("string").cast("binary")).alias("crc")).mapInArrow(judge, OUT)


def _report(ids: pa.Array, raw: np.ndarray, hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    n = len(ids)
    text, start, length, period = find_runs(hashes, at)
    cuts = np.searchsorted(text, np.arange(n + 1))
    best = np.lexsort((period, start, -length, text))
    best = best[np.searchsorted(text[best], np.arange(n)).clip(max=max(len(text) - 1, 0))] if len(text) else np.zeros(n, np.int64)
    none = cuts[1:] == cuts[:-1]
    change = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(change, at[text] + start + period, 1)
    np.add.at(change, at[text] + start + length, -1)
    kept = np.cumsum(change[:-1]) == 0
    row = np.repeat(np.arange(n), np.diff(at))[kept]
    buffer, offsets = gather_words(raw, starts[kept], sizes[kept], row, n)
    lines = [f"{s},{m},{q}\n" for s, m, q in zip(start.tolist(), length.tolist(), period.tolist(), strict=True)]
    digest = lambda data: hashlib.sha256(data).hexdigest()
    chosen = [pa.array(x[best] if len(text) else np.zeros(n, np.int64), mask=none, type=pa.int64()) for x in (start, length, period, 1000 * length // np.maximum(period, 1))]
    runs = [digest("".join(lines[a:b]).encode()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    texts = [digest(buffer[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(cuts), pa.int64()), *chosen, pa.array(runs, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])
