"""Removal of word sequences that also stand in an earlier document, by seeds that are extended.

A window is ``width`` consecutive words of one document.  A word goes if it lies in a window whose sequence also occurs in a
document with a smaller id; windows are those of the input.

1. Seeds.  Of every ``width - SEED + 1`` consecutive ``SEED``-word grams the one with the smallest hash is an anchor
   (winnowing), so equal windows hold an anchor at the same place.  Anchors are aggregated to their smallest and largest
   document before they move; those of one document only go no further.
2. Extension.  An anchor that two documents share is extended both ways over every word that a window around it can
   hold.  Occurrences with the same surroundings form a class, led by its smallest document; in all other documents of
   the class each window around the anchor is a repeat.
3. The leader of a class is extended window by window: its windows meet those of other leaders, and each that a smaller
   document has is a repeat.  A window goes on for half of its words beyond the anchor to one side at least, so only
   leaders whose near words on that side stand beside the anchor elsewhere take part.  No pairs of occurrences are ever
   formed: a passage in m documents costs m rows.
4. The repeats of a text, runs of windows that overlap or touch, are merged into its maximal ones and cut out.

Sequences are compared by hashes: 64 bits for anchors, 64 more for their surroundings, 128 for windows; texts that share an id
are told apart by 32.  Anchors that many
documents share are one class or few; joins on them are left to the engine's splitting of skewed partitions.

Defined results: a null, empty or wordless text has no words and no windows; a text below ``width`` words loses nothing; a
null id has no order, so its text neither loses words nor makes others lose them; rows that share an id are one document, none
of whose windows counts against another, and each text is cut by itself; repeated rows are repeated results; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.scratch import stash
from graphloom.llm.textkit import SAME, U64, gather_words, mix, slices, word_places

#: Words of an anchor.
SEED = 6

_rng = np.random.default_rng(1213)
_LANES = _rng.integers(1, 2**63, (3, 64), dtype=np.uint64) | U64(1)
_EDGE = _rng.integers(1, 2**63, 64, dtype=np.uint64)


def sequence_hashes(words: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """A hash of the ``width`` words from each place on, as far as they go."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(n, dtype=U64)
    for k in range(width):
        total += mix(words[k : k + n] ^ _EDGE[lane]) * _LANES[lane, k]
    return mix(total)


def anchors(words: np.ndarray, bounds: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Places of the anchors of all rows: in each window the gram of the smallest hash, of equal ones the last."""
    counts = np.diff(bounds)
    grams = sequence_hashes(words, seed)
    span = width - seed + 1
    windows = len(grams) - span + 1
    if windows <= 0:
        return np.zeros(0, np.int64)
    best = np.arange(windows)
    for k in range(1, span):
        best = np.where(grams[k : k + windows] <= grams[best], np.arange(k, k + windows), best)
    row = np.repeat(np.arange(len(counts)), counts)
    return np.unique(best[row[:windows] == row[width - 1 : width - 1 + windows]])


def near(reach: int) -> int:
    """Words beyond an anchor, to one side or the other, that every window around it holds."""
    return -(-reach // 2)


def surroundings(words: np.ndarray, bounds: np.ndarray, places: np.ndarray, reach: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each place's gram with up to ``reach`` words on both sides, and (short ones) of the ``near`` words before and
    after it; the ends of a row count as such."""
    row = np.searchsorted(bounds, places, side="right") - 1
    first, last = bounds[row], bounds[row + 1]
    total, left, right = (np.zeros(len(places), dtype=U64) for _ in range(3))
    for k in range(-reach, seed + reach):
        at = places + k
        inside = (at >= first) & (at < last)
        code = np.where(inside, mix(words[at.clip(0, len(words) - 1)]), _EDGE[k + reach]) * _LANES[1, k + reach]
        total += code
        if -near(reach) <= k < 0:
            left += code
        if seed <= k < seed + near(reach):
            right += code
    return mix(total), mix(left).astype(np.uint32), mix(right).astype(np.uint32)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of batches: rows, bytes, word hashes, their first bytes and lengths, row offsets in words."""
    for batch in batches:
        for first, last, raw, bounds in slices(batch.column(column)):
            hashes, starts, sizes = word_places(raw, bounds, case=SAME)
            yield batch.slice(first, last - first), raw, hashes, starts, sizes, np.searchsorted(starts, bounds).astype(np.int64)
        pa.default_memory_pool().release_unused()


def find_seeds(texts: DataFrame, width: int, seed: int) -> DataFrame:
    """The anchors (hash) that stand in more than one document."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, words, _, _, at in _texts(batches, 2):
            places = anchors(words, at, width, seed)
            hashes = sequence_hashes(words, seed)[places] if len(places) else np.zeros(0, U64)
            ids = rows.column(0).to_numpy()[np.searchsorted(at, places, side="right") - 1]
            order = np.lexsort((ids, hashes))
            hashes, ids = hashes[order], ids[order]
            fresh = np.ones(len(ids), dtype=bool)
            fresh[1:] = (hashes[1:] != hashes[:-1]) | (ids[1:] != ids[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(hashes[fresh].view(np.int64)), pa.array(ids[fresh])], names=["anchor", "id"])

    posted = texts.mapInArrow(post, "anchor bigint, id bigint")
    return posted.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("anchor")


def find_occurrences(texts: DataFrame, width: int, seed: int) -> DataFrame:
    """anchor, around (hash of its surroundings), left, right, id, print, place: every anchor of every text."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, words, _, _, at in _texts(batches, 2):
            places = anchors(words, at, width, seed)
            hashes = sequence_hashes(words, seed)[places] if len(places) else np.zeros(0, U64)
            row = np.searchsorted(at, places, side="right") - 1
            around, left, right = surroundings(words, at, places, width - seed, seed) if len(places) else (hashes, hashes.astype(np.uint32), hashes.astype(np.uint32))
            columns = [pa.array(hashes.view(np.int64)), pa.array(around.view(np.int64)), pa.array(left.view(np.int32)), pa.array(right.view(np.int32)), pa.array(rows.column(0).to_numpy()[row]), pa.array(rows.column(1).to_numpy()[row]), pa.array(places - at[row], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "around", "left", "right", "id", "print", "place"])

    return texts.mapInArrow(post, "anchor bigint, around bigint, left int, right int, id bigint, print int, place int")


def find_frames(chosen: DataFrame, width: int, seed: int) -> DataFrame:
    """anchor, around, id, frame (words of the window before the anchor), two hashes: the windows around chosen places.

    ``chosen`` holds texts with the list ``leads`` of (anchor, around, place, and whether windows that go on to the left,
    and those to the right, are wanted).
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, words, _, _, at in _texts(batches, 1):
            leads = rows.column(2)
            row = np.repeat(np.arange(len(rows)), np.diff(leads.offsets.to_numpy()))
            anchor, around, place, left, right = leads.flatten().flatten()
            sides = np.stack([right.to_numpy(zero_copy_only=False), left.to_numpy(zero_copy_only=False)])
            place = place.to_numpy() + at[row]
            one, two = (sequence_hashes(words, width, lane) for lane in (0, 2))
            frame = np.tile(np.arange(width - seed + 1), len(place))
            start = np.repeat(place, width - seed + 1) - frame
            owner = np.repeat(np.arange(len(place)), width - seed + 1)
            whole = (start >= at[row[owner]]) & (start + width <= at[row[owner] + 1]) & sides[(frame >= near(width - seed)).astype(int), owner]
            start, owner, frame = start[whole], pa.array(owner[whole]), frame[whole]
            ids = rows.column(0).take(pa.array(row)).take(owner)
            columns = [anchor.take(owner), around.take(owner), ids, pa.array(frame, pa.int32()), pa.array(one[start].view(np.int64)), pa.array(two[start].view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "around", "id", "frame", "w1", "w2"])

    return chosen.mapInArrow(post, "anchor bigint, around bigint, id bigint, frame int, w1 bigint, w2 bigint")


def find_repeats(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 13, seed: int = SEED) -> DataFrame:
    """id, print (hash of the text), repeats: for each text that loses words a list of (place of an anchor, frames as bits)."""
    texts = documents.select(F.col(doc_id).cast("long").alias("id"), F.hash(F.col(text)).alias("print"), F.col(text).alias("text")).where("id is not null and text is not null")
    seeds = stash(find_seeds(texts, width, seed), "seeds")
    met = stash(find_occurrences(texts, width, seed).join(seeds, "anchor"), "met")
    lead = F.min(F.struct("id", "print", "place", "left", "right")).alias("lead")
    classes = stash(met.groupBy("anchor", "around").agg(lead).select("anchor", "around", "lead.*"), "classes")
    shared = lambda side: classes.groupBy("anchor", side).agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("anchor", side, F.lit(True).alias(f"on_{side}"))
    wanted = classes.join(shared("left"), ["anchor", "left"], "left").join(shared("right"), ["anchor", "right"], "left").na.fill(False, ["on_left", "on_right"]).where("on_left or on_right")
    leads = wanted.groupBy("id", "print").agg(F.collect_list(F.struct("anchor", "around", "place", "on_left", "on_right")).alias("leads"))
    chosen = texts.join(leads, ["id", "print"]).dropDuplicates(["id", "print"]).select("id", "text", "leads")
    frames = stash(find_frames(chosen, width, seed), "frames")
    first = frames.groupBy("w1", "w2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    late = frames.join(first, ["w1", "w2"]).where("id > first")
    bits = late.groupBy("anchor", "around").agg(F.sum(F.expr("shiftleft(1L, frame)")).alias("bits"))
    judged = stash(classes.select("anchor", "around", F.col("id").alias("lead")).join(bits, ["anchor", "around"], "left"), "judged")
    every = F.lit((1 << (width - seed + 1)) - 1)
    repeats = met.join(judged, ["anchor", "around"]).select("id", "print", "place", F.when(F.col("id") > F.col("lead"), every).otherwise(F.coalesce("bits", F.lit(0))).cast("long").alias("bits"))
    return repeats.where("bits > 0").distinct().groupBy("id", "print").agg(F.collect_list(F.struct("place", "bits")).alias("repeats"))


OUT = "doc_id bigint, n_words bigint, n_removed bigint, kept string"


def _cut(width: int, seed: int, digest: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, words, starts, sizes, at in _texts(batches, 1):
            repeats = rows.column(2)
            row = np.repeat(np.arange(len(rows)), np.diff(repeats.offsets.to_numpy()))
            place, bits = (x.to_numpy() for x in repeats.flatten().flatten())
            change = np.zeros(len(words) + 1, dtype=np.int64)
            for frame in range(width - seed + 1):
                start = (at[row] + place - frame)[(bits >> frame) & 1 == 1]
                own = row[(bits >> frame) & 1 == 1]
                start = start[(start >= at[own]) & (start + width <= at[own + 1])]
                np.add.at(change, start, 1)
                np.add.at(change, start + width, -1)
            kept = np.cumsum(change[:-1]) == 0
            owner = np.repeat(np.arange(len(rows)), np.diff(at))[kept]
            left = np.bincount(owner, minlength=len(rows))
            buffer, offsets = gather_words(raw, starts[kept], sizes[kept], owner, len(rows))
            texts = pa.Array.from_buffers(pa.large_string(), len(rows), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(buffer)])
            if digest:
                texts = pa.array([hashlib.sha256(buffer[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(at), pa.int64()), pa.array(np.diff(at) - left, pa.int64()), texts.cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return cut


def cut_repeats(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 13, seed: int = SEED, digest: bool = False) -> DataFrame:
    """Per document row: doc_id, n_words, n_removed, kept (the words left, joined by one space; with ``digest`` their SHA-256)."""
    if not 1 < seed < width <= 32:
        raise ValueError("a window takes up to 32 words and is longer than a seed, which takes at least two")
    repeats = stash(find_repeats(documents, doc_id=doc_id, text=text, width=width, seed=seed), "repeats")
    rows = documents.select(F.col(doc_id).cast("long").alias("id"), F.hash(F.col(text)).alias("print"), F.col(text).alias("text"))
    none = F.expr("cast(array() as array<struct<place: int, bits: bigint>>)")
    joined = rows.join(repeats, ["id", "print"], "left").select("id", "text", F.coalesce("repeats", none).alias("repeats"))
    return joined.mapInArrow(_cut(width, seed, digest), OUT)
