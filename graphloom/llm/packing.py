"""Bounded-space online packing of token sequences.

Each task keeps ``open_windows`` windows.  A document's ids (with the closing id) are cut into whole
windows and a rest; the rest goes to the fullest open window with room (best fit).  Where none has
room the fullest is emitted, after its gap, if it is wider than ``max_gap``, was topped up with
the head of the incoming rest, and a new window opens.  What is open at a task's end is merged
in groups of tasks: pieces are placed best-fit in order of falling length, and the emptiest
windows are poured into the gaps of the others.  All state is bounded by the number of open windows.

Defined results: null or empty text is one piece of one closing id; a null id is kept as it is; repeated rows are packed
again; among windows with equal room the one opened first is taken, so the packing follows the order of the rows; an empty
table gives no sequences; columns other than the two named are ignored.  Every id lies in exactly one piece, and offsets
are gapless from 0.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.scratch import stash
from graphloom.llm.tokens import encoder

PIECES = "array<struct<doc_id: bigint, start: bigint, length: bigint, doc_tokens: bigint>>"
WINDOWS = f"sequence_id bigint, task int, open boolean, tokens binary, pieces {PIECES}"
PIECE_TYPE = pa.list_(pa.struct([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens")]))
ARROW = pa.schema([("sequence_id", pa.int64()), ("task", pa.int32()), ("open", pa.bool_()), ("tokens", pa.binary()), ("pieces", PIECE_TYPE)])
#: Tasks whose open windows are merged together.
MERGED_TASKS = 16
EMIT_BYTES = 4 << 20

Piece = tuple[tuple, bytes]  # (doc_id, start, length, doc_tokens), ids


class Window:
    __slots__ = ("pieces", "used")

    def __init__(self) -> None:
        self.pieces: list[Piece] = []
        self.used = 0

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.used += piece[0][2]


def cut(piece: Piece, n: int) -> tuple[Piece, Piece]:
    (doc, start, length, total), ids = piece
    return ((doc, start, n, total), ids[: 4 * n]), ((doc, start + n, length - n, total), ids[4 * n :])


class OpenWindows:
    """The online packer of one task."""

    def __init__(self, size: int, limit: int, max_gap: int) -> None:
        self.size, self.limit, self.max_gap, self.windows = size, limit, max_gap, []

    def place(self, piece: Piece) -> Iterator[Window]:
        """Place one piece; yields the windows that this fills or pushes out."""
        while piece[0][2] >= self.size:
            head, piece = cut(piece, self.size)
            full = Window()
            full.add(head)
            yield full
        while piece[0][2]:
            room = [w for w in self.windows if self.size - w.used >= piece[0][2]]
            if room:
                best = max(room, key=lambda w: w.used)
                best.add(piece)
                if best.used == self.size:
                    self.windows.remove(best)
                    yield best
                return
            if len(self.windows) == self.limit:
                fullest = max(self.windows, key=lambda w: w.used)
                if self.size - fullest.used > self.max_gap:
                    head, piece = cut(piece, self.size - fullest.used)
                    fullest.add(head)
                self.windows.remove(fullest)
                yield fullest
                continue
            fresh = Window()
            fresh.add(piece)
            self.windows.append(fresh)
            return


def merge(pieces: list[Piece], size: int, max_gap: int) -> list[Window]:
    """Best fit in order of falling length, then the emptiest windows fill the gaps of the rest."""
    windows: list[Window] = []
    free: list[tuple[int, int]] = []  # (room, window)
    for piece in sorted(pieces, key=lambda p: (-p[0][2], p[0][0] or 0, p[0][1])):
        at = bisect_left(free, (piece[0][2], -1))
        room, w = free.pop(at) if at < len(free) else (size, len(windows))
        if w == len(windows):
            windows.append(Window())
        windows[w].add(piece)
        if room > piece[0][2]:
            insort(free, (room - piece[0][2], w))
    gapped = sorted((w for w in windows if size - w.used > max_gap), key=lambda w: -w.used)
    done = [w for w in windows if size - w.used <= max_gap]
    while len(gapped) > 1 and sum(size - w.used for w in gapped[:-1]) >= gapped[-1].used:
        source = gapped.pop()
        for piece in source.pieces:
            while piece[0][2]:
                target = gapped[0]
                head, piece = cut(piece, min(piece[0][2], size - target.used))
                target.add(head)
                if target.used == size:
                    done.append(gapped.pop(0))
    return done + gapped


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, held_bytes = [], 0
    for sequence_id, task, is_open, window in rows:
        held.append((sequence_id, task, is_open, b"".join(ids for _, ids in window.pieces), [dict(zip(("doc_id", "start", "length", "doc_tokens"), p, strict=True)) for p, _ in window.pieces]))
        held_bytes += 4 * window.used
        if held_bytes > EMIT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), ARROW.types, strict=True)], schema=ARROW)
            held, held_bytes = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), ARROW.types, strict=True)], schema=ARROW)


def pack_documents(
    documents: DataFrame,
    tokenizer_path: str,
    *,
    end_id: int,
    size: int = 4096,
    open_windows: int = 64,
    max_gap: int = 40,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Sequences: sequence_id, tokens (little-endian unsigned 32-bit ids), pieces in order, and padded_length.

    A sequence is padded to ``size`` unless its length is a power of two.
    """
    closing = np.asarray([end_id], dtype="<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encode, packer = encoder(tokenizer_path).encode, OpenWindows(size, open_windows, max_gap)

        def windows() -> Iterator[tuple]:
            made = 0
            for batch in batches:
                for at in range(0, batch.num_rows, 128):
                    part = batch.slice(at, 128)
                    texts = [t or "" for t in part.column(1).to_pylist()]
                    for doc, ids in zip(part.column(0).to_pylist(), encode(texts), strict=True):
                        total = len(ids) // 4 + 1
                        for window in packer.place(((doc, 0, total, total), ids + closing)):
                            yield (task << 36) + made, task, False, window
                            made += 1
            for window in packer.windows:
                yield (task << 36) + made, task, True, window
                made += 1

        yield from _batches(windows())

    def merge_group(table: pa.Table) -> pa.Table:
        pieces: list[Piece] = []
        for ids, own in zip(table["tokens"].to_pylist(), table["pieces"].to_pylist(), strict=True):
            at = 0
            for p in own:
                pieces.append(((p["doc_id"], p["start"], p["length"], p["doc_tokens"]), ids[at : at + 4 * p["length"]]))
                at += 4 * p["length"]
        first = min(table["sequence_id"].to_pylist())  # an open window's own id; a group makes no more windows than it had
        names = sorted(table["sequence_id"].to_pylist())
        merged = merge(pieces, size, max_gap)
        rows = ((names[i] if i < len(names) else first + (1 << 35) + i, 0, False, w) for i, w in enumerate(merged))
        return pa.Table.from_batches(list(_batches(rows)), schema=ARROW)

    packed = stash(documents.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(pack, WINDOWS), "packed")
    left = packed.where("open").withColumn("task", F.expr(f"task div {MERGED_TASKS}").cast("int"))
    merged = left.groupBy("task").applyInArrow(merge_group, WINDOWS)
    length = F.expr("octet_length(tokens) div 4")
    sequences = packed.where("not open").unionByName(merged).select("sequence_id", "tokens", "pieces", length.alias("length"))
    power_of_two = F.bit_count("length") == 1
    return sequences.withColumn("padded_length", F.when(power_of_two, F.col("length")).otherwise(F.lit(size)).cast("long"))


def piece_digests(sequences: DataFrame) -> DataFrame:
    """One row per piece: its place in document and sequence, and the checksum of its ids."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
        for batch in batches:
            rows = []
            for sequence_id, ids, pieces in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                view, at = memoryview(ids), 0
                for p in pieces:
                    rows.append((p["doc_id"], p["start"], p["length"], zlib.crc32(view[4 * at : 4 * (at + p["length"])]), p["doc_tokens"], sequence_id, at))
                    at += p["length"]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    out = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return sequences.select("sequence_id", "tokens", "pieces").mapInArrow(digest, out)
