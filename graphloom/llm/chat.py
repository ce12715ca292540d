r"""Chat formatting by columnar byte assembly.

A turn becomes ``<|role|>\n`` + text + ``<|end|>\n``.  Inside roles and texts ``\``, ``<`` and ``|`` are
written as ``\\``, ``\l`` and ``\p``, so no control string can occur there and the writing can be undone.
All segments of a batch are copied into one preallocated buffer: their lengths give cumulative offsets, the
offsets give scatter indices, and the buffer becomes an Arrow string column without another copy.
The loss mask lists the byte spans of the assistant's (escaped) texts.

Rows are ordered by turn, then role, then text.  A conversation is one row, unless it has more than ``PART_BYTES`` of text: then
it is several rows, numbered by ``part`` in order, each of whole turns and with a mask of its own.  Tasks hold one
batch and the open part of the conversation at its end, so memory is bounded and time grows with the text.

Defined results: null role or text counts as empty; a null conv_id is a conversation of its own; repeated rows are
repeated turns; ties of turn, role and text are equal rows; an empty table gives no conversation; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.textkit import text_bytes

OPEN, SHUT, END = "<|", "|>\n", "<|end|>\n"
_ESCAPES = {"\\": "\\", "<": "l", "|": "p"}
_CODE = np.zeros(256, dtype=np.uint8)
for _char, _letter in _ESCAPES.items():
    _CODE[ord(_char)] = ord(_letter)
_BACK = {letter: char for char, letter in _ESCAPES.items()}
SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64())])
#: Bytes of roles and texts from which a conversation goes on in another row; far below what a string can hold.
PART_BYTES = 32 << 20
OUT = "conv_id bigint, part int, n_turns bigint, formatted string, loss array<struct<start: bigint, length: bigint>>"


def escape(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    special = _CODE[raw] > 0
    places = np.arange(len(raw)) + np.cumsum(special) - special
    out = np.empty(len(raw) + int(special.sum()), dtype=np.uint8)
    out[places] = np.where(special, np.uint8(92), raw)
    out[places[special] + 1] = _CODE[raw[special]]
    return out, bounds + np.concatenate([[0], np.cumsum(special)])[bounds]


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text, flags=re.DOTALL)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all turns, where each turn starts (and the end), and (start, length) of each turn's text."""
    role, role_at = escape(*text_bytes(roles))
    text, text_at = escape(*text_bytes(texts))
    n = len(roles)
    parts = [np.frombuffer(s.encode(), np.uint8) for s in (OPEN, SHUT, END)]
    lengths = np.empty((n, 5), dtype=np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = (len(p) for p in parts)
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(lengths.ravel())
    starts = np.concatenate([[0], ends])[:-1].reshape(n, 5)
    buffer = np.empty(int(ends[-1]) if n else 0, dtype=np.uint8)
    for column, part in zip((0, 2, 4), parts, strict=True):
        buffer[starts[:, column, None] + np.arange(len(part))] = part
    for column, data, at in ((1, role, role_at), (3, text, text_at)):
        buffer[np.arange(len(data)) + np.repeat(starts[:, column] - at[:-1], np.diff(at))] = data
    return buffer, np.append(starts[:, 0], len(buffer)), np.column_stack([starts[:, 3], lengths[:, 3]])


def _format(rows: pa.Table, part: int = 0) -> pa.RecordBatch:
    """Whole conversations, rows in order; or the ``part`` of one."""
    ids, roles, texts = (rows[c].combine_chunks() for c in ("conv_id", "role", "text"))
    buffer, turn_at, spans = assemble(roles, texts)
    keys, known = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (known[1:] != known[:-1])]))
    n_turns = np.diff(np.append(first, len(keys)))
    offsets = np.append(turn_at[first], len(buffer)).astype(np.int64)
    formatted = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(buffer)])
    spoken = np.flatnonzero(pc.fill_null(pc.equal(roles, "assistant"), False).to_numpy(zero_copy_only=False))
    owner = np.searchsorted(first, spoken, side="right") - 1
    starts = spans[spoken, 0] - offsets[owner]
    masks = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(first) + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(spans[spoken, 1], pa.int64())], fields=list(SPAN)))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array(np.full(len(first), part, np.int32)), pa.array(n_turns, pa.int64()), formatted.cast(pa.string()), masks], names=["conv_id", "part", "n_turns", "formatted", "loss"])


def _lengths(rows: pa.Table) -> np.ndarray:
    """Bytes of each row."""
    return sum(pc.fill_null(pc.binary_length(rows[c]), 0).to_numpy().astype(np.int64) for c in ("role", "text"))


def _pieces(rows: pa.Table) -> Iterator[pa.Table]:
    """Runs of rows of about ``PART_BYTES`` each."""
    if rows.num_rows:
        turn = np.cumsum(_lengths(rows)) // PART_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), rows.num_rows]
        yield from (rows.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False))


def format_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of conv_id, role, text, sorted by conversation and turn, as batches of conversations and parts."""
    held: list[pa.Table] = []  # rows of the open conversation that are not written yet
    size, part, key = 0, 0, None
    for rows in (piece for batch in batches for piece in _pieces(pa.Table.from_batches([batch]))):
        ids = rows["conv_id"].combine_chunks()
        keys, known = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
        changes = (keys[1:] != keys[:-1]) | (known[1:] != known[:-1])
        starts = np.flatnonzero(np.append((keys[0], known[0]) != key, changes)).tolist()
        onward = starts[0] if starts else len(keys)
        if onward:
            held.append(rows.slice(0, onward))
            size += int(_lengths(held[-1]).sum())
        if onward < len(keys):
            if held:
                yield _format(pa.concat_tables(held), part)
            last = starts[-1]
            if last > onward:
                yield _format(rows.slice(onward, last - onward))
            held, part, key = [rows.slice(last)], 0, (keys[-1], known[-1])
            size = int(_lengths(held[0]).sum())
        if size >= PART_BYTES:
            yield _format(pa.concat_tables(held), part)
            held, size, part = [], 0, part + 1
    if held:
        yield _format(pa.concat_tables(held), part)


def format_conversations(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation, or part of one: conv_id, part (from 0), n_turns, formatted text, and the byte spans of its loss mask."""

    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(format_batches, OUT)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns = []
    for part in formatted.split(END)[:-1]:
        role, _, text = part[len(OPEN) :].partition(SHUT)
        turns.append((unescape(role), unescape(text)))
    return turns


def read_loss(formatted: str, spans: list[dict]) -> str:
    """The text under the loss mask."""
    raw = formatted.encode()
    return "".join(unescape(raw[s["start"] : s["start"] + s["length"]].decode()) for s in spans)
