"""Repair of damaged conversations: the cheapest edits that give each the form ``(s?(ua)+)?``, with their audit.

Rows of one conversation are ordered by turn (nulls first), then role, then text, and may be any number:

1. All rows are range-partitioned in that order and written with their place in it.  A *piece* is the part of a conversation
   that lies in one partition, so a conversation of any length is pieces of bounded size.
2. A row repeats an earlier one if its role and text have a smaller first place in its conversation; first places are
   aggregated before they move, and the join on them is left to the engine's splitting of skewed partitions.
3. Every piece is reduced to the costs of leading from each of the four states to each (``alignment``).  A conversation's few
   pieces meet in one small problem, which settles the state at each cut; then every piece is solved by itself.
4. A digest of a conversation's repaired text reads it in order, so its rows stream through one task, with one piece's
   letters and one batch in memory.

Defined results: a null role or text is one space, as are null ids and turns where they are checked; null ids are one
conversation of their own; an empty text is blank; a role's initial is its first character, and one other than s, u, a can
only be reroled or deleted; repeated rows are duplicates of the first; other columns are ignored; a conversation without
rows has zeros, an empty audit and the digest of nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import alignment as al
from graphloom.llm.scratch import stash

BLANKS = " \t\n\x0b\f\r"
#: Bits of a place that number rows within a partition.
ROW_BITS = 33
PIECE = "key string, piece bigint, at bigint, codes binary"
SUMMARY = "key string, piece bigint, costs array<bigint>, ranks array<bigint>, first int, last int, illegal bigint"
CUTS = "key string, piece bigint, begin int, end int, tail int, cost bigint, illegal bigint"
LETTERS = "key string, piece bigint, at bigint, begin int, letters string"
NONE = hashlib.sha256(b"").hexdigest()


def damage(turns: DataFrame) -> DataFrame:
    """Rows conv_id, turn, role, text with one fault in every fourth, by the checksum of ``conv_id:turn`` modulo 20:
    0 drops the row, 1 empties its text, 2 removes its ``.``, ``!`` and ``?``, 3 repeats it, 4 makes it the user's."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.withColumn("fault", F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace(F.coalesce("text", F.lit(" ")), "[.!?]", "")).otherwise(F.coalesce("text", F.lit(" ")))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _key(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(" ")).alias("key")


def in_order(rows: DataFrame) -> DataFrame:
    """key, turn, role, text, place: the rows with their place in the order of all."""
    keyed = rows.select(_key("conv_id"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    order = (F.asc("key"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"))
    return stash(keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "ordered")


def code_turns(ordered: DataFrame) -> DataFrame:
    """key, piece, place, blank, duplicate, truncated, code: each row's first fault and its code as a step."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    said = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    rows = ordered.select("key", "place", said.alias("said"), (bare == "").alias("blank"), F.substring(F.col("role"), 1, 1).alias("initial"), F.substring(bare, -1, 1).alias("last"))
    first = rows.groupBy("key", "said").agg(F.min("place").alias("first"))
    seen = rows.join(first, ["key", "said"]).withColumn("duplicate", ~F.col("blank") & (F.col("place") > F.col("first")))
    cut = ~F.col("blank") & ~F.col("duplicate") & ~F.col("last").isin(".", "!", "?")
    initial = F.when(F.col("initial") == "s", 1).when(F.col("initial") == "u", 2).when(F.col("initial") == "a", 3).otherwise(0)
    code = initial + F.when(F.col("blank") | F.col("duplicate"), al.MUST_GO).otherwise(0) + F.when(cut, al.CUT_OFF).otherwise(0)
    return seen.select("key", F.shiftright("place", ROW_BITS).alias("piece"), "place", "blank", "duplicate", cut.alias("truncated"), code.cast("byte").alias("code"))


def _group_ends(columns: list[pa.Array]) -> np.ndarray:
    """Rows after which one of the columns changes, and the last."""
    n = len(columns[0])
    changed = np.zeros(max(n - 1, 0), dtype=bool)
    for c in columns:
        changed |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.append(np.flatnonzero(changed), n - 1) + 1 if n else np.zeros(0, np.int64)


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows key, piece, place, code as one row a piece with its codes in order."""
    held: list = []  # key, piece, first place, codes of the open piece
    for batch in batches:
        out: list[list] = []
        codes, begin = batch.column(3).to_numpy().astype(np.uint8), 0
        for end in _group_ends([batch.column(0), batch.column(1)]).tolist():
            key, piece = batch.column(0)[begin].as_py(), batch.column(1)[begin].as_py()
            if held and held[:2] == [key, piece]:
                held[3].append(codes[begin:end].tobytes())
            else:
                if held:
                    out.append([*held[:3], b"".join(held[3])])
                held = [key, piece, batch.column(2)[begin].as_py(), [codes[begin:end].tobytes()]]
            begin = end
        yield _rows(out, PIECE)
    if held:
        yield _rows([[*held[:3], b"".join(held[3])]], PIECE)


def _rows(rows: list, schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    named = [x.split(" ") for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(named)], names=[n for n, _ in named])


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces as the costs and ranks of their 16 ways, with their ends and illegal pairs."""
    legal = np.zeros((4, 4), dtype=bool)
    legal[tuple(np.array(sorted(al.LEGAL)).T)] = True
    for batch in batches:
        out = []
        for key, piece, codes in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            turns = al.Turns(codes)
            ways = [turns.forward(state, 0, len(turns)) for state in range(4)]
            initials = np.frombuffer(codes, np.uint8) & 3
            illegal = int((~legal[initials[:-1], initials[1:]]).sum())
            out.append([key, piece, [c for costs, _ in ways for c in costs], [r for _, ranks in ways for r in ranks], int(initials[0]), int(initials[-1]), illegal])
        yield _rows(out, SUMMARY)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted summaries as the states at the cuts; cost and illegal pairs stand with a conversation's last piece."""
    held: list[dict] = []

    def settled(pieces: list[dict]) -> list[list]:
        options = [tuple(tuple((y, p["costs"][4 * x + y], p["ranks"][4 * x + y]) for y in range(4) if p["costs"][4 * x + y] < al.NEVER) for x in range(4)) for p in pieces]
        steps = al.Stretches(options)
        cost, end = al.finish(steps)
        illegal = sum(p["illegal"] for p in pieces) + sum((a["last"], b["first"]) not in al.LEGAL for a, b in zip(pieces, pieces[1:], strict=False))
        out = [[p["key"], p["piece"], before, last, 0, 0, 0] for p, (before, last, _) in zip(pieces, al.crossings(steps, al.NOTHING, end), strict=True)]
        out[-1][4:] = [al.TAIL[end], cost, illegal]
        return out

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if held and held[0]["key"] != row["key"]:
                out += settled(held)
                held = []
            held.append(row)
        yield _rows(out, CUTS)
    if held:
        yield _rows(settled(held), CUTS)


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with the states at their ends as letters."""
    for batch in batches:
        out = []
        for key, piece, at, codes, begin, end, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            letters = "".join(tie for _, _, tie in al.crossings(al.Turns(codes), begin, end))
            out.append([key, piece, at, begin, letters + "I" * tail])
        yield _rows(out, LETTERS)


class _Writer:
    """The digest of a repaired conversation, row by row."""

    def __init__(self, key: str) -> None:
        self.key, self.digest, self.letters, self.at, self.state, self.any = key, hashlib.sha256(), "", 0, al.NOTHING, False

    def _add(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def _insert(self) -> None:
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self.state = al.after(self.state, "I")
            self._add("user" if self.state == al.USER else "assistant", "")
            self.at += 1

    def piece(self, letters: str, state: int) -> None:
        self._insert()
        self.letters, self.at, self.state = letters, 0, state

    def row(self, role: str, text: str) -> None:
        self._insert()
        letter = self.letters[self.at]
        self.at += 1
        self.state = al.after(self.state, letter, al.INITIALS.get(role[:1], 0))
        if letter != "D":
            self._add(role if letter == "K" else "user" if self.state == al.USER else "assistant", text)

    def end(self) -> list[str]:
        self._insert()
        return [self.key, self.digest.hexdigest()]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows key, letters, begin, role, text (a piece's letters before its rows) as key and digest."""
    writer: _Writer | None = None
    for batch in batches:
        out = []
        for first in range(0, len(batch), 1024):
            for key, letters, begin, role, text in zip(*(c.slice(first, 1024).to_pylist() for c in batch.columns), strict=True):
                if writer is None or writer.key != key:
                    if writer:
                        out.append(writer.end())
                    writer = _Writer(key)
                writer.row(role, text) if letters is None else writer.piece(letters, begin)
        yield _rows(out, "key string, digest string")
    if writer:
        yield _rows([writer.end()], "key string, digest string")


def repair_conversations(turns: DataFrame, damaged: DataFrame | None = None) -> DataFrame:
    """Per conversation of ``turns`` (columns conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256.  ``damaged`` holds the rows to repair where they differ from ``turns``."""
    ordered = in_order(turns if damaged is None else damaged)
    coded = stash(code_turns(ordered), "coded")
    pieces = stash(coded.select("key", "piece", "place", "code").repartition("key", "piece").sortWithinPartitions("key", "piece", "place").mapInArrow(_collect, PIECE), "pieces")
    summaries = pieces.mapInArrow(_summarise, SUMMARY)
    cuts = stash(summaries.repartition("key").sortWithinPartitions("key", "piece").mapInArrow(_settle, CUTS), "cuts")
    spelled = pieces.join(cuts.select("key", "piece", "begin", "end", "tail"), ["key", "piece"]).select("key", "piece", "at", "codes", "begin", "end", "tail")
    letters = stash(spelled.mapInArrow(_spell, LETTERS), "letters")
    nothing = F.lit(None).cast("string")
    heads = letters.select("key", F.col("at").alias("place"), F.lit(0).alias("kind"), "letters", "begin", nothing.alias("role"), nothing.alias("text"))
    said = ordered.select("key", "place", F.lit(1).alias("kind"), nothing.alias("letters"), F.lit(0).alias("begin"), "role", "text")
    streamed = heads.unionByName(said).repartition("key").sortWithinPartitions("key", "place", "kind")
    digests = streamed.select("key", "letters", "begin", "role", "text").mapInArrow(_digest, "key string, digest string")
    audits = letters.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "letters"))), lambda p: p["letters"]), "").alias("audit"))
    costs = cuts.groupBy("key").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"))
    faults = coded.groupBy("key").agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")])
    numbers = ordered.where("turn is not null").groupBy("key", "turn").agg(F.lit(1).alias("one")).groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    found = costs.join(faults, "key").join(audits, "key").join(digests, "key").join(numbers, "key", "left")
    whole = turns.select("conv_id", _key("conv_id")).distinct().join(found, "key", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return whole.select("conv_id", *map(count, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.lit(NONE)).alias("repaired_sha256"))
