"""Size-balanced sharding by sampled splitters (DataFrame functions only).

1. A size-weighted sample of the sort key (a hash of the text) is drawn.
2. Its quantiles become splitters, and every record falls into a key range.
3. Exact sizes of all ranges are counted; an overfull range (many copies of one text, say)
   is subdivided by row.  The resulting cells are small, so each is ordered in one task.
4. The cells' exact sizes give every record its byte offset in the whole order; equal slices
   of the byte line are the shards, so their sizes differ by about one record.

Equal texts share a key and so are neighbours; only a group larger than a cell, or one on a
shard's edge, spans shards.  Only per-range sums reach the driver, at most twice the number of
ranges, which is bounded by ``MAX_RANGES_PER_SHARD``.

Defined results: null text has size 8 and checksum 0; repeated rows each get their own slot;
an empty table gives an empty result; columns not named in ``carry`` are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.scratch import stash

ROWS_PER_RANGE = 20_000
MIN_RANGES_PER_SHARD, MAX_RANGES_PER_SHARD = 16, 128
SAMPLE_PER_RANGE = 48


def _longs(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values]) if values else F.array().cast("array<bigint>")


def _rank_among(splitters: Sequence[int], key: Column) -> Column:
    """How many of the sorted splitters are at most ``key``: a binary search inside the row."""
    table, steps = _longs(splitters), [1 << b for b in range(len(splitters).bit_length() - 1, -1, -1)] if splitters else []

    def descend(found: Column, step: Column) -> Column:
        return found + F.when(F.get(table, found + step - 1) <= key, step).otherwise(F.lit(0))

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), descend) if steps else F.lit(0)


def assign_shards(documents: DataFrame, n_shards: int, *, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Per record: its id, ``carry`` columns, size, text_crc32, shard and slot (gapless from 0 in the shard)."""
    content = F.coalesce(F.col(text), F.lit(""))
    records = stash(
        documents.select(
            *[F.col(c) for c in carry],
            F.col(doc_id).alias("_id"),
            F.monotonically_increasing_id().alias("_row"),
            F.xxhash64(content).alias("_key"),
            (F.octet_length(content) + 8).cast("long").alias("_size"),
            F.crc32(content.cast("binary")).alias("_crc"),
        ),
        "records",
    )
    n_rows, n_bytes = records.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(1))).first()
    n_ranges = min(max(n_rows // ROWS_PER_RANGE, MIN_RANGES_PER_SHARD * n_shards), MAX_RANGES_PER_SHARD * n_shards)

    # 1: a record is drawn with a probability in proportion to its size; a larger one than a draw's share weighs more.
    share = F.col("_size") * F.lit(SAMPLE_PER_RANGE * n_ranges / n_bytes)
    uniform = F.pmod(F.xxhash64("_row", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = records.where(uniform < share).select("_key", F.greatest(F.lit(1), F.round(share)).cast("long").alias("weight"))
    # 2
    cuts = [i / n_ranges for i in range(1, n_ranges)]
    quantiles = sample.agg(F.percentile("_key", cuts, F.col("weight")).alias("q")).first()["q"] or []
    splitters = sorted({int(q) for q in quantiles})
    ranged = records.withColumn("_range", _rank_among(splitters, F.col("_key")))
    # 3
    loads = dict(ranged.groupBy("_range").agg(F.sum("_size")).collect())
    fair = n_bytes / n_ranges
    pieces = [max(1, round(loads.get(r, 0) / fair)) for r in range(len(splitters) + 1)]
    first_cell = [0, *accumulate(pieces)]
    piece = F.pmod(F.xxhash64("_row", F.lit(29)), F.get(_longs(pieces), F.col("_range")))
    celled = ranged.withColumn("_cell", (F.get(_longs(first_cell), F.col("_range")) + piece).cast("int"))
    totals = {cell: (rows, size) for cell, rows, size in celled.groupBy("_cell").agg(F.count(F.lit(1)), F.sum("_size")).collect()}
    cells = range(first_cell[-1])
    rows_before = [0, *accumulate(totals.get(c, (0, 0))[0] for c in cells)]
    bytes_before = [0, *accumulate(totals.get(c, (0, 0))[1] for c in cells)]
    # 4
    order = Window.partitionBy("_cell").orderBy("_key", "_id", "_crc", "_row")
    upto = F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    middle = 2 * (F.get(_longs(bytes_before), F.col("_cell")) + upto) - F.col("_size")
    placed = stash(
        celled.withColumn("_rank", F.get(_longs(rows_before), F.col("_cell")) + F.row_number().over(order) - 1)
        .withColumn("_middle", middle)
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(F.col("_middle") * n_shards / F.lit(2 * n_bytes))).cast("int")),
        "placed",
    )
    first_rank = dict(placed.groupBy("shard").agg(F.min("_rank")).collect())
    slot = F.col("_rank") - F.get(_longs([first_rank.get(s, 0) for s in range(n_shards)]), F.col("shard"))
    return placed.select(F.col("_id").alias(doc_id), *carry, F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard", slot.alias("slot"))
