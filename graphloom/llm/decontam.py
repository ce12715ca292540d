"""Benchmark decontamination by a prefix-filtered set join (DataFrame functions only).

Benchmark items become windows of ``width`` words (a shorter item: one window of all its
words).  Words are ordered by their corpus frequency; since a window must occur whole, its
rarest word is a sufficient prefix, so each window is indexed under that one word with its
offset.  Document words meet the index in a broadcast hash join whose condition applies the
positional bounds and then verifies the window word by word.  The document's word list
is only referenced, never copied, while its words stream through the join.

The index is broadcast in blocks of at most about ``block_windows`` windows and ``block_bytes`` bytes.  One block suffices for
any usual benchmark; a larger one takes more passes and is never cut.  Only windows are broadcast, with numbers; the
items that hold them, of which a phrase may have many, are joined to the documents' hits afterwards.

Defined results: null or wordless text has no words and no hits; an item without words has no
window; repeated document rows each get their row; empty tables give empty results (an empty
benchmark: no hits); a null item id is no item, but its windows hit; ties in rarity go to the smaller word.  Extra columns of
either input, whatever their names, are ignored.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.scratch import stash

#: Fixed by the contract: what separates words, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; plain ASCII text takes the fast built-in."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def benchmark_windows(items: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """item, win: each window (its words) of each item, once; items as strings."""
    words = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("words"))
    n = F.size("words")
    starts = F.when(n >= width, F.sequence(F.lit(1), n - width + 1)).when(n > 0, F.array(F.lit(1)))
    return words.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, F.lit(width)))).alias("win")).distinct()


def rarest_word_index(windows: DataFrame, word_counts: DataFrame) -> DataFrame:
    """One row per window: its number, its rarest word (ties: the smaller word), the offset of that word, the window."""
    spots = windows.select("number", "win", F.posexplode("win").alias("spot", "token"))
    ranked = spots.join(word_counts, "token", "left").groupBy("number").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "spot")).alias("best"), F.first("win").alias("win"))
    return ranked.select(F.col("best.token").alias("token"), F.col("best.spot").alias("spot"), "win", "number")


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 10,
    block_windows: int = 100_000,
    block_bytes: int = 32_000_000,
) -> DataFrame:
    """One row per document row: id, n_words, spans (start, length of each occurring window), items, n_hit."""
    holders = stash(benchmark_windows(benchmark, item_id, item_text, width), "holders")
    windows = stash(holders.select("win").distinct().select(F.monotonically_increasing_id().alias("number"), "win"), "windows")
    tokens = windows.select(F.explode("win").alias("token")).distinct()
    n_windows, n_bytes = windows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.array_join("win", " "))), F.lit(0))).first()
    blocks = max(1, -(-n_windows // block_windows), -(-n_bytes // block_bytes))
    block_of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    doc_words = documents.select(
        F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("_id"), words_of(F.col(text)).alias("_words")
    )

    stream = documents.select(F.explode(words_of(F.col(text))).alias("token"))
    counts = [
        stream.join(F.broadcast(tokens.where(block_of("token") == b)), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        for b in range(blocks)
    ]
    index = stash(rarest_word_index(windows, reduce(DataFrame.unionByName, counts)), "index")

    # An empty word that no text holds marks each row's end, so one pass also yields rows without hits.
    mark = documents.sparkSession.range(1).select(
        F.lit("").alias("token"), F.lit(0).alias("spot"), F.array().cast("array<string>").alias("win"), F.lit(None).cast("long").alias("number")
    )
    spread = doc_words.select("_row", "_id", "_words", F.posexplode(F.array_append("_words", F.lit(""))).alias("_pos", "_word"))
    found = []
    for b in range(blocks):
        part = index.where(block_of("win") == b)
        part = part.unionByName(mark) if b == 0 else part
        start = F.col("_pos") - F.col("spot")
        occurs = (
            (F.col("_word") == F.col("token"))
            & (start >= 0)
            & (start + F.size("win") <= F.size("_words"))
            & (F.slice("_words", start + 1, F.size("win")) == F.col("win"))
        )
        found.append(
            spread.join(F.broadcast(part), occurs).select(
                "_row", "_id", F.size("_words").cast("long").alias("n_words"), start.alias("start"), F.size("win").alias("length"), "number"
            )
        )
    hits = reduce(DataFrame.unionByName, found)
    spans = F.filter(F.sort_array(F.collect_set(F.struct("start", "length"))), lambda s: s["length"] > 0)
    per_row = hits.groupBy("_row").agg(F.first("_id").alias("_id"), F.max("n_words").alias("n_words"), spans.alias("spans"), F.collect_set("number").alias("_numbers"))
    per_row = stash(per_row, "rows")
    named = holders.where("item is not null").join(windows, "win").select("number", "item")
    held = per_row.select("_row", F.explode("_numbers").alias("number")).join(named, "number").groupBy("_row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    whole = per_row.join(held, "_row", "left").withColumn("n_hit", covered("spans"))
    return whole.select(F.col("_id").alias(doc_id), "n_words", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"), "n_hit")


def covered(spans: str) -> Column:
    """Words covered by sorted spans, each word once."""
    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("reach"))

    def step(acc: Column, s: Column) -> Column:
        end = (s["start"] + s["length"]).cast("long")
        fresh = F.greatest(F.lit(0).cast("long"), end - F.greatest(acc["reach"], s["start"].cast("long")))
        return F.struct((acc["hit"] + fresh).alias("hit"), F.greatest(acc["reach"], end).alias("reach"))

    return F.aggregate(F.col(spans), zero, step, lambda acc: acc["hit"])
