"""Near-duplicate groups by an inverted join of MinHash signature coordinates.

1. Each text becomes its set of ``width``-word shingles (64-bit hashes) and a signature of ``COORDINATES``
   minima.  Texts with the same set are one class, which has a number; classes of rows that share an id are linked.
2. Documents are posted under their coordinate values.  A linked pair agrees in at least ``matches``
   coordinates (``agreements``), so by the prefix rule it agrees in one of the first ``COORDINATES - matches + 1``;
   only those are posted.  Lists of one document are dropped.
3. In every list each member meets the list's most central member.  Agreements are counted on the
   whole signatures, pairs below ``matches`` dropped, the rest confirmed on the full sets.
   Components of these links settle most lists: their members are connected already.
4. Lists that still span components are finished exactly.  Those of over ``BLOCK`` members are dealt into
   classes of set sizes, of which only equal and neighbouring ones can hold linked sets, and classes into blocks; every
   such pair of blocks compares the pairs that span components.  A pair counts only in the list of its first
   agreement, so later lists skip it.  Blocks with candidates then fetch the full sets, confirm,
   and return no more links than join their members.

A pair at exactly the threshold has at most one chance in a thousand million (``MISSED``) to agree in fewer than
``matches`` coordinates and so to be missed; every kept link is exact.

Defined results: null or wordless text has no shingles and links with nothing, its component is its own id; a text of
fewer words than ``width`` is one shingle; rows with words that share an id are one node, whatever their texts; a null id
links with nothing, its component is null and it is not kept; among equal sets the smallest id stands for all; columns other than the two named are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.components import connected_components
from graphloom.llm.scratch import stash
from graphloom.llm.textkit import U64, mix, shingle_hashes, slices, word_hashes

COORDINATES, MISSED = 64, 1e-9
BLOCK = 1024
#: Bytes of a batch of texts, sets or members on its way to Python.
BATCH_BYTES = 2_000_000
#: Shingles of the members that meet one copy of a hub's set.
HUB_SHINGLES = 4_000_000
#: Ids up to this number are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: What two texts of one class have in common.
SAME_SET = ["n_shingles", "f1", "f2"]

_rng = np.random.default_rng(77)
_FACTOR = _rng.integers(1, 2**63, COORDINATES, dtype=np.uint64) | U64(1)
_SHIFT = _rng.integers(1, 2**63, COORDINATES, dtype=np.uint64)


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows: (number of rows, sorted distinct shingle hashes row after row, offsets of the rows)."""
    for first, last, raw, bounds in slices(column):
        words, at = word_hashes(raw, bounds)
        hashes, rows = shingle_hashes(words, at, width)
        order = np.lexsort((hashes, rows))
        hashes, rows = hashes[order], rows[order]
        fresh = np.ones(len(hashes), dtype=bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
        hashes, rows = hashes[fresh], rows[fresh]
        yield last - first, hashes, np.searchsorted(rows, np.arange(last - first + 1))


def sign_documents(documents: DataFrame, *, doc_id: str, text: str, width: int) -> DataFrame:
    """doc_id, n_shingles, set fingerprint (f1, f2), signature (null for an empty set)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for n, hashes, bounds in shingle_sets(batch.column(1), width):
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                f1, f2 = fingerprints(hashes, bounds)
                minima = np.zeros((len(full), COORDINATES), dtype=np.int64)
                if len(full):
                    starts = bounds[full]
                    for k in range(COORDINATES):
                        minima[:, k] = np.minimum.reduceat((hashes ^ _SHIFT[k]) * _FACTOR[k], starts).view(np.int64)
                lengths = np.where(sizes > 0, COORDINATES, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(minima.ravel(), pa.int64()), mask=pa.array(sizes == 0))
                ids = batch.column(0).slice(done, n)
                done += n
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(f1), pa.array(f2), lists], names=["doc_id", "n_shingles", "f1", "f2", "signature"])
            pa.default_memory_pool().release_unused()

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(
        sign, "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, signature array<bigint>"
    )


def fingerprints(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set."""
    full = np.flatnonzero(np.diff(bounds))
    f1, f2 = np.zeros(len(bounds) - 1, np.int64), np.zeros(len(bounds) - 1, np.int64)
    if len(full):
        f1[full] = np.add.reduceat(hashes, bounds[full]).view(np.int64)
        f2[full] = np.add.reduceat(mix(hashes ^ _SHIFT[0]), bounds[full]).view(np.int64)
    return f1, f2


def fetch_sets(documents: DataFrame, classes: DataFrame, ids: DataFrame, *, doc_id: str, text: str, width: int) -> DataFrame:
    """rep, shingles (sorted distinct hashes) of the classes in ``ids`` (rep), from a text of each."""
    wanted = stash(ids.select("rep").distinct().join(classes.select("rep", "first_id", *SAME_SET), "rep"), "ids", gather=True)
    few = wanted.count() <= BROADCAST_IDS
    first = wanted.select("first_id")
    first = F.broadcast(first) if few else first

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for n, hashes, bounds in shingle_sets(batch.column(1), width):
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes.view(np.int64)))
                f1, f2 = fingerprints(hashes, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, n), pa.array(np.diff(bounds), pa.int64()), pa.array(f1), pa.array(f2), lists], names=["first_id", *SAME_SET, "shingles"])
                done += n
            pa.default_memory_pool().release_unused()

    texts = documents.select(F.col(doc_id).cast("long").alias("first_id"), F.col(text)).join(first, "first_id", "left_semi")
    sets = texts.mapInArrow(shingle, "first_id bigint, n_shingles bigint, f1 bigint, f2 bigint, shingles array<bigint>").dropDuplicates(["first_id", *SAME_SET])
    return stash(sets.join(F.broadcast(wanted) if few else wanted, ["first_id", *SAME_SET]).select("rep", "shingles"), "sets", batch_bytes=BATCH_BYTES)


def agreements(percent: int) -> int:
    """The most coordinates in which all but ``MISSED`` of the pairs at the threshold agree."""
    p, matches, below = percent / 100, 0, 0.0
    while matches < COORDINATES:
        below += comb(COORDINATES, matches) * p**matches * (1 - p) ** (COORDINATES - matches)
        if below > MISSED:
            break
        matches += 1
    if not matches:
        raise ValueError(f"{COORDINATES} coordinates are too few to find pairs at {percent} percent")
    return matches


def enough(shared: str, a: str, b: str, percent: int) -> str:
    return f"100 * {shared} >= {percent} * ({a} + {b} - {shared})"


def link_to_hubs(lists: DataFrame, classes: DataFrame, sets_of, percent: int) -> DataFrame:
    """Confirmed links (a, b) between list members and the most central member of their list.

    A hub's signature and set are sent once for every ``HUB_SHINGLES`` shingles of the members that meet it.
    """
    weight = lists.groupBy("rep").agg(F.sum("n_list").alias("weight"))
    hubs = lists.join(weight, "rep").groupBy("key").agg(F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("hub"))
    pairs = lists.select("rep", "key").join(hubs, "key").where("rep != hub").select("hub", "rep").distinct().join(classes.select("rep", F.col("n_shingles").alias("n_rep")), "rep")
    pairs = stash(pairs, "pairs", gather=True)
    slices = pairs.groupBy("hub").agg(F.ceil(F.sum("n_rep") / HUB_SHINGLES).cast("int").alias("slices"))
    dealt = pairs.join(slices, "hub").withColumn("slice", F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int")).drop("slices")
    copies = slices.select("hub", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    centre = copies.join(classes.select(F.col("rep").alias("hub"), F.col("signature").alias("s_hub"), F.col("n_shingles").alias("n_hub")), "hub")
    agreed = F.size(F.filter(F.zip_with("signature", "s_hub", lambda x, y: x == y), lambda same: same))
    near = F.expr(f"100 * least(n_rep, n_hub) >= {percent} * greatest(n_rep, n_hub)")
    met = dealt.join(classes.select("rep", "signature"), "rep").join(centre, ["hub", "slice"])
    candidates = stash(met.where(near & (agreed >= agreements(percent))).select("hub", "slice", "rep"), "candidates", gather=True)
    sets = sets_of(candidates.select("rep").unionByName(candidates.select(F.col("hub").alias("rep"))))
    members = candidates.join(sets.select("rep", F.col("shingles").alias("s_rep")), "rep")
    centres = candidates.select("hub", "slice").distinct().join(sets.select(F.col("rep").alias("hub"), F.col("shingles").alias("s_hub")), "hub")
    shared = members.join(centres, ["hub", "slice"]).select("hub", "rep", F.size("s_hub").alias("n_a"), F.size("s_rep").alias("n_b"), F.size(F.array_intersect("s_hub", "s_rep")).alias("shared"))
    return shared.where(enough("shared", "n_a", "n_b", percent)).select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b"))


def _spanning_pairs(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Iterator[tuple[int, int]]]:
    """Pairs of a block pair that span components, agree first in this list, and agree often enough."""
    reps, comps, sizes, blocks = (table[c].to_numpy() for c in ("rep", "comp", "n_shingles", "block"))
    signatures = table["signature"].combine_chunks().flatten().to_numpy().reshape(len(reps), COORDINATES)
    coordinate, low, high = (table[c][0].as_py() for c in ("coordinate", "low", "high"))
    matches = agreements(percent)
    left = np.flatnonzero(blocks == low)
    right = np.flatnonzero(blocks == high)

    def pairs() -> Iterator[tuple[int, int]]:
        for at, i in enumerate(left):
            others = right[at + 1 :] if low == high else right
            small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
            others = others[(comps[others] != comps[i]) & (100 * small >= percent * large)]
            if len(others):
                same = signatures[others] == signatures[i]
                hit = (same.sum(axis=1) >= matches) & ~same[:, :coordinate].any(axis=1)
                yield from ((i, j) for j in others[hit])

    return reps, comps, sizes, pairs()


def _spanning(members: DataFrame) -> DataFrame:
    """The lists that span components, with their number of members."""
    keys = members.groupBy("key").agg(F.count(F.lit(1)).alias("n_list"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi")
    return members.drop("n_list").join(keys.select("key", "n_list"), "key")


def finish_lists(lists: DataFrame, classes: DataFrame, components: DataFrame, sets_of, percent: int) -> DataFrame:
    """Confirmed links (a, b) that the lists still hold between different components."""
    placed = lists.join(components.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    members = _spanning(placed.where("n_list > 2").select("key", "coordinate", "rep", "comp"))
    members = members.join(classes.select("rep", "n_shingles", "signature"), "rep")
    # Linked sets lie in the same or in neighbouring classes of size; only large lists are dealt by size.
    step = 1.000001 * float(np.log(100 / percent)) if percent < 100 else 1e-9  # a little wider, for sets whose ratio is just the threshold
    size = F.when(F.col("n_list") > BLOCK, F.floor(F.log("n_shingles") / F.lit(step))).otherwise(0).cast("long")
    members = members.withColumn("size", size)
    rooms = members.groupBy("key", "size").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    code = lambda size, block: F.shiftleft(size, 20) + block
    members = members.join(rooms, ["key", "size"]).withColumn("block", code(F.col("size"), F.pmod(F.xxhash64("rep"), F.col("blocks"))))
    near = members.withColumn("size", F.explode(F.when(F.col("n_list") > BLOCK, F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).otherwise(F.array("size")))).drop("blocks")
    near = near.join(rooms, ["key", "size"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("other", code(F.col("size"), F.col("part")))
    group = ("key", "low", "high")
    dealt = stash(near.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "coordinate", "rep", "comp", "block", "n_shingles", "signature"), "dealt")

    def any_candidate(table: pa.Table) -> pa.Table:
        found = next(_spanning_pairs(table, percent)[3], None)
        return table.select(list(group)).slice(0, 1 if found else 0)

    live = stash(dealt.groupBy(*group).applyInArrow(any_candidate, "key bigint, low bigint, high bigint"), "live", batch_bytes=BATCH_BYTES, gather=True)
    chosen = dealt.join(live, list(group), "left_semi")
    with_sets = chosen.join(sets_of(chosen.select("rep")), "rep")

    def confirm(table: pa.Table) -> pa.Table:
        reps, comps, _, pairs = _spanning_pairs(table, percent)
        sets = table["shingles"].combine_chunks()
        values, offsets = sets.flatten().to_numpy(), sets.offsets.to_numpy() - sets.offsets[0].as_py()
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        links = []
        for i, j in pairs:
            ci, cj = root(int(comps[i])), root(int(comps[j]))
            if ci == cj:
                continue
            a, b = values[offsets[i] : offsets[i + 1]], values[offsets[j] : offsets[j + 1]]
            shared = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * shared >= percent * (len(a) + len(b) - shared):
                parent[max(ci, cj)] = min(ci, cj)
                links.append((int(reps[i]), int(reps[j])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return with_sets.groupBy(*group).applyInArrow(confirm, "a bigint, b bigint")


def one_id_links(usable: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of rows that share an id."""
    several = usable.groupBy("doc_id").agg(F.min(F.struct(*SAME_SET)).alias("low"), F.max(F.struct(*SAME_SET)).alias("high")).where("low <> high")
    rows = usable.join(several.select("doc_id"), "doc_id").select("doc_id", *SAME_SET).distinct().join(classes.select("rep", *SAME_SET), SAME_SET)
    rows = rows.select("doc_id", "rep")
    least = rows.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return rows.join(least, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b"))


def near_duplicates(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 85) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id, kept.  Links: similarity of at least ``percent`` / 100."""
    signed = stash(sign_documents(documents, doc_id=doc_id, text=text, width=width), "signed", batch_bytes=BATCH_BYTES)
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy(*SAME_SET).agg(F.min("doc_id").alias("first_id"), F.first("signature").alias("signature"))
    classes = stash(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    postings = classes.select("rep", F.posexplode(F.slice("signature", 1, COORDINATES - agreements(percent) + 1)).alias("coordinate", "key"))
    shared = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n_list")).where("n_list > 1")
    lists = stash(postings.join(shared, "key").distinct(), "lists", gather=True)
    sets_of = lambda ids: fetch_sets(documents, classes, ids, doc_id=doc_id, text=text, width=width)
    links = stash(one_id_links(usable, classes).unionByName(link_to_hubs(lists, classes, sets_of, percent)), "links", gather=True)
    more = stash(finish_lists(lists, classes, connected_components(links), sets_of, percent), "links", batch_bytes=BATCH_BYTES, gather=True)
    components = connected_components(links.unionByName(more)).withColumnRenamed("node", "rep")
    joined = classes.join(components, "rep", "left").select(*SAME_SET, "first_id", F.coalesce("component", "rep").alias("component"))
    smallest = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    labelled = joined.join(smallest, "component").select(*SAME_SET, "component_id")
    placed = usable.join(labelled, SAME_SET).select("doc_id", "n_shingles", "component_id")
    alone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
