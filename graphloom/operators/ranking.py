"""Ranked cuts of an entity graph.  Every order ends with the id, so results are stable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.adjacency import MAX_WANTED, Share, Table, both_ends, node_shares, statements_of
from graphloom.operators.entity_graph import edges_within, kind_counts
from graphloom.plans.tables import written

DEFAULT_BUDGET, MAX_BUDGET = 2_000, 20_000
DEFAULT_NEIGHBORS, MAX_NEIGHBORS = 200, 2_000


def clamp(limit: int, most: int) -> int:
    return min(max(limit, 1), most)


def ranked(nodes: DataFrame) -> DataFrame:
    """With ``place`` in the graph by falling degree, then id."""
    return nodes.withColumn("place", F.row_number().over(Window.partitionBy("graph").orderBy(F.desc("degree"), "id")).cast("long"))


def budget_nodes(nodes: DataFrame, limit: int = DEFAULT_BUDGET) -> DataFrame:
    """The first ``limit`` (from 1 to ``MAX_BUDGET``) nodes of every graph, with their place."""
    return ranked(nodes).where(F.col("place") <= clamp(limit, MAX_BUDGET))


def budget_graph(nodes: DataFrame, edges: DataFrame, limit: int = DEFAULT_BUDGET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept nodes, edges among them, and per graph the totals, the budget applied and whether anything was left out."""
    kept, limit = written(budget_nodes(nodes, limit), "kept"), clamp(limit, MAX_BUDGET)  # few rows, so no edge moves to meet them
    totals = nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("total_nodes"))
    totals = totals.withColumn("budget", F.lit(limit).cast("long")).withColumn("truncated", F.col("total_nodes") > limit)
    return kept, edges_within(edges, kept), totals


def card_sketch(nodes: DataFrame, edges: DataFrame, size: int = 20) -> tuple[DataFrame, DataFrame]:
    kept, inside, _ = budget_graph(nodes, edges, size)
    return kept.select("graph", "id", "kind", "degree"), inside.select("graph", "source", "target")


def neighborhood(nodes: DataFrame, edges: DataFrame, centers: DataFrame, limit: int = DEFAULT_NEIGHBORS, *, people: Table | None = None, ends: Table | None = None) -> tuple[DataFrame, DataFrame]:
    """For every center (graph, center): the center and its best neighbours, and the edges among them.

    Nodes: graph, center, id, kind, degree, place (0: the center), neighbors (all of them), truncated.  ``limit`` is from 1
    to ``MAX_NEIGHBORS``.  ``people`` (nodes by id) and ``ends`` (``edge_ends`` by node) may be written in buckets; then only
    those of the centers and of their neighbours are read.  Without them all edges are read twice.  Either way no edge moves
    that is not one of theirs, and a center may have any number of neighbours.
    """
    limit = clamp(limit, MAX_NEIGHBORS)
    people = people or Table(nodes.select("graph", "id", "kind", "degree"), "id")
    centers = people.of(centers.select("graph", F.col("center").alias("id")).distinct()).select("graph", F.col("id").alias("center"), "kind", "degree")
    at = (ends or Table(both_ends(edges), "node")).of(centers.select("graph", F.col("center").alias("node"))).where("node <> other")
    pair = [F.col("node").alias("center"), F.col("other").alias("id")]
    if ends:
        near = written(at.select("graph", *pair, F.col("other_kind").alias("kind"), F.col("other_degree").alias("degree")).distinct(), "near")
    else:
        near = written(written(at.select("graph", *pair).distinct(), "pairs").join(nodes.select("graph", "id", "kind", "degree"), ["graph", "id"]), "near")
    totals = near.groupBy("graph", "center").agg(F.count(F.lit(1)).alias("neighbors"))
    # A filter on the rank alone lets every task cut its own rows to ``limit`` before they meet: a hub is no task's whole.
    order = F.row_number().over(Window.partitionBy("graph", "center").orderBy(F.desc("degree"), "id")).cast("long")
    best = near.withColumn("place", order).where(F.col("place") <= limit).join(totals, ["graph", "center"])
    best = written(best.select("graph", "center", "id", "kind", "degree", "place", "neighbors"), "hood")  # few rows a center, used twice
    middle = centers.join(totals, ["graph", "center"], "left").na.fill(0, ["neighbors"]).select("graph", "center", F.col("center").alias("id"), "kind", "degree", F.lit(0).cast("long").alias("place"), "neighbors")
    kept = best.unionByName(middle).withColumn("truncated", F.col("neighbors") > limit)
    members = kept.select("graph", "center", "id")
    ends = ends or Table(edges.select("graph", F.col("source").alias("node"), F.col("target").alias("other"), F.lit(True).alias("forward"), "kind", "label"), "node")
    inside = ends.of(members.select("graph", F.col("id").alias("node"), "center")).where("forward").select("graph", "center", F.col("node").alias("source"), F.col("other").alias("target"), "kind", "label")
    return kept, inside.join(members.withColumnRenamed("id", "target"), ["graph", "center", "target"], "left_semi").select("graph", "center", "source", "target", "kind", "label")


def node_details(triples: DataFrame, subjects: DataFrame | None = None, limit: int = 500, *, told: Table | None = None) -> DataFrame:
    """For every subject (graph, id): its statements both ways, ``limit`` each, ordered by predicate and value.

    graph, id, direction, p, value, place, total; totals count all statements, incoming rows list IRI subjects only.  Without
    ``subjects``, of all nodes that have statements.  ``told`` (``statements`` by id) may be written in buckets; then only those
    of the subjects are read.  As a plain table it is read once, and what moves are the subjects' statements.  Without it the
    nodes are taken in shares, each but the last written before the next begins: a statement moves once, and no more than a
    share's lie in shuffle files at a time.
    """
    if told:
        return _cut_details(written(told.of(subjects.select("graph", "id").distinct()).select(*_DETAIL_KEY, "p", "value", "listed"), "told"), limit)

    def of(share: Share) -> DataFrame:
        both = statements_of(triples, share)
        return both if subjects is None else both.join(subjects.select("graph", "id").where(share("id")), ["graph", "id"], "left_semi")

    shares, hubs = node_shares(triples)
    found = [_cut_details(of(hubs), limit)] if hubs else []
    found += [_details(of(share), limit) for share in shares]
    return reduce(DataFrame.unionByName, [*(written(x, "details") for x in found[:-1]), found[-1]])


_DETAIL_KEY = ("graph", "id", "direction")


def _details(both: DataFrame, limit: int) -> DataFrame:
    """Ranked and counted where a node's statements meet."""
    order = Window.partitionBy("id", "graph", "direction").orderBy(F.desc("listed"), "p", "value")
    total = F.count(F.lit(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = both.select(*_DETAIL_KEY, "p", "value", "listed", F.row_number().over(order).cast("long").alias("place"), total.alias("total"))
    return rows.where(F.col("listed") & (F.col("place") <= limit)).drop("listed")


def _cut_details(both: DataFrame, limit: int) -> DataFrame:
    """For few nodes of any number of statements, which meet only as counts and as the best of each task."""
    totals = both.groupBy(*_DETAIL_KEY).agg(F.count(F.lit(1)).alias("total"))
    # A filter on the rank alone lets every task cut its own rows to ``limit`` before they meet.
    listed = both.where("listed").drop("listed").withColumn("place", F.row_number().over(Window.partitionBy(*_DETAIL_KEY).orderBy("p", "value")).cast("long"))
    return listed.where(F.col("place") <= limit).join(totals, list(_DETAIL_KEY))


def undrawn_results(hits: DataFrame, drawn: DataFrame) -> DataFrame:
    """``hits`` (graph, id, ...) whose node is not among the drawn ones."""
    return hits.join(drawn.select("graph", "id"), ["graph", "id"], "left_anti")


def search_nodes(nodes: DataFrame, query: str, limit: int = 25, *, postings: DataFrame | None = None) -> DataFrame:
    """Per graph at most ``limit`` hits, label prefixes first, then others in label or IRI; ``place`` orders them.  No query: nothing.

    With ``postings`` (``search_postings`` of the same nodes) only nodes of blocks that hold every group of three letters of
    the query are checked; a query of fewer letters, or one whose groups are in most blocks, is looked for in all nodes.
    """
    needle, limit = query.strip().lower(), min(limit, 100)
    if postings is not None and len(needle) >= 3:
        grams = sorted({needle[i : i + 3] for i in range(len(needle) - 2)})
        held = postings.where(F.col("gram").isin(grams) & F.col("first").isin(sorted({g[0] for g in grams})))
        blocks = written(held.groupBy("graph", "block").agg(F.count_distinct("gram").alias("_grams")).where(F.col("_grams") == len(grams)).drop("_grams"), "blocks")
        if blocks.limit(MAX_WANTED + 1).count() <= MAX_WANTED:
            nodes = nodes.withColumn("block", _block()).join(F.broadcast(blocks), ["graph", "block"], "left_semi").select(nodes.columns)
    label, iri = F.lower("label"), F.lower("id")
    bucket = F.when(label.startswith(needle), 0).when(label.contains(needle) | iri.contains(needle), 1)
    hits = nodes.withColumn("bucket", bucket).where(F.col("bucket").isNotNull() & F.lit(bool(needle)))
    # A filter on the rank alone lets every task cut its own rows to ``limit`` before they meet.
    place = F.row_number().over(Window.partitionBy("graph").orderBy("bucket", "id")).cast("long")
    return hits.withColumn("place", place).where(F.col("place") <= limit)


def _block() -> Column:
    """Nodes whose IRIs differ in the last two characters only share a block."""
    return F.col("id").substr(F.lit(1), F.length("id") - 2)


def search_postings(nodes: DataFrame) -> DataFrame:
    """graph, gram, first, block: each block of nodes once under every three letters of its labels and IRIs, in lower case.

    Numbered IRIs make blocks of a hundred, which have little more groups of letters than one node.  Nodes are moved by
    their block, so their groups are made distinct where they are; each file is sorted by ``gram``.
    """
    texts = nodes.select("graph", _block().alias("block"), F.lower("label").alias("label"), F.lower("id").alias("iri")).repartition("graph", "block")
    texts = texts.select("graph", "block", F.explode(F.array("label", "iri")).alias("text")).where(F.length("text") >= 3)
    grams = texts.select("graph", "block", "text", F.explode(F.sequence(F.lit(1), F.length("text") - 2)).alias("at"))
    rows = grams.select("graph", F.col("text").substr(F.col("at"), F.lit(3)).alias("gram"), "block").distinct()
    return rows.withColumn("first", F.substring("gram", 1, 1)).sortWithinPartitions("gram", "block")


def suggest_entities(nodes: DataFrame, limit: int = 8, per_kind: int = 3) -> DataFrame:
    """Per graph: the best nodes, at most ``per_kind`` of a kind while others are left; headers excluded."""
    body = nodes.where("kind <> 'ontology'")
    in_kind = F.row_number().over(Window.partitionBy("graph", "kind").orderBy(F.desc("degree"), "id"))
    # Only the first ``limit`` of a kind can be chosen, so the graph-wide order sees few rows.
    top = body.withColumn("in_kind", in_kind).where(F.col("in_kind") <= limit)
    chosen = top.withColumn("turn", F.row_number().over(Window.partitionBy("graph").orderBy(F.col("in_kind") > per_kind, F.desc("degree"), "id")))
    return ranked(chosen.where(F.col("turn") <= limit).drop("in_kind", "turn"))


#: What kinds are called (fixed values).
_PLURAL = {"class": "classes", "objectProperty": "object properties", "datatypeProperty": "datatype properties", "annotationProperty": "annotation properties", "property": "properties", "concept": "SKOS concepts", "conceptScheme": "concept schemes", "collection": "collections", "individual": "individuals", "ontology": "ontology headers", "other": "others"}
_SINGLE = {"class": "class", "objectProperty": "object property", "datatypeProperty": "datatype property", "annotationProperty": "annotation property", "property": "property", "concept": "SKOS concept", "conceptScheme": "concept scheme", "collection": "collection", "individual": "individual", "ontology": "ontology header", "other": "other"}


def _word(kind: Column, n: Column) -> Column:
    table = lambda words: F.create_map(*[F.lit(x) for pair in words.items() for x in pair])[kind]
    return F.when(n == 1, table(_SINGLE)).otherwise(table(_PLURAL))


def contents_sentence(nodes: DataFrame) -> DataFrame:
    """graph, sentence naming the three largest kinds, by count, then kind."""
    place = F.row_number().over(Window.partitionBy("graph").orderBy(F.desc("n"), "kind"))
    top = kind_counts(nodes).withColumn("place", place).where("place <= 3")
    said = F.concat_ws(" ", F.format_number(F.col("n"), 0), _word(F.col("kind"), F.col("n")))
    parts = top.groupBy("graph").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", said.alias("said")))), lambda x: x["said"]).alias("parts"))
    many = F.concat(F.array_join(F.slice("parts", F.lit(1), F.size("parts") - 1), ", "), F.lit(" and "), F.element_at("parts", -1))
    listed = F.when(F.size("parts") > 1, many).otherwise(F.element_at("parts", 1))
    return parts.select("graph", F.concat(F.lit("This ontology describes "), listed, F.lit(".")).alias("sentence"))
