"""The typed entity graph behind the triples: nodes with label, kind and degree; typed edges; statistics.

All functions take triples of many graphs and keep the ``graph`` key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.terms import kind_named, kind_of_type, kind_rank, label_or_name, local_name, pick_label
from graphloom.functions.vocab import EDGE_KINDS, IMPLIED_KINDS, RDFS, SUBCLASS, TYPE, XSD
from graphloom.plans.tables import written

#: Keys in use that are sent to all tasks.
MAX_SENT = 20_000


def iri_links(triples: DataFrame) -> DataFrame:
    """graph, s, p, o of triples between IRIs."""
    return triples.where((F.col("s_kind") == "iri") & (F.col("o_kind") == "iri")).select("graph", "s", "p", "o")


def _lookup(values: dict, of: str):
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col(of)]


def structural_edges(triples: DataFrame) -> DataFrame:
    """graph, source, target, kind, label: the edge predicates, inverse ones turned, ranges in XSD left out."""
    links = iri_links(triples).where(F.col("p").isin(*EDGE_KINDS) & ~((F.col("p") == RDFS + "range") & F.col("o").startswith(XSD)))
    turned = F.col("p").isin(*[p for p, (_, swap) in EDGE_KINDS.items() if swap])
    kind = _lookup({p: k for p, (k, _) in EDGE_KINDS.items()}, "p")
    ends = (F.when(turned, F.col("o")).otherwise(F.col("s")).alias("source"), F.when(turned, F.col("s")).otherwise(F.col("o")).alias("target"))
    return links.select("graph", *ends, kind.alias("kind"), F.lit("").alias("label")).distinct()


def typed_kinds(triples: DataFrame) -> DataFrame:
    """graph, id, kind from types and from what structural predicates imply for both ends."""
    links = iri_links(triples)
    typed = links.where(F.col("p") == TYPE).select("graph", F.col("s").alias("id"), kind_of_type(F.col("o")).alias("kind")).where("kind is not null")
    implied = links.where(F.col("p").isin(*IMPLIED_KINDS)).select("graph", F.explode(F.array("s", "o")).alias("id"), _lookup(IMPLIED_KINDS, "p").alias("kind"))
    return typed.unionByName(implied).distinct()


def _among(links: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """``links`` whose (graph, ``key``) is ``known``.

    Types and predicates in use are few and each may have any number of links, so the known ones of them are sent to all
    tasks: moved by its key, a hub would be one task.  More than ``MAX_SENT``, counted before, are joined by a shuffle.
    """
    used = written(links.select("graph", key).distinct().join(known, ["graph", key], "left_semi"), "used")
    return links.join(sent(used), ["graph", key], "left_semi")


def sent(known: DataFrame) -> DataFrame:
    """A written table, to be sent to all tasks of a join if it has at most ``MAX_SENT`` rows."""
    return F.broadcast(known) if known.limit(MAX_SENT + 1).count() <= MAX_SENT else known


def instance_edges(triples: DataFrame, kinds: DataFrame) -> DataFrame:
    """Edges from a resource to each of its types that is known as a class."""
    classes = kinds.where("kind = 'class'").select("graph", F.col("id").alias("o"))
    typed = iri_links(triples).where(F.col("p") == TYPE)
    return _among(typed, "o", classes).select("graph", F.col("s").alias("source"), F.col("o").alias("target"), F.lit("instanceOf").alias("kind"), F.lit("").alias("label")).distinct()


def assertion_edges(triples: DataFrame) -> DataFrame:
    """Uses, between IRIs, of what their own graph declares an object property, labelled by its local name."""
    links = iri_links(triples)
    properties = links.where((F.col("p") == TYPE) & (kind_of_type(F.col("o")) == "objectProperty")).select("graph", F.col("s").alias("p")).distinct()
    return _among(links, "p", properties).select("graph", F.col("s").alias("source"), F.col("o").alias("target"), F.lit("assertion").alias("kind"), local_name(F.col("p")).alias("label")).distinct()


def all_edges(triples: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """``kinds``: the written ``typed_kinds``, where there are any."""
    kinds = typed_kinds(triples) if kinds is None else kinds
    return structural_edges(triples).unionByName(instance_edges(triples, kinds)).unionByName(assertion_edges(triples))


def degrees(edges: DataFrame) -> DataFrame:
    """graph, id, degree: edge ends per node; a self-loop counts twice."""
    return edges.select("graph", F.explode(F.array("source", "target")).alias("id")).groupBy("graph", "id").agg(F.count(F.lit(1)).alias("degree"))


def kinds_and_degrees(evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """graph, id, kind, degree from one pass over typed kinds and edge ends.

    The most specific kind of all evidence wins; a source of instanceOf is an individual unless it is known as a class, scheme
    or concept; untyped edge ends are ``other``.
    """
    end = lambda name, instance: F.struct(F.col(name).alias("id"), instance.alias("instance"))
    ends = edges.select("graph", F.explode(F.array(end("source", F.col("kind") == "instanceOf"), end("target", F.lit(False)))).alias("e"))
    ends = ends.select("graph", "e.id", kind_rank(F.lit("other")).alias("rank"), F.lit(False).alias("exempt"), "e.instance", F.lit(1).alias("ends"))
    typed = evidence.select("graph", "id", kind_rank(F.col("kind")).alias("rank"), F.col("kind").isin("class", "conceptScheme", "concept").alias("exempt"), F.lit(False).alias("instance"), F.lit(0).alias("ends"))
    rows = typed.unionByName(ends).groupBy("graph", "id").agg(F.min("rank").alias("rank"), F.bool_or("exempt").alias("exempt"), F.bool_or("instance").alias("instance"), F.sum("ends").alias("degree"))
    rank = F.when(F.col("instance") & ~F.col("exempt"), F.least("rank", kind_rank(F.lit("individual")))).otherwise(F.col("rank"))
    return rows.select("graph", "id", kind_named(rank).alias("kind"), "degree")


def entity_kinds(triples: DataFrame, edges: DataFrame) -> DataFrame:
    """graph, id, kind."""
    return kinds_and_degrees(typed_kinds(triples), edges).drop("degree")


def entity_nodes(triples: DataFrame, edges: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """graph, id, label, kind, degree."""
    nodes = kinds_and_degrees(typed_kinds(triples) if kinds is None else kinds, edges)
    return label_or_name(nodes, pick_label(triples), "id").select("graph", "id", "label", "kind", "degree")


def entity_graph(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges; the typed kinds behind both are written once."""
    kinds = written(typed_kinds(triples), "kinds")
    edges = all_edges(triples, kinds)
    return entity_nodes(triples, edges, kinds), edges


def edges_within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (graph, id)."""
    ids = nodes.select("graph", "id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), ["graph", "source"], "left_semi").join(ids.withColumnRenamed("id", "target"), ["graph", "target"], "left_semi").select("graph", "source", "target", "kind", "label")


def kind_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("graph", "kind").agg(F.count(F.lit(1)).alias("n"))


def edge_counts(edges: DataFrame) -> DataFrame:
    """graph, edges, assertions, instance_edges."""
    return edges.groupBy("graph").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("kind") == "assertion").alias("assertions"), F.count_if(F.col("kind") == "instanceOf").alias("instance_edges"))


def composition(nodes: DataFrame) -> DataFrame:
    """graph, kind, n, percent and its place by falling count, then kind."""
    from pyspark.sql import Window

    counts = kind_counts(nodes)
    whole = F.sum("n").over(Window.partitionBy("graph"))
    place = F.row_number().over(Window.partitionBy("graph").orderBy(F.desc("n"), "kind"))
    return counts.select("graph", "kind", "n", F.round(100 * F.col("n") / whole, 6).alias("percent"), place.cast("long").alias("place"))


def legend(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph, what (node or edge), kind, n: what a drawing's legend names."""
    by = lambda frame, what: frame.groupBy("graph", "kind").agg(F.count(F.lit(1)).alias("n")).select("graph", F.lit(what).alias("what"), "kind", "n")
    return by(nodes, "node").unionByName(by(edges, "edge"))


def hide_kinds(nodes: DataFrame, edges: DataFrame, hidden: list[str]) -> tuple[DataFrame, DataFrame]:
    kept = nodes.where(~F.col("kind").isin(*hidden))
    return kept, edges_within(edges, kept)


def exclude_abox(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without individuals and facts; degrees counted anew."""
    kept = nodes.where("kind <> 'individual'").drop("degree")
    edges = edges_within(edges.where("kind not in ('instanceOf', 'assertion')"), kept)
    return kept.join(degrees(edges), ["graph", "id"], "left").na.fill(0, ["degree"]), edges


def focus_neighbors(nodes: DataFrame, edges: DataFrame, graph: str, focus: str) -> DataFrame:
    """graph, id, mark: selected, neighbour or dimmed around a node; off-graph focus marks nothing (empty mark)."""
    here = edges.where(F.col("graph") == graph)
    near = here.where(F.col("source") == focus).select(F.col("target").alias("id")).union(here.where(F.col("target") == focus).select("source")).distinct().withColumn("near", F.lit(True))
    known = nodes.where((F.col("graph") == graph) & (F.col("id") == focus)).select(F.col("graph").alias("_graph")).distinct()
    marked = nodes.where(F.col("graph") == graph).join(near, "id", "left").join(F.broadcast(known), F.col("graph") == F.col("_graph"), "left")  # one row at most
    mark = F.when(F.col("_graph").isNull(), "").when(F.col("id") == focus, "selected").when(F.col("near"), "neighbour").otherwise("dimmed")
    return marked.select("graph", "id", mark.alias("mark"))


def focus_edges(nodes: DataFrame, edges: DataFrame, graph: str, focus: str) -> DataFrame:
    """graph, source, target, kind, label, mark: incident or dimmed around a node; off-graph focus marks nothing (empty mark)."""
    known = nodes.where((F.col("graph") == graph) & (F.col("id") == focus)).select(F.lit(True).alias("_known"), "graph").distinct()  # one row at most
    mark = F.when(F.col("_known").isNull(), "").when((F.col("source") == focus) | (F.col("target") == focus), "incident").otherwise("dimmed")
    return edges.where(F.col("graph") == graph).join(F.broadcast(known), "graph", "left").select("graph", "source", "target", "kind", "label", mark.alias("mark"))


def merge_graph(nodes: DataFrame, edges: DataFrame, more_nodes: DataFrame, more_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges that a neighbourhood adds to a drawn graph; drawn ones stay untouched."""
    key = ["graph", "source", "target", "kind", "label"]
    new_nodes = more_nodes.join(nodes.select("graph", "id"), ["graph", "id"], "left_anti")
    drawn = nodes.select("graph", "id").unionByName(new_nodes.select("graph", "id"))
    return new_nodes, edges_within(more_edges.join(edges.select(*key), key, "left_anti"), drawn)


def merge_counts(nodes: DataFrame, edges: DataFrame, more_nodes: DataFrame, more_edges: DataFrame, whole_nodes: DataFrame, whole_edges: DataFrame) -> DataFrame:
    """graph, added_nodes, added_edges, drawn_nodes, drawn_edges, total_nodes, total_edges of each graph: what a merge adds, and
    what is drawn after it of what there is."""
    new_nodes, new_edges = merge_graph(nodes, edges, more_nodes, more_edges)
    count = lambda frame, name: frame.groupBy("graph").agg(F.count(F.lit(1)).alias(name))
    parts = [count(whole_nodes, "total_nodes"), count(whole_edges, "total_edges"), count(nodes, "old_nodes"), count(edges, "old_edges"), count(new_nodes.select("graph", "id").distinct(), "added_nodes"), count(new_edges.distinct(), "added_edges")]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "graph", "left")
    out = out.na.fill(0)
    return out.select("graph", "added_nodes", "added_edges", (F.col("old_nodes") + F.col("added_nodes")).alias("drawn_nodes"), (F.col("old_edges") + F.col("added_edges")).alias("drawn_edges"), "total_nodes", "total_edges")


def subclass_parents(triples: DataFrame) -> DataFrame:
    """graph, child, parent between named classes, no class under itself."""
    links = iri_links(triples).where((F.col("p") == SUBCLASS) & (F.col("s") != F.col("o")))
    return links.select("graph", F.col("s").alias("child"), F.col("o").alias("parent")).distinct()
