"""Class and concept forests: parents, roots, cycles, outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.terms import label_or_name, pick_label
from graphloom.functions.vocab import META_CLASSES, OWL, RDFS, SKOS, THING, TYPE
from graphloom.operators.closure import path_closure
from graphloom.operators.components import least_reaching, strong_components
from graphloom.operators.entity_graph import iri_links, subclass_parents
from graphloom.operators.results import places_within
from graphloom.plans.tables import written


def class_forest(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (graph, id, kind) and parents (graph, child, parent) of the named classes.

    Meta-classes are no nodes, but ``owl:Thing`` is one where declared; it is nobody's parent.
    """
    links = iri_links(triples)
    declared = links.where((F.col("p") == TYPE) & F.col("o").isin(OWL + "Class", RDFS + "Class")).select("graph", F.col("s").alias("id"))
    declared = declared.where(~F.col("id").isin(*META_CLASSES) | (F.col("id") == THING))
    raw = subclass_parents(triples)
    ends = raw.select("graph", F.explode(F.array("child", "parent")).alias("id")).where(~F.col("id").isin(*META_CLASSES))
    nodes = declared.unionByName(ends).distinct().withColumn("kind", F.lit("class"))
    ids = nodes.select("graph", "id")
    parents = raw.where(F.col("parent") != THING).join(ids.withColumnRenamed("id", "child"), ["graph", "child"], "left_semi").join(ids.withColumnRenamed("id", "parent"), ["graph", "parent"], "left_semi")
    return nodes, parents.select("graph", "child", "parent")


def concept_forest(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and parents of concepts under broader concepts and the schemes they top; a scheme is never a child."""
    links = iri_links(triples)
    pairs = lambda p, child, parent, top: links.where((F.col("p") == SKOS + p) & (F.col("s") != F.col("o"))).select("graph", F.col(child).alias("child"), F.col(parent).alias("parent"), F.lit(top).alias("top"))
    raw = pairs("broader", "s", "o", False).unionByName(pairs("narrower", "o", "s", False)).unionByName(pairs("hasTopConcept", "o", "s", True)).unionByName(pairs("topConceptOf", "s", "o", True))
    typed = links.where((F.col("p") == TYPE) & F.col("o").isin(SKOS + "Concept", SKOS + "ConceptScheme"))
    schemes = typed.where(F.col("o") == SKOS + "ConceptScheme").select("graph", F.col("s").alias("id")).unionByName(raw.where("top").select("graph", F.col("parent").alias("id"))).distinct()
    ids = typed.select("graph", F.col("s").alias("id")).unionByName(raw.select("graph", F.explode(F.array("child", "parent")).alias("id"))).distinct()
    nodes = ids.join(schemes.withColumn("scheme", F.lit(True)), ["graph", "id"], "left").select("graph", "id", F.when(F.col("scheme"), "conceptScheme").otherwise("concept").alias("kind"))
    parents = raw.select("graph", "child", "parent").distinct().join(schemes.withColumnRenamed("id", "child"), ["graph", "child"], "left_anti")
    return nodes, parents


def plain_roots(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    return nodes.select("graph", "id").join(parents.select("graph", F.col("child").alias("id")), ["graph", "id"], "left_anti")


def promoted_roots(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """graph, id of nodes locked in cycles that become roots: no root and no smaller locked node reaches them.

    Both are one question: roots rank before all others, and a node is promoted if the least that reaches it is itself.
    """
    down = parents.select("graph", F.col("parent").alias("a"), F.col("child").alias("b"))
    held = parents.select("graph", F.col("child").alias("id")).distinct().withColumn("rank", F.lit(1))
    values = nodes.select("graph", "id").distinct().join(held, ["graph", "id"], "left").select("graph", F.col("id").alias("node"), F.coalesce("rank", F.lit(0)).alias("rank"), "id")
    return least_reaching(down, values).where("rank = 1 and id = node").select("graph", "id")


def cycle_marks(parents: DataFrame) -> DataFrame:
    """graph, id of nodes that are their own ancestors: those of strong components, and those under themselves."""
    up = parents.select("graph", F.col("child").alias("a"), F.col("parent").alias("b"))
    return strong_components(up).select("graph", F.col("node").alias("id")).unionByName(up.where("a = b").select("graph", F.col("a").alias("id"))).distinct()


def forest_roots(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """graph, id, promoted."""
    return plain_roots(nodes, parents).withColumn("promoted", F.lit(False)).unionByName(promoted_roots(nodes, parents).withColumn("promoted", F.lit(True)))


def forest_assemble(triples: DataFrame, nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """graph, id, kind, label, children (sorted ids), has_children, origin."""
    children = parents.groupBy("graph", F.col("parent").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("child")), " ").alias("children"))
    out = label_or_name(nodes, pick_label(triples), "id").join(children, ["graph", "id"], "left")
    return out.select("graph", "id", "kind", "label", F.coalesce("children", F.lit("")).alias("children"), F.col("children").isNotNull().alias("has_children"), F.lit("asserted").alias("origin"))


def forest_truncate(nodes: DataFrame, parents: DataFrame, keep: int | Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ``keep`` nodes of each graph with most children (a number, or a column of ``nodes``), the pairs among them, and the new roots."""
    weight = parents.groupBy("graph", F.col("parent").alias("id")).agg(F.countDistinct("child").alias("n"))
    order = Window.partitionBy("graph").orderBy(F.desc("n"), "id")
    kept = nodes.join(weight, ["graph", "id"], "left").na.fill(0, ["n"]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep).drop("n", "place")
    ids = kept.select("graph", "id")
    inside = parents.join(ids.withColumnRenamed("id", "child"), ["graph", "child"], "left_semi").join(ids.withColumnRenamed("id", "parent"), ["graph", "parent"], "left_semi")
    return kept, inside, plain_roots(kept, inside)


def both_forests(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and parents of the class and the concept forest in one; the graph key ends with ``|class`` or ``|concept``."""
    (cn, cp), (kn, kp) = class_forest(triples), concept_forest(triples)
    mark = lambda df, name: df.withColumn("graph", F.concat("graph", F.lit("|" + name)))
    return mark(cn, "class").unionByName(mark(kn, "concept")), mark(cp, "class").unionByName(mark(kp, "concept"))


def _unmarked() -> tuple[Column, Column]:
    """The graph and the forest of a marked key."""
    forest = F.substring_index("graph", "|", -1)
    return F.col("graph").substr(F.lit(1), F.length("graph") - F.length(forest) - 1), forest


def hierarchy_counts(nodes: DataFrame, max_nodes: int = 50_000) -> DataFrame:
    """graph, classes, concepts, truncated, from the nodes of ``both_forests``."""
    graph, forest = _unmarked()
    rows = nodes.select(graph.alias("graph"), forest.alias("forest")).groupBy("graph").agg(F.count_if(F.col("forest") == "class").alias("classes"), F.count_if(F.col("forest") == "concept").alias("concepts"))
    return rows.withColumn("truncated", F.col("classes") + F.col("concepts") > max_nodes)


def hierarchy(triples: DataFrame, max_nodes: int = 50_000, forests: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both forests of every graph: nodes (graph, forest, id, kind, root), pairs (graph, forest, child, parent) and the counts.

    A graph of more than ``max_nodes`` nodes shares that number between its forests by their sizes (at least one class if
    there is any; halves to the even number); each forest keeps the nodes with most children, and a node whose
    parents went becomes a root.  The counts are always those of the whole graph.  ``forests``: the written ``both_forests``.
    """
    nodes, parents = forests or tuple(written(f, "forest") for f in both_forests(triples))
    counts = hierarchy_counts(nodes, max_nodes)
    share = F.when(F.col("classes") > 0, F.greatest(F.lit(1), F.bround(F.lit(max_nodes) * F.col("classes") / (F.col("classes") + F.col("concepts"))))).otherwise(0).cast("long")
    room = F.explode(F.array(*[F.struct(F.concat("graph", F.lit("|" + name)).alias("graph"), most.alias("most")) for name, most in (("class", share), ("concept", max_nodes - share))]))
    cut = counts.where("truncated").select(room.alias("r")).select("r.*")
    most = nodes.join(cut, "graph", "left").withColumn("truncated", F.col("most").isNotNull()).na.fill(1 << 62, ["most"])
    kept, inside, roots = forest_truncate(most, parents, F.col("most"))
    whole = forest_roots(nodes, parents).select("graph", "id")
    roots = roots.join(cut, "graph", "left_semi").unionByName(whole.join(cut, "graph", "left_anti")).withColumn("root", F.lit(True))
    graph, forest = _unmarked()
    out = kept.join(roots, ["graph", "id"], "left").select(graph.alias("graph"), forest.alias("forest"), "id", "kind", F.coalesce("root", F.lit(False)).alias("root"))
    return out, inside.select(graph.alias("graph"), forest.alias("forest"), "child", "parent"), counts


def ancestors(parents: DataFrame, ids: DataFrame, max_depth: int | None = None) -> DataFrame:
    """graph, id, ancestor, depth: each id itself (0) and all above it."""
    up = parents.select("graph", F.col("child").alias("a"), F.col("parent").alias("b"))
    found = path_closure(up, ids.select("graph", F.col("id").alias("start")), reflexive=True, max_depth=max_depth)
    return found.select("graph", F.col("start").alias("id"), F.col("node").alias("ancestor"), F.col("depth").cast("long").alias("depth"))


def appearance_counts(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """graph, id, places: how often a node shows in the tree (parents, plus one as a root)."""
    shown = parents.select("graph", F.col("child").alias("id")).unionByName(plain_roots(nodes, parents))
    return shown.groupBy("graph", "id").agg(F.count(F.lit(1)).alias("places"))


def expand_all(parents: DataFrame) -> DataFrame:
    return parents.select("graph", F.col("parent").alias("id")).distinct()


def tree_rows(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """graph, path (ids from the root), id, depth, children, cyclic, appears_elsewhere, sibling, position: the outline of a forest.

    A node below itself is shown there once, marked cyclic, and not descended into.  Rows of up to d steps below a root meet
    pieces of exactly d steps, which double each round, so a forest takes as many rounds as its depth has binary digits.
    ``position`` numbers the rows of a graph from the top, each before those below it, siblings by id.
    """
    kids = parents.groupBy("graph", F.col("parent").alias("id")).agg(F.countDistinct("child").alias("children"))
    places = appearance_counts(nodes, parents)
    roots = places_within(forest_roots(nodes, parents).select("graph", "id"), ["graph"], "id")
    rows = written(roots.select("graph", F.array("id").alias("path"), F.array("place").alias("ranks"), F.lit(False).alias("cyclic")), "rows")
    pairs = places_within(parents.select("graph", "parent", "child").distinct(), ["graph", "parent"], "child")
    # A piece: the node it starts below, the ids and ranks from there on, whether it ends at a node it holds already.
    piece = written(pairs.select("graph", F.col("parent").alias("head"), F.array("child").alias("path"), F.array("place").alias("ranks"), (F.col("parent") == F.col("child")).alias("cyclic")), "pieces")
    levels = [rows]
    while True:
        below = _joined(rows, piece, F.col("path"))
        below = written(below.select("graph", "path", "ranks", "cyclic"), "rows")
        if below.isEmpty():
            break
        levels.append(below)
        rows = rows.unionByName(below) if len(levels) < 4 else written(rows.unionByName(below), "rows")
        piece = written(_joined(piece, piece, F.concat(F.array("head"), "path")).select("graph", "head", "path", "ranks", "cyclic"), "pieces")
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    out = out.withColumn("id", F.element_at("path", -1)).join(kids, ["graph", "id"], "left").join(places, ["graph", "id"], "left").na.fill(0, ["children"])
    out = out.select("graph", F.array_join("path", " ").alias("path"), "id", (F.size("path") - 1).cast("long").alias("depth"), "children", "cyclic", (F.coalesce("places", F.lit(1)) > 1).alias("appears_elsewhere"), F.element_at("ranks", -1).alias("sibling"), "ranks")
    return places_within(out, ["graph"], "ranks").drop("ranks").withColumnRenamed("place", "position")


def _joined(left: DataFrame, piece: DataFrame, walked: Column) -> DataFrame:
    """Each left row that may go on, with the pieces below its end; ``walked`` are all its nodes.

    What holds a node twice before its end is left out: a shorter row, marked cyclic, stands for it.
    """
    ends = left.where("not cyclic").withColumn("walked", walked).withColumn("end", F.element_at("path", -1))
    tail = piece.select("graph", F.col("head").alias("end"), F.col("path").alias("more"), F.col("ranks").alias("more_ranks"))
    both = ends.join(tail, ["graph", "end"]).withColumn("all", F.concat("walked", "more"))
    inner, last = F.slice("all", F.lit(1), F.size("all") - 1), F.element_at("all", -1)
    both = both.withColumn("cyclic", F.array_contains(inner, last)).where(F.size(F.array_distinct(inner)) == F.size("all") - 1)
    return both.withColumn("path", F.concat("path", "more")).withColumn("ranks", F.concat("ranks", "more_ranks"))


def tree_filter(labelled: DataFrame, parents: DataFrame, query: str) -> DataFrame:
    """graph, id, matches: nodes whose label or local name holds the query, and all above them."""
    from graphloom.functions.terms import local_name

    needle = query.lower()
    hits = labelled.where(F.lower("label").contains(needle) | F.lower(local_name(F.col("id"))).contains(needle)).select("graph", "id")
    above = ancestors(parents, hits)
    return above.groupBy("graph", F.col("ancestor").alias("id")).agg((F.min("depth") == 0).alias("matches"))
