"""The class-level schema of a graph: classes, links and data properties from declarations, restrictions and data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.terms import default_datatype, is_literal_type, label_or_name, pick_label
from graphloom.functions.vocab import CLASS_KINDS, META_CLASSES, OWL, RDF, RDFS, SCHEMA_PREDICATES, SUBCLASS, THING, TYPE, XSD
from graphloom.operators.closure import chain_closure, path_closure
from graphloom.operators.entity_graph import iri_links, sent, subclass_parents
from graphloom.plans.tables import written

MAX_LINKS, MAX_DATA_PROPS, MAX_DEPTH = 60_000, 200, 8


def instance_types(triples: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """graph, s, type of named resources; meta-classes are no types.  ``types``, here and below: the same, written before."""
    return typings(triples).distinct() if types is None else types


def typings(triples: DataFrame) -> DataFrame:
    """``instance_types``, with those that are stated more than once as often."""
    return iri_links(triples).where((F.col("p") == TYPE) & ~F.col("o").isin(*META_CLASSES)).select("graph", "s", F.col("o").alias("type"))


def class_instances(triples: DataFrame, types: DataFrame | None = None) -> DataFrame:
    return instance_types(triples, types).groupBy("graph", F.col("type").alias("iri")).agg(F.count(F.lit(1)).alias("instances"))


def rdf_list_items(triples: DataFrame, heads: DataFrame) -> DataFrame:
    """graph, head, member, member_kind of the collections that start at (graph, head), of any length; cycles are safe."""
    rest = triples.where((F.col("p") == RDF + "rest") & (F.col("o") != RDF + "nil")).select("graph", F.col("s").alias("a"), F.col("o").alias("b"))
    cells = chain_closure(rest, heads.select("graph", F.col("head").alias("start")))
    first = triples.where(F.col("p") == RDF + "first").select("graph", F.col("s").alias("node"), F.col("o").alias("member"), F.col("o_kind").alias("member_kind"))
    return cells.join(first, ["graph", "node"]).select("graph", F.col("start").alias("head"), "member", "member_kind").distinct()


def set_members(triples: DataFrame) -> DataFrame:
    """graph, a (expression), b (member), b_kind: members of every union and intersection."""
    sets = triples.where(F.col("p").isin(OWL + "intersectionOf", OWL + "unionOf") & (F.col("o_kind") != "literal")).select("graph", F.col("s").alias("a"), F.col("o").alias("head"))
    items = rdf_list_items(triples, sets.select("graph", "head"))
    return sets.join(items, ["graph", "head"]).select("graph", "a", F.col("member").alias("b"), F.col("member_kind").alias("b_kind")).distinct()


def named_classes_in(triples: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """graph, expression, named: named members of nested unions and intersections, at most eight deep."""
    members = set_members(triples) if members is None else members
    nested = members.where("b_kind = 'bnode'").select("graph", "a", "b")
    deep = path_closure(nested, members.select("graph", F.col("a").alias("start")), reflexive=True, max_depth=MAX_DEPTH)
    named = members.where("b_kind = 'iri'").select("graph", F.col("a").alias("node"), F.col("b").alias("named"))
    return deep.join(named, ["graph", "node"]).select("graph", F.col("start").alias("expression"), "named").distinct()


#: Predicates of class expressions, and of all that declares classes and properties.
_EXPRESSIONS = (RDF + "first", RDF + "rest", SUBCLASS, *(OWL + p for p in ("intersectionOf", "unionOf", "equivalentClass", "onProperty", "someValuesFrom", "allValuesFrom", "onClass", "hasValue")))
_DECLARING = (*_EXPRESSIONS, RDFS + "domain", RDFS + "range")


def declarations(triples: DataFrame) -> DataFrame:
    """The triples that the schema follows from, apart from instances: a scan of all triples for each of their kinds is spared."""
    return triples.where(F.col("p").isin(*_DECLARING) | ((F.col("p") == TYPE) & F.col("o").isin(*META_CLASSES)))


def _declared(triples: DataFrame, declared: DataFrame | None) -> DataFrame:
    return written(declarations(triples), "declared") if declared is None else declared


def restriction_links(triples: DataFrame, types: DataFrame | None = None, declared: DataFrame | None = None) -> DataFrame:
    """graph, source, predicate, target stated by restrictions on a class, also nested in set operators.

    ``declared``, here and below: the written ``declarations``, where there are any.
    """
    whole, triples = triples, _declared(triples, declared)  # read many times
    members = set_members(triples)
    nested = members.where("b_kind <> 'literal'").select("graph", "a", "b")
    hung = triples.where(F.col("p").isin(SUBCLASS, OWL + "equivalentClass") & (F.col("s_kind") == "iri") & (F.col("o_kind") == "bnode"))
    hung = hung.where(~F.col("s").isin(*META_CLASSES)).select("graph", F.col("s").alias("source"), F.col("o").alias("start")).distinct()
    inside = path_closure(nested, hung.select("graph", "start"), reflexive=True, max_depth=MAX_DEPTH)
    held = hung.join(inside, ["graph", "start"]).select("graph", "source", F.col("node").alias("s")).distinct()
    on = triples.where((F.col("p") == OWL + "onProperty") & (F.col("o_kind") == "iri")).groupBy("graph", "s").agg(F.min("o").alias("predicate"))
    fillers = triples.where(F.col("p").isin(OWL + "someValuesFrom", OWL + "allValuesFrom", OWL + "onClass"))
    direct = fillers.where("o_kind = 'iri'").select("graph", "s", F.col("o").alias("target"))
    buried = fillers.where("o_kind = 'bnode'").select("graph", "s", F.col("o").alias("expression")).join(named_classes_in(triples, members), ["graph", "expression"]).select("graph", "s", F.col("named").alias("target"))
    valued = triples.where((F.col("p") == OWL + "hasValue") & (F.col("o_kind") == "iri")).select("graph", F.col("s").alias("r"), F.col("o").alias("s"))
    # A few values are sent to the types, which then need not move.
    valued = (typings(whole) if types is None else types).join(sent(written(valued, "valued")), ["graph", "s"]).select("graph", F.col("r").alias("s"), F.col("type").alias("target"))
    targets = direct.unionByName(buried).unionByName(valued).where(~F.col("target").isin(*META_CLASSES) & ~is_literal_type(F.col("target")))
    return held.join(on, ["graph", "s"]).join(targets, ["graph", "s"]).select("graph", "source", "predicate", "target").distinct()


def schema_class_ids(triples: DataFrame, restrictions: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """graph, iri of every class worth listing."""
    links = iri_links(triples)
    typed = (typings(triples) if types is None else types).select("graph", F.col("type").alias("iri"))
    declared = links.where((F.col("p") == TYPE) & F.col("o").isin(OWL + "Class", RDFS + "Class")).select("graph", F.col("s").alias("iri"))
    named = lambda p, end, kind: triples.where((F.col("p") == p) & (F.col(kind) == "iri")).select("graph", F.col(end).alias("iri"))
    ends = named(SUBCLASS, "s", "s_kind").unionByName(named(SUBCLASS, "o", "o_kind")).unionByName(named(RDFS + "domain", "o", "o_kind"))
    ranges = named(RDFS + "range", "o", "o_kind").where(~is_literal_type(F.col("iri")))
    found = declared.unionByName(ends).unionByName(ranges).where(~F.col("iri").isin(*META_CLASSES)).unionByName(typed)
    return found.unionByName(restrictions.select("graph", F.col("target").alias("iri"))).distinct()


def schema_classes(triples: DataFrame, restrictions: DataFrame | None = None, types: DataFrame | None = None) -> DataFrame:
    """graph, iri, label, instances, kind."""
    restrictions = restriction_links(triples) if restrictions is None else restrictions
    classes = schema_class_ids(triples, restrictions, types).join(class_instances(triples, types), ["graph", "iri"], "left").na.fill(0, ["instances"])
    kinds = F.create_map(*[F.lit(x) for pair in CLASS_KINDS.items() for x in pair])
    out = label_or_name(classes, pick_label(triples), "iri")
    return out.select("graph", "iri", "label", "instances", F.coalesce(kinds[F.col("iri")], F.lit("class")).alias("kind"))


def domain_range_links(triples: DataFrame) -> DataFrame:
    """graph, source, predicate, target: each declared domain with each declared range that is no datatype."""
    links = iri_links(triples)
    domains = links.where(F.col("p") == RDFS + "domain").select("graph", F.col("s").alias("predicate"), F.col("o").alias("source"))
    ranges = links.where((F.col("p") == RDFS + "range") & ~is_literal_type(F.col("o"))).select("graph", F.col("s").alias("predicate"), F.col("o").alias("target"))
    return domains.join(ranges, ["graph", "predicate"]).select("graph", "source", "predicate", "target").distinct()


def _typed_subjects(triples: DataFrame, types: DataFrame | None = None) -> DataFrame:
    data = triples.where((F.col("s_kind") == "iri") & ~F.col("p").isin(*SCHEMA_PREDICATES))
    return data.join(_by_node(instance_types(triples, types)).withColumnRenamed("type", "source"), ["graph", "s"])


def _by_node(types: DataFrame) -> DataFrame:
    """For joins by node: a node has few types, so a partition's are held in a table, and neither side is sorted by its long IRIs."""
    return types.hint("shuffle_hash")


def observed_links(triples: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """graph, source, predicate, target, n: every use counts once for each pair of its ends' types."""
    targets = _by_node(instance_types(triples, types).select("graph", F.col("s").alias("o"), F.col("type").alias("target")))
    uses = _typed_subjects(triples, types).where("o_kind = 'iri'").select("graph", "source", "p", "o")
    # Uses are counted per object first: a hub object joins its types once per predicate, not once per use.
    uses = uses.groupBy("graph", "source", "p", "o").agg(F.count(F.lit(1)).alias("n"))
    return uses.join(targets, ["graph", "o"]).groupBy("graph", "source", F.col("p").alias("predicate"), "target").agg(F.sum("n").alias("n"))


def observed_data_props(triples: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """graph, class, predicate, datatype, n."""
    datatype = default_datatype(F.col("o_datatype"), F.col("o_lang")).alias("datatype")
    return _typed_subjects(triples, types).where("o_kind = 'literal'").groupBy("graph", F.col("source").alias("class"), F.col("p").alias("predicate"), datatype).agg(F.count(F.lit(1)).alias("n"))


def declared_data_props(triples: DataFrame, classes: DataFrame, observed: DataFrame) -> DataFrame:
    """graph, class, predicate, datatype: declared datatype properties that no instance of their domain uses."""
    links = iri_links(triples)
    props = links.where((F.col("p") == TYPE) & (F.col("o") == OWL + "DatatypeProperty")).select("graph", F.col("s").alias("predicate")).distinct()
    domains = links.where(F.col("p") == RDFS + "domain").select("graph", F.col("s").alias("predicate"), F.col("o").alias("class"))
    ranges = links.where(F.col("p") == RDFS + "range").groupBy("graph", F.col("s").alias("predicate")).agg(F.min("o").alias("datatype"))
    found = props.join(domains, ["graph", "predicate"]).join(classes.select("graph", F.col("iri").alias("class")), ["graph", "class"], "left_semi")
    unused = found.join(observed.select("graph", "class", "predicate").distinct(), ["graph", "class", "predicate"], "left_anti")
    return unused.join(ranges, ["graph", "predicate"], "left").select("graph", "class", "predicate", F.coalesce("datatype", F.lit(XSD + "string")).alias("datatype"))


def schema_links(triples: DataFrame, restrictions: DataFrame | None = None, max_links: int = MAX_LINKS, types: DataFrame | None = None, declared: DataFrame | None = None, among: DataFrame | None = None) -> DataFrame:
    """graph, source, predicate, target, declared, restriction, n: all link sources merged, both ends known classes.

    At most ``max_links`` per graph, most used first; ``truncated`` tells whether more exist.  ``among``: written (graph, iri)
    of the only classes that either end may be; only their instances' uses are then counted.
    """
    declarations = _declared(triples, declared)
    restrictions = restriction_links(triples, types, declarations) if restrictions is None else restrictions
    if among is not None:
        among = sent(among.distinct())
        types = written((typings(triples) if types is None else types).join(among.withColumnRenamed("iri", "type"), ["graph", "type"], "left_semi").select("graph", "s", "type").distinct(), "types-among")
    part = lambda df, declared, restriction: df.select("graph", "source", "predicate", "target", F.lit(declared).alias("declared"), F.lit(restriction).alias("restriction"), (F.col("n") if "n" in df.columns else F.lit(0)).cast("long").alias("n"))
    every = part(restrictions, False, True).unionByName(part(domain_range_links(declarations), True, False)).unionByName(part(observed_links(triples, types), False, False))
    merged = every.groupBy("graph", "source", "predicate", "target").agg(F.bool_or("declared").alias("declared"), F.bool_or("restriction").alias("restriction"), F.sum("n").alias("n"))
    ids = schema_class_ids(declarations, restrictions, typings(triples) if types is None else types)
    if among is not None:
        ids = ids.join(among, ["graph", "iri"], "left_semi")
    known = merged.join(ids.withColumnRenamed("iri", "source"), ["graph", "source"], "left_semi").join(ids.withColumnRenamed("iri", "target"), ["graph", "target"], "left_semi")
    order = Window.partitionBy("graph").orderBy(F.desc("n"), "source", "predicate", "target")
    placed = known.withColumn("place", F.row_number().over(order)).withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy("graph")) > max_links)
    return placed.where(F.col("place") <= max_links).select("graph", "source", "predicate", "target", "declared", "restriction", "n", "truncated")


def schema_data_props(triples: DataFrame, restrictions: DataFrame | None = None, max_per_class: int = MAX_DATA_PROPS, types: DataFrame | None = None) -> DataFrame:
    """graph, class, predicate, datatype (most frequent; ties: smaller), n, truncated."""
    restrictions = restriction_links(triples) if restrictions is None else restrictions
    classes = schema_class_ids(triples, restrictions, types)
    observed = observed_data_props(triples, types)
    best = observed.groupBy("graph", "class", "predicate").agg(F.min(F.struct((-F.col("n")).alias("m"), "datatype")).alias("b"), F.sum("n").alias("n")).select("graph", "class", "predicate", F.col("b.datatype").alias("datatype"), "n")
    known = best.join(classes.withColumnRenamed("iri", "class"), ["graph", "class"], "left_semi")
    every = known.unionByName(declared_data_props(triples, classes, observed).withColumn("n", F.lit(0).cast("long")))
    by_class = Window.partitionBy("graph", "class")
    placed = every.withColumn("place", F.row_number().over(by_class.orderBy(F.desc("n"), "predicate"))).withColumn("truncated", F.count(F.lit(1)).over(by_class) > max_per_class)
    return placed.where(F.col("place") <= max_per_class).drop("place")


def super_classes(triples: DataFrame, restrictions: DataFrame | None = None) -> DataFrame:
    """graph, child, parents: sorted known named parents, joined by a space."""
    restrictions = restriction_links(triples) if restrictions is None else restrictions
    ids = schema_class_ids(triples, restrictions)
    pairs = subclass_parents(triples).join(ids.withColumnRenamed("iri", "child"), ["graph", "child"], "left_semi").join(ids.withColumnRenamed("iri", "parent"), ["graph", "parent"], "left_semi")
    return pairs.groupBy("graph", "child").agg(F.array_join(F.sort_array(F.collect_set("parent")), " ").alias("parents"))


#: Classes whose parents are looked up for one class.
EXPANDED = 200


def class_lineage(triples: DataFrame, restrictions: DataFrame | None = None, types: DataFrame | None = None, expanded: int = EXPANDED, declared: DataFrame | None = None, of: tuple[str, ...] = ()) -> DataFrame:
    """graph, id, ancestor, depth: every class, or each one of ``of``, with itself and all above it, however deep.

    The nearest ``expanded`` of them, the class itself included, by depth, then name, are gone on from; so an ancestor that
    only further ones lead to is left out.
    """
    declarations = _declared(triples, declared)
    up = subclass_parents(declarations).where(F.col("parent") != THING).select("graph", F.col("child").alias("a"), F.col("parent").alias("b"))
    restrictions = restriction_links(triples, types, declarations) if restrictions is None else restrictions
    ids = schema_class_ids(declarations, restrictions, typings(triples) if types is None else types).select("graph", F.col("iri").alias("start"))
    ids = written(ids.where(F.col("start").isin(*of)) if of else ids, "class-ids")  # read again by every part of the closure
    found = path_closure(up, ids, reflexive=True)
    near = found.withColumn("place", F.row_number().over(Window.partitionBy("graph", "start").orderBy("depth", "node"))).where(F.col("place") <= expanded)
    led = near.select("graph", "start", F.col("node").alias("a")).join(up, ["graph", "a"]).select("graph", "start", F.col("b").alias("node")).distinct()
    kept = found.where("depth = 0").unionByName(found.where("depth > 0").join(led, ["graph", "start", "node"], "left_semi"))
    return kept.select("graph", F.col("start").alias("id"), F.col("node").alias("ancestor"), F.col("depth").cast("long").alias("depth"))


def inherited_links(links: DataFrame, lineage: DataFrame, source: str, target: str) -> DataFrame:
    """graph, predicate, inverse, direct, declared, restriction, n: predicates that join two classes either way.

    Links of ancestors count for both ends; per predicate and direction the best count is kept.
    """
    above = lambda c, name: lineage.where(F.col("id") == c).select("graph", F.col("ancestor").alias(name), (F.col("depth") == 0).alias(f"own_{name}"))
    one_way = lambda a, b, inverse: links.join(above(a, "source"), ["graph", "source"]).join(above(b, "target"), ["graph", "target"]).withColumn("inverse", F.lit(inverse))
    both = one_way(source, target, False).unionByName(one_way(target, source, True))
    return both.groupBy("graph", "predicate", "inverse").agg(F.bool_or(F.col("own_source") & F.col("own_target")).alias("direct"), F.bool_or("declared").alias("declared"), F.bool_and("restriction").alias("restriction"), F.max("n").alias("n"))


def rank_link_options(options: DataFrame, labels: DataFrame) -> DataFrame:
    """With label and place: direct, observed, declared, non-restriction first, then count, then label."""
    out = label_or_name(options, labels, "predicate")
    order = Window.partitionBy("graph").orderBy(F.desc("direct"), F.desc(F.col("n") > 0), F.desc("declared"), "restriction", F.desc("n"), F.lower("label"), "predicate", "inverse")
    return out.withColumn("place", F.row_number().over(order).cast("long"))


def append_class(links: DataFrame, lineage: DataFrame, labels: DataFrame, path: list[str], classes: DataFrame) -> DataFrame:
    """graph, class, anchor, predicate, inverse: where each class (graph, class) joins a query of the steps ``path``.

    It hangs on the newest step that any predicate relates it to, either way and through ancestors of both, by the
    first-ranked predicate; a class related to no step has no row.
    """
    steps = links.sparkSession.createDataFrame(list(enumerate(path)), "anchor long, id string")
    above = lineage.select("graph", "id", "ancestor", (F.col("depth") == 0).alias("own"))
    step = above.join(F.broadcast(steps), "id").select("graph", "anchor", F.col("ancestor").alias("near"), F.col("own").alias("own_near"))
    new = above.join(classes.select("graph", F.col("class").alias("id")), ["graph", "id"]).select("graph", F.col("id").alias("class"), F.col("ancestor").alias("far"), F.col("own").alias("own_far"))
    way = lambda a, b, inverse: links.select("graph", F.col(a).alias("near"), F.col(b).alias("far"), "predicate", "declared", "restriction", "n", F.lit(inverse).alias("inverse"))
    both = way("source", "target", False).unionByName(way("target", "source", True)).join(step, ["graph", "near"]).join(new, ["graph", "far"])
    key = ["graph", "class", "anchor", "predicate", "inverse"]
    options = both.groupBy(*key).agg(F.bool_or(F.col("own_near") & F.col("own_far")).alias("direct"), F.bool_or("declared").alias("declared"), F.bool_and("restriction").alias("restriction"), F.max("n").alias("n"))
    options = label_or_name(options, labels, "predicate")
    order = Window.partitionBy("graph", "class").orderBy(F.desc("anchor"), F.desc("direct"), F.desc(F.col("n") > 0), F.desc("declared"), "restriction", F.desc("n"), F.lower("label"), "predicate", "inverse")
    return options.withColumn("place", F.row_number().over(order)).where("place = 1").select(*key)


def query_schema(triples: DataFrame, prefixes: DataFrame, restrictions: DataFrame | None = None) -> dict[str, DataFrame]:
    """The whole schema: classes, links, data_props, super_classes, namespaces (with the empty prefix) and truncated by graph."""
    restrictions = restriction_links(triples) if restrictions is None else restrictions
    links, props = schema_links(triples, restrictions), schema_data_props(triples, restrictions)
    cut = links.select("graph", "truncated").unionByName(props.select("graph", "truncated"))
    return {
        "classes": schema_classes(triples, restrictions),
        "links": links.drop("truncated"),
        "data_props": props.drop("truncated"),
        "super_classes": super_classes(triples, restrictions),
        "namespaces": prefixes.select("graph", "prefix", "namespace").distinct(),
        "truncated": cut.groupBy("graph").agg(F.bool_or("truncated").alias("truncated")),
    }


def inherited_data_props(data_props: DataFrame, lineage: DataFrame) -> DataFrame:
    """graph, id, predicate, datatype, n, from_class: of every class and its ancestors, the nearest wins."""
    rows = lineage.join(data_props.withColumnRenamed("class", "ancestor"), ["graph", "ancestor"])
    best = rows.groupBy("graph", "id", "predicate").agg(F.min(F.struct("depth", "ancestor", "datatype", "n")).alias("b"))
    return best.select("graph", "id", "predicate", F.col("b.datatype").alias("datatype"), F.col("b.n").alias("n"), F.col("b.ancestor").alias("from_class"))


def describe_query_node(triples: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """graph, id, class, instances, place: a class stands for itself, else its known types, most instances first."""
    known = classes.select("graph", F.col("iri").alias("class"), "label", "instances")
    itself = ids.join(known.withColumn("id", F.col("class")), ["graph", "id"])
    typed = ids.join(itself.select("graph", "id"), ["graph", "id"], "left_anti").join(instance_types(triples).select("graph", F.col("s").alias("id"), F.col("type").alias("class")), ["graph", "id"]).join(known, ["graph", "class"])
    both = itself.select("graph", "id", "class", "label", "instances").unionByName(typed.select("graph", "id", "class", "label", "instances"))
    order = Window.partitionBy("graph", "id").orderBy(F.desc("instances"), F.lower("label"), "class")
    return both.select("graph", "id", "class", "instances", F.row_number().over(order).cast("long").alias("place"))


def rank_links(links: DataFrame, limit: int = 40) -> DataFrame:
    """Real or declared links with their place: declared first, then by count."""
    real = links.where("n > 0 or declared")
    order = Window.partitionBy("graph").orderBy(F.desc("declared"), F.desc("n"), "source", "predicate", "target")
    return real.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= limit)


def entry_points(classes: DataFrame, links: DataFrame, limit: int = 10) -> DataFrame:
    """Classes worth starting from: connected ones first, then by instances, then by label."""
    joined = links.select("graph", F.explode(F.array("source", "target")).alias("iri")).distinct().withColumn("connected", F.lit(True))
    out = classes.join(joined, ["graph", "iri"], "left").na.fill(False, ["connected"])
    order = Window.partitionBy("graph").orderBy(F.desc("connected"), F.desc("instances"), F.lower("label"), "iri")
    return out.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= limit)


def starter_queries(classes: DataFrame, links: DataFrame, limit: int = 5) -> DataFrame:
    """graph, id, aggregate, classes, predicate, place: suggested queries in order.

    The biggest class, its count, SKOS narrower concepts, concepts per scheme, then the top links outside SKOS.
    """
    skos = "http://www.w3.org/2004/02/skos/core#"
    peopled = classes.where("instances > 0")
    biggest = peopled.withColumn("r", F.row_number().over(Window.partitionBy("graph").orderBy(F.desc("instances"), F.lower("label"), "iri"))).where("r = 1")
    row = lambda df, order, name, aggregate, path, predicate: df.select("graph", F.lit(order).cast("long").alias("o"), name.alias("id"), F.lit(aggregate).alias("aggregate"), path.alias("classes"), predicate.alias("predicate"))
    none = F.lit("")
    concept = peopled.where(F.col("iri") == skos + "Concept")
    scheme = peopled.where(F.col("iri") == skos + "ConceptScheme").join(concept.select("graph"), "graph", "left_semi")
    top = rank_links(links)
    top = top.where(~F.col("source").startswith(skos) & ~F.col("target").startswith(skos))
    parts = [
        row(biggest, 1, F.concat(F.lit("all:"), "iri"), "none", F.col("iri"), none),
        row(biggest, 2, F.concat(F.lit("count:"), "iri"), "count", F.col("iri"), none),
        row(concept, 3, F.lit("skos:narrower"), "none", F.concat_ws(" ", "iri", "iri"), F.lit("^" + skos + "broader")),
        row(scheme, 4, F.lit("skos:perScheme"), "count", F.concat_ws(" ", "iri", F.lit(skos + "Concept")), F.lit("^" + skos + "inScheme")),
        top.select("graph", (F.col("place") + 4).alias("o"), F.concat(F.lit("link:"), F.concat_ws("|", "source", "predicate", "target")).alias("id"), F.lit("none").alias("aggregate"), F.concat_ws(" ", "source", "target").alias("classes"), "predicate"),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    place = F.row_number().over(Window.partitionBy("graph").orderBy("o", "id"))
    return every.withColumn("place", place.cast("long")).where(F.col("place") <= limit).drop("o")


def query_candidates(classes: DataFrame, links: DataFrame, lineage: DataFrame, on_path: list[str]) -> DataFrame:
    """graph, iri of classes that may extend a path: those that a link of a path class or its ancestors touches.

    Without a path every class may begin one.
    """
    if not on_path:
        return classes.select("graph", "iri")
    above = lineage.where(F.col("id").isin(*on_path)).select("graph", F.col("ancestor").alias("end")).distinct()
    far = links.select("graph", F.col("source").alias("end"), F.col("target").alias("iri")).unionByName(links.select("graph", F.col("target").alias("end"), F.col("source").alias("iri")))
    return far.join(above, ["graph", "end"], "left_semi").select("graph", "iri").distinct().join(classes.select("graph", "iri"), ["graph", "iri"], "left_semi")


def next_step_options(links: DataFrame, lineage: DataFrame, path: list[str]) -> DataFrame:
    """graph, anchor, predicate, class, inverse, n: continuations of every step of a path.

    Where a predicate leads both ways to a class, forward wins; per key the best count is kept; the newest anchor is first.
    """
    steps = links.sparkSession.createDataFrame(list(enumerate(path)), "anchor long, id string")
    above = lineage.join(F.broadcast(steps), "id").select("graph", "anchor", F.col("ancestor").alias("end"))
    out = above.join(links.withColumnRenamed("source", "end"), ["graph", "end"]).select("graph", "anchor", "predicate", F.col("target").alias("class"), F.lit(False).alias("inverse"), "n")
    back = above.join(links.withColumnRenamed("target", "end"), ["graph", "end"]).select("graph", "anchor", "predicate", F.col("source").alias("class"), F.lit(True).alias("inverse"), "n")
    best = out.unionByName(back).groupBy("graph", "anchor", "predicate", "class").agg(F.min("inverse").alias("inverse"), F.max_by("n", F.struct(~F.col("inverse"), "n")).alias("n"))
    order = Window.partitionBy("graph").orderBy(F.desc("anchor"), F.desc("n"), "predicate", "class")
    return best.withColumn("place", F.row_number().over(order).cast("long"))


def next_step_filter(options: DataFrame, labels: DataFrame, text: str) -> DataFrame:
    """Options whose class or predicate label holds the text."""
    needle = text.lower()
    both = label_or_name(label_or_name(options, labels, "class", "class_label"), labels, "predicate", "predicate_label")
    return both.where(F.lower("class_label").contains(needle) | F.lower("predicate_label").contains(needle))
