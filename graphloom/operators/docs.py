"""Tables behind a published vocabulary documentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.terms import anchor, first_literal, label_or_name, local_name, pick_label, prefixed
from graphloom.functions.vocab import DC, DCTERMS, DESCRIPTIONS, OMITTED_PREDICATES, OMITTED_TYPES, OWL, RDFS, SKOS, TYPE
from graphloom.operators.entity_graph import exclude_abox, iri_links
from graphloom.operators.results import places_within

SECTIONS = ("class", "objectProperty", "datatypeProperty", "annotationProperty", "property", "conceptScheme", "concept", "collection", "individual")
SKOS_SECTIONS = ("conceptScheme", "concept", "collection")
MAX_TERMS, MAX_NODES, MAX_GRAPH_BYTES, MAX_SOURCE_BYTES = 10_000, 5_000, 5_000_000, 10_000_000

_PROPERTY = (("Domain", RDFS + "domain", False), ("Range", RDFS + "range", False), ("Sub-property of", RDFS + "subPropertyOf", False), ("Inverse of", OWL + "inverseOf", False))
#: Facts of each kind: name, predicate, whether the term is the object (fixed values).
FACTS = {
    "class": (("Sub-class of", RDFS + "subClassOf", False), ("Super-class of", RDFS + "subClassOf", True), ("Equivalent to", OWL + "equivalentClass", False)),
    "objectProperty": _PROPERTY,
    "datatypeProperty": _PROPERTY,
    "annotationProperty": _PROPERTY,
    "property": _PROPERTY,
    "concept": (("Broader", SKOS + "broader", False), ("Narrower", SKOS + "narrower", False), ("Narrower", SKOS + "broader", True), ("Related", SKOS + "related", False), ("In scheme", SKOS + "inScheme", False)),
    "conceptScheme": (("Top concepts", SKOS + "hasTopConcept", False),),
    "individual": (("Type", TYPE, False),),
    "collection": (),
}


def doc_profile(triples: DataFrame) -> DataFrame:
    """graph, profile: vocpub (concepts in a scheme), ontpub, or mixed."""
    has = lambda *types: F.bool_or((F.col("p") == TYPE) & F.col("o").isin(*types))
    seen = triples.groupBy("graph").agg(has(SKOS + "ConceptScheme").alias("scheme"), has(SKOS + "Concept").alias("concept"), has(OWL + "Class", RDFS + "Class", OWL + "ObjectProperty", OWL + "DatatypeProperty").alias("owl"))
    skos = F.col("scheme") & F.col("concept")
    return seen.select("graph", F.when(skos & F.col("owl"), "mixed").when(skos, "vocpub").otherwise("ontpub").alias("profile"))


def omitted_constructs(triples: DataFrame) -> DataFrame:
    """graph, omitted: whether constructs occur that a documentation leaves out."""
    present = ((F.col("p") == TYPE) & F.col("o").isin(*OMITTED_TYPES)) | F.col("p").isin(*OMITTED_PREDICATES)
    return triples.groupBy("graph").agg(F.bool_or(present).alias("omitted"))


def unresolved_imports(triples: DataFrame) -> DataFrame:
    """graph, iri of imports that no statement of the graph describes."""
    imports = iri_links(triples).where(F.col("p") == OWL + "imports").select("graph", F.col("o").alias("iri")).distinct()
    return imports.join(triples.select("graph", F.col("s").alias("iri")), ["graph", "iri"], "left_anti")


def documentable_terms(triples: DataFrame, nodes: DataFrame, individuals: bool = False) -> DataFrame:
    """Nodes of documented kinds that the graph itself describes."""
    kinds = SECTIONS if individuals else SECTIONS[:-1]
    described = triples.where("s_kind = 'iri'").select("graph", F.col("s").alias("id"))
    return nodes.where(F.col("kind").isin(*kinds)).join(described, ["graph", "id"], "left_semi")


def term_index(triples: DataFrame, nodes: DataFrame, individuals: bool = False) -> DataFrame:
    """graph, kind, id, label, section, place: terms by section, label and id; SKOS first in a vocabulary.

    Places are dealt by ranges, so all individuals of a graph are many tasks.
    """
    terms = documentable_terms(triples, nodes, individuals).join(doc_profile(triples), "graph")
    rank = F.create_map(*[F.lit(x) for pair in {k: i for i, k in enumerate(SECTIONS)}.items() for x in pair])[F.col("kind")]
    first = F.col("kind").isin(*SKOS_SECTIONS) & (F.col("profile") == "vocpub")
    section = F.when(first, rank - 100).otherwise(rank).cast("long")
    return places_within(terms.select("graph", "kind", "id", "label", section.alias("section")), ["graph", "kind"], F.lower("label"), "id")


def doc_header(triples: DataFrame) -> DataFrame:
    """graph, iri, title, description, version, creator, created, modified of the ontology (smallest IRI), or scheme if vocpub."""
    typed = iri_links(triples).where(F.col("p") == TYPE).join(doc_profile(triples), "graph")
    rank = F.when(F.col("o") == OWL + "Ontology", 0).when((F.col("o") == SKOS + "ConceptScheme") & (F.col("profile") == "vocpub"), 1)
    subject = typed.withColumn("r", rank).where("r is not null").groupBy("graph").agg(F.min(F.struct("r", "s")).alias("b")).select("graph", F.col("b.s").alias("s"))
    about = triples.join(subject, ["graph", "s"], "left_semi")
    out = label_or_name(subject, pick_label(about), "s", "title")
    for name, predicates in (("description", DESCRIPTIONS), ("version", (OWL + "versionInfo",)), ("creator", (DCTERMS + "creator", DC + "creator")), ("created", (DCTERMS + "created", DC + "date")), ("modified", (DCTERMS + "modified",))):
        text = first_literal(about, predicates).withColumnRenamed("text", name)
        named = about.where(F.col("p").isin(*predicates) & (F.col("o_kind") == "iri")).groupBy("graph", "s").agg(F.min("o").alias("_iri"))
        out = out.join(text, ["graph", "s"], "left").join(named, ["graph", "s"], "left").withColumn(name, F.coalesce(name, local_name(F.col("_iri")))).drop("_iri")
    return out.withColumnRenamed("s", "iri")


def term_facts(triples: DataFrame, terms: DataFrame) -> DataFrame:
    """graph, id, fact, value: the facts that the kind of each term shows."""
    rows = [(kind, fact, p, inverse) for kind, facts in FACTS.items() for fact, p, inverse in (*facts, ("See also", RDFS + "seeAlso", False))]
    wanted = F.broadcast(terms.sparkSession.createDataFrame(rows, "kind string, fact string, p string, inverse boolean"))  # a fixed table
    asked = terms.select("graph", "id", "kind").join(wanted, "kind")
    own = asked.where("not inverse").join(triples.where("o_kind <> 'literal'").select("graph", F.col("s").alias("id"), "p", F.col("o").alias("value")), ["graph", "id", "p"])
    back = asked.where("inverse").join(triples.where("s_kind = 'iri' and o_kind <> 'literal'").select("graph", F.col("o").alias("id"), "p", F.col("s").alias("value")), ["graph", "id", "p"])
    return own.unionByName(back).where(~((F.col("fact") == "Type") & (F.col("value") == OWL + "NamedIndividual"))).select("graph", "id", "fact", "value").distinct()


def doc_graph(triples: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The embedded graph: no individuals or facts, degrees anew, anchors of documented terms (else empty)."""
    kept, inside = exclude_abox(nodes, edges)
    terms = documentable_terms(triples, nodes).select("graph", "id", F.lit(True).alias("documented"))
    kept = kept.join(terms, ["graph", "id"], "left")
    return kept.select("graph", "id", "kind", "degree", F.when(F.col("documented"), anchor(F.col("id"))).otherwise("").alias("anchor")), inside


def doc_limits(triples: DataFrame, nodes: DataFrame, edges: DataFrame, *, sources: DataFrame | None = None, max_terms: int = MAX_TERMS, max_nodes: int = MAX_NODES, max_graph_bytes: int = MAX_GRAPH_BYTES, max_source_bytes: int = MAX_SOURCE_BYTES) -> DataFrame:
    """graph, what, amount, most: limits that a documentation would break; nothing is ever cut to fit.

    The embedded graph counts the bytes of its nodes and edges as JSON, with a separator each; ``sources`` (graph, octets) gives
    the bytes of each graph's source text.
    """
    kept, inside = doc_graph(triples, nodes, edges)
    kept = kept.join(nodes.select("graph", "id", "label"), ["graph", "id"])
    count = lambda frame, what, most: frame.groupBy("graph").agg(F.count(F.lit(1)).alias("amount")).select("graph", F.lit(what).alias("what"), "amount", F.lit(most).cast("long").alias("most"))
    total = lambda frame, what, most: frame.groupBy("graph").agg(F.sum("octets").alias("amount")).select("graph", F.lit(what).alias("what"), "amount", F.lit(most).cast("long").alias("most"))
    size = lambda *columns: (F.octet_length(F.to_json(F.struct(*columns))) + 1).cast("long").alias("octets")
    drawn = kept.select("graph", size("id", "label", "kind", "degree", "anchor")).unionByName(inside.select("graph", size("source", "target", "kind", "label")))
    every = count(documentable_terms(triples, nodes), "terms", max_terms).unionByName(count(kept, "nodes", max_nodes)).unionByName(total(drawn, "graph bytes", max_graph_bytes))
    if sources is not None:
        every = every.unionByName(total(sources.select("graph", F.col("octets").cast("long").alias("octets")), "source bytes", max_source_bytes))
    return every.where("amount > most")


def abox_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph, individuals, assertions."""
    people = nodes.groupBy("graph").agg(F.count_if(F.col("kind") == "individual").alias("individuals"))
    facts = edges.groupBy("graph").agg(F.count_if(F.col("kind") == "assertion").alias("assertions"))
    return people.join(facts, "graph", "full").na.fill(0)


def bnode_inline(triples: DataFrame, prefixes: DataFrame) -> DataFrame:
    """graph, s, text: a blank node as ``[p v; p v]``, parts sorted, nested blank nodes as an ellipsis."""
    rows = prefixed(triples.where("s_kind = 'bnode'"), prefixes, "p", "pp")
    rows = prefixed(rows, prefixes, "o", "oo")
    value = F.when(F.col("o_kind") == "bnode", "…").when(F.col("o_kind") == "iri", F.col("oo")).otherwise(F.col("o"))
    parts = F.sort_array(F.collect_set(F.concat_ws(" ", "pp", value)))
    return rows.groupBy("graph", "s").agg(F.concat(F.lit("["), F.array_join(parts, "; "), F.lit("]")).alias("text"))
