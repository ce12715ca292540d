"""The star tables of a data folder as RDF triples.

One list of mappings makes two SQL texts: the plain one, a SELECT for each mapping, for any engine that knows the tables by
name, and Spark's own, which reads a table once for all its mappings and unfolds each row into its triples.  Four graphs live side by side: ``trade`` (business entities), ``places`` (a SKOS scheme), ``model`` (fixed
declarations: classes, properties, restrictions; ``trade`` holds them too) and ``catalog`` (declarations that follow from
the tables: a class for each brand, type and kind of part, restrictions, unions as lists, properties, imports).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.vocab import DCTERMS, OWL, PREFIXES, RDF, RDFS, SKOS, TYPE, XSD

V = "http://kg/v#"
GRAPHS = ("trade", "places", "model", "catalog")
COLUMNS = ("graph", "s", "s_kind", "p", "o", "o_kind", "o_datatype", "o_lang")

_CLASSES = ("Party", "Customer", "Supplier", "Place", "Region", "Nation", "Order", "Part", "Event", "User", "LoopA", "LoopB", "Account", "Big")
_SUBCLASSES = (("Customer", "Party"), ("Supplier", "Party"), ("Region", "Place"), ("Nation", "Place"), ("LoopA", "LoopB"), ("LoopB", "LoopA"), ("Big", "Order"), ("Big", "Account"))
_OBJECT = (("inNation", "Party", "Nation"), ("inRegion", "Nation", "Region"), ("placedBy", "Order", "Customer"), ("contains", "Order", "Part"), ("byUser", "Event", "User"))
_DATA = (("acctbal", "Party", "decimal"), ("totalPrice", "Order", "decimal"), ("orderDate", "Order", "date"), ("segment", "Customer", "string"), ("size", "Part", "integer"), ("unused", "Account", "boolean"))


def _model() -> list[tuple]:
    """Declarations as (graph, s, s_kind, p, o, o_kind, o_datatype, o_lang)."""
    rows: list[tuple] = []
    iri = lambda s, p, o, g="model": rows.append((g, s, "bnode" if s.startswith("_:") else "iri", p, o, "bnode" if o.startswith("_:") else "iri", None, None))
    text = lambda s, p, o, lang=None, dt=None, g="model": rows.append((g, s, "iri", p, o, "literal", dt, lang))
    for c in _CLASSES:
        iri(V + c, TYPE, OWL + "Class")
    for a, b in _SUBCLASSES:
        iri(V + a, RDFS + "subClassOf", V + b)
    for name, domain, reach in _OBJECT:
        iri(V + name, TYPE, OWL + "ObjectProperty")
        iri(V + name, RDFS + "domain", V + domain)
        iri(V + name, RDFS + "range", V + reach)
    for name, domain, datatype in _DATA:
        iri(V + name, TYPE, OWL + "DatatypeProperty")
        iri(V + name, RDFS + "domain", V + domain)
        iri(V + name, RDFS + "range", XSD + datatype)
    iri(V + "inNation", TYPE, OWL + "FunctionalProperty")
    iri(V + "basedIn", RDFS + "subPropertyOf", V + "inNation")
    iri(V + "Party", RDFS + "subClassOf", OWL + "Thing")
    iri("http://kg/model", TYPE, OWL + "Ontology")
    iri("http://kg/model", OWL + "imports", "http://kg/elsewhere")
    iri("http://kg/model", OWL + "imports", V + "Party")
    text("http://kg/model", DCTERMS + "title", "Trade model", "en")
    text("http://kg/model", OWL + "versionInfo", "1.0")
    text("http://kg/model", DCTERMS + "description", "Modèle", "fr")
    iri("http://kg/model", DCTERMS + "creator", V + "Party")
    # Big is an Order placed by some Customer and containing only Parts or Big orders.
    iri(V + "Big", RDFS + "subClassOf", "_:r1")
    iri("_:r1", TYPE, OWL + "Restriction")
    iri("_:r1", OWL + "onProperty", V + "placedBy")
    iri("_:r1", OWL + "someValuesFrom", V + "Customer")
    iri(V + "Account", OWL + "equivalentClass", "_:x1")
    iri("_:x1", OWL + "intersectionOf", "_:l1")
    iri("_:l1", RDF + "first", V + "Party")
    iri("_:l1", RDF + "rest", "_:l2")
    iri("_:l2", RDF + "first", "_:r2")
    iri("_:l2", RDF + "rest", RDF + "nil")
    iri("_:r2", OWL + "onProperty", V + "inNation")
    iri("_:r2", OWL + "allValuesFrom", "_:u1")
    iri("_:u1", OWL + "unionOf", "_:m1")
    iri("_:m1", RDF + "first", V + "Nation")
    iri("_:m1", RDF + "rest", "_:m2")
    iri("_:m2", RDF + "first", V + "Region")
    iri("_:m2", RDF + "rest", RDF + "nil")
    for name, en, fr in (("Customer", "customer", "client"), ("Order", "order", "commande"), ("Place", None, "lieu")):
        if en:
            text(V + name, RDFS + "label", en, "en")
        text(V + name, RDFS + "label", fr, "fr")
    text(V + "Part", SKOS + "prefLabel", "pièce", "fr")
    text(V + "Part", RDFS + "label", "part", "en")
    text(V + "Order", RDFS + "comment", "What a customer asks for.")
    iri("http://kg/places", TYPE, SKOS + "ConceptScheme", "places")
    text("http://kg/places", SKOS + "prefLabel", "Places", "en", g="places")
    return rows + [("trade", *r[1:]) for r in rows if r[0] == "model"]  # the data's graph carries its model too


def _values(rows: list[tuple]) -> str:
    quote = lambda x: "CAST(NULL AS VARCHAR(9))" if x is None else "'" + x.replace("'", "''") + "'"
    return ",\n".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


class Mapping(NamedTuple):
    """Triples of one predicate: eight SQL expressions over what is ``given``.

    ``keys``: columns of distinct triples, of which different values make different triples.
    """

    values: tuple[str, ...]
    given: str
    where: str
    distinct: bool
    keys: str = ""

    def plain(self) -> str:
        return f"SELECT {'DISTINCT ' * self.distinct}{', '.join(self.values)} FROM {self.given}{' WHERE ' + self.where if self.where else ''}"

    def once(self) -> str:
        """``plain`` with the rows made distinct by their ``keys``, a few numbers, before terms are made of them."""
        if not self.keys:
            return self.plain()
        return f"SELECT {', '.join(self.values)} FROM (SELECT DISTINCT {self.keys} FROM {self.given}) AS given{' WHERE ' + self.where if self.where else ''}"

    def unfolded(self) -> str:
        """The triple as a value; null where ``where`` does not hold."""
        triple = "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in zip(COLUMNS, self.values, strict=True)) + ")"
        return f"CASE WHEN {self.where} THEN {triple} END" if self.where else triple


def _row(graph: str, s: str, p: str, o: str, *, table: str = "", source: str = "", literal: str | None = None, lang: str | None = None, where: str = "", distinct: bool = False, keys: str = "", s_kind: str = "iri", o_kind: str = "iri") -> Mapping:
    """Triples of one predicate from a table, or from a subquery (``source``) over tables."""
    kind = (f"'{o_kind}'", "CAST(NULL AS VARCHAR(90))") if literal is None else ("'literal'", repr(literal) if literal else "CAST(NULL AS VARCHAR(90))")
    given = f"({source}) AS given" if source else f"{{{table}}}"
    return Mapping((f"'{graph}'", s, f"'{s_kind}'", f"'{p}'", o, *kind, "CAST(NULL AS VARCHAR(9))" if lang is None else repr(lang)), given, where, distinct, keys)


def _key(kind: str, column: str) -> str:
    return f"concat('http://kg/{kind}/', {column})"


def _parts() -> list[Mapping]:
    money = lambda c: f"concat('', CAST({c} AS DECIMAL(18, 2)))"
    out = []
    for table, kind, key, cls in (("region", "region", "r_regionkey", "Region"), ("nation", "nation", "n_nationkey", "Nation"), ("customer", "customer", "c_custkey", "Customer"), ("supplier", "supplier", "s_suppkey", "Supplier"), ("part", "part", "p_partkey", "Part"), ("orders", "order", "o_orderkey", "Order"), ("events", "event", "event_id", "Event")):
        out.append(_row("trade", _key(kind, key), TYPE, f"'{V}{cls}'", table=table))
    region, nation, customer, supplier, part, order, event = (_key(*k) for k in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("order", "o_orderkey"), ("event", "event_id")))
    user = _key("user", "user_id")
    out += [
        _row("trade", user, TYPE, f"'{V}User'", table="events", where="user_id IS NOT NULL", distinct=True),
        _row("trade", nation, V + "inRegion", _key("region", "n_regionkey"), table="nation"),
        _row("trade", customer, V + "inNation", _key("nation", "c_nationkey"), table="customer"),
        _row("trade", supplier, V + "inNation", _key("nation", "s_nationkey"), table="supplier"),
        _row("trade", order, V + "placedBy", _key("customer", "o_custkey"), table="orders"),
        _row("trade", _key("order", "l_orderkey"), V + "contains", _key("part", "l_partkey"), table="lineitem", distinct=True, keys="l_orderkey, l_partkey"),
        _row("trade", event, V + "byUser", user, table="events", where="user_id IS NOT NULL"),
        _row("trade", customer, V + "acctbal", money("c_acctbal"), table="customer", literal=XSD + "decimal"),
        _row("trade", supplier, V + "acctbal", money("s_acctbal"), table="supplier", literal=XSD + "decimal"),
        _row("trade", order, V + "totalPrice", money("o_totalprice"), table="orders", literal=XSD + "decimal"),
        _row("trade", order, V + "orderDate", "concat('', CAST(o_orderdate AS DATE))", table="orders", literal=XSD + "date"),
        _row("trade", customer, V + "segment", "c_mktsegment", table="customer", literal=""),
        _row("trade", part, V + "size", "concat('', p_size)", table="part", literal=XSD + "integer"),
        _row("trade", customer, RDFS + "label", "c_name", table="customer", literal=""),
        _row("trade", part, RDFS + "label", "p_name", table="part", literal="", lang="en"),
        _row("trade", nation, RDFS + "label", "n_name", table="nation", literal=""),
        _row("trade", region, RDFS + "label", "r_name", table="region", literal="", lang="en"),
        _row("places", region, TYPE, f"'{SKOS}Concept'", table="region"),
        _row("places", nation, TYPE, f"'{SKOS}Concept'", table="nation"),
        _row("places", region, SKOS + "prefLabel", "r_name", table="region", literal="", lang="en"),
        _row("places", region, SKOS + "prefLabel", "concat('Région ', r_name)", table="region", literal="", lang="fr"),
        _row("places", nation, SKOS + "prefLabel", "concat('Pays ', n_name)", table="nation", literal="", lang="fr"),
        _row("places", "'http://kg/places'", SKOS + "hasTopConcept", region, table="region"),
        _row("places", nation, SKOS + "broader", _key("region", "n_regionkey"), table="nation", where="n_nationkey <> 3"),
        _row("places", _key("region", "n_regionkey"), SKOS + "narrower", nation, table="nation", where="n_nationkey < 6"),
        _row("places", nation, SKOS + "inScheme", "'http://kg/places'", table="nation"),
    ]
    return out


def _catalog() -> list[Mapping]:
    """Declarations of the parts, event types, segments and nations that the tables hold."""
    plain = "replace(p_brand, '#', '')"
    kinds = f"SELECT DISTINCT {plain} AS brand, p_type AS type FROM {{part}}"
    cells = f"SELECT brand, type, lead(brand) OVER (PARTITION BY type ORDER BY brand) AS onward, row_number() OVER (PARTITION BY type ORDER BY brand) AS place FROM ({kinds}) AS k"
    kind, brand, type_ = "concat('http://kg/kind/', type, '-', brand)", _key("brand", "brand"), _key("type", "type")
    rule, union, cell, rest = "concat('_:r', type, brand)", "concat('_:u', type)", "concat('_:l', type, brand)", "concat('_:l', type, onward)"
    row = lambda s, p, o, source, **more: _row("catalog", s, p, o, source=source, **more)
    one = lambda s, p, o, table, **more: _row("catalog", s, p, o, table=table, distinct=True, **more)
    step, amount = _key("step", "event_type"), _key("amount", "c_mktsegment")
    return [
        row(kind, TYPE, f"'{OWL}Class'", kinds),
        row(kind, RDFS + "subClassOf", brand, kinds),
        row(kind, RDFS + "subClassOf", type_, kinds),
        row(brand, RDFS + "subClassOf", f"'{V}Part'", kinds, distinct=True),
        row(type_, RDFS + "subClassOf", f"'{V}Part'", kinds, distinct=True),
        one(_key("part", "p_partkey"), TYPE, f"concat('http://kg/kind/', p_type, '-', {plain})", "part"),
        row(kind, RDFS + "subClassOf", rule, kinds, o_kind="bnode"),
        row(rule, TYPE, f"'{OWL}Restriction'", kinds, s_kind="bnode"),
        row(rule, OWL + "onProperty", f"'{V}contains'", kinds, s_kind="bnode"),
        row(rule, OWL + "someValuesFrom", type_, kinds, s_kind="bnode"),
        # A type is the union of its brands, as a list.
        row(type_, OWL + "equivalentClass", union, kinds, distinct=True, o_kind="bnode"),
        row(union, OWL + "unionOf", cell, cells, where="place = 1", s_kind="bnode", o_kind="bnode"),
        row(cell, RDF + "first", brand, cells, s_kind="bnode"),
        row(cell, RDF + "rest", rest, cells, where="onward IS NOT NULL", s_kind="bnode", o_kind="bnode"),
        row(cell, RDF + "rest", f"'{RDF}nil'", cells, where="onward IS NULL", s_kind="bnode"),
        one(step, TYPE, f"'{OWL}ObjectProperty'", "events"),
        one(step, RDFS + "domain", f"'{V}User'", "events"),
        one(step, RDFS + "range", f"'{V}Event'", "events"),
        one(amount, TYPE, f"'{OWL}DatatypeProperty'", "customer"),
        one(amount, RDFS + "domain", f"'{V}Customer'", "customer"),
        one(amount, RDFS + "range", f"'{XSD}decimal'", "customer"),
        one("'http://kg/catalog'", OWL + "imports", _key("nation", "s_nationkey"), "supplier"),
        one(_key("nation", "n_nationkey"), RDFS + "label", "n_name", "nation", literal="", where="n_nationkey < 12"),
        row("'http://kg/catalog'", TYPE, f"'{OWL}Ontology'", "SELECT count(*) AS n FROM {part}"),
        row("'http://kg/catalog'", DCTERMS + "title", "concat('Catalog of ', n, ' parts')", "SELECT count(*) AS n FROM {part}", literal=""),
        row("'http://kg/catalog'", OWL + "versionInfo", "concat('', n)", "SELECT max(p_size) AS n FROM {part}", literal=""),
    ]


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
MODEL = "SELECT * FROM (\nVALUES " + _values(_model()) + "\n) AS model(" + ", ".join(COLUMNS) + ")"


def kg_sql() -> str:
    """The mapping over tables known by name."""
    plain = "\nUNION ALL ".join([MODEL, *(m.plain() for m in (*_parts(), *_catalog()))])
    return plain.format(**{t: t for t in TABLES})


def _once_each() -> str:
    """The mapping, each table or subquery read once for all plain mappings over it and once for those that want distinct triples.

    Mappings over one source differ in graph, predicate or kind of subject, so none makes another's triple.
    """
    shared: dict[tuple[str, bool], list[Mapping]] = {}
    for m in (*_parts(), *_catalog()):
        shared.setdefault((m.given, m.distinct), []).append(m)
    read = [ms[0].once() if len(ms) == 1 else f"SELECT {'DISTINCT ' * distinct}inline(array({', '.join(m.unfolded() for m in ms)})) FROM {given}" for (given, distinct), ms in shared.items()]
    return "\nUNION ALL ".join([MODEL, *read])


def kg_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All triples of a data folder.  Rows with a null key, subject or object make no triple."""
    sql = _once_each().format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES})
    return spark.sql(sql).where("s is not null and o is not null")


def kg_prefixes(spark: SparkSession) -> DataFrame:
    """graph, prefix, namespace of every graph; the model's own namespace has the empty prefix there."""
    rows = [(g, p, n) for g in GRAPHS for p, n in PREFIXES.items()]
    rows += [("trade", "v", V), ("model", "", V), ("trade", "customer", "http://kg/customer/"), ("trade", "nation", "http://kg/nation/"), ("places", "region", "http://kg/region/"), ("catalog", "brand", "http://kg/brand/"), ("catalog", "type", "http://kg/type/"), ("catalog", "", V)]
    return spark.createDataFrame(rows, "graph string, prefix string, namespace string")


def prefixes_sql() -> str:
    rows = [(g, p, n) for g in GRAPHS for p, n in PREFIXES.items()]
    rows += [("trade", "v", V), ("model", "", V), ("trade", "customer", "http://kg/customer/"), ("trade", "nation", "http://kg/nation/"), ("places", "region", "http://kg/region/"), ("catalog", "brand", "http://kg/brand/"), ("catalog", "type", "http://kg/type/"), ("catalog", "", V)]
    return "SELECT * FROM (VALUES " + ", ".join(f"('{g}', '{p}', '{n}')" for g, p, n in rows) + ") AS x(graph, prefix, namespace)"


def canonical(triples: DataFrame) -> DataFrame:
    """The triples as a set."""
    return triples.dropDuplicates(list(COLUMNS)).select(*[F.col(c) for c in COLUMNS])
