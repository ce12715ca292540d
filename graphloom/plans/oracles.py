"""Plain SQL definitions of the graph tables, for checking the operators on another engine."""

from __future__ import annotations

from graphloom.functions import vocab as v
from graphloom.sources.kg import kg_sql, prefixes_sql

S, R, O, X, T = v.SKOS, v.RDFS, v.OWL, v.XSD, v.TYPE


def values(rows: list[tuple], *names: str) -> str:
    text = lambda x: str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + f") AS z({', '.join(names)})"


def within(column: str, names) -> str:
    return f"{column} IN (" + ", ".join(f"'{n}'" for n in names) + ")"


def local(c: str) -> str:
    cut = f"regexp_replace({c}, '[#/]+$', '')"
    tail = lambda sep: f"regexp_extract({cut}, '[^{sep}]*$')"
    return "CASE " + " ".join(f"WHEN contains({c}, '{s}') AND {tail(s)} <> '' THEN {tail(s)}" for s in "#/:") + f" ELSE {c} END"


def prefix(c: str, graph: str) -> str:
    """The prefixed form of an IRI column, as a scalar subquery."""
    ns = f"regexp_extract({c}, '^(.*[#/])([^#/]*)$', 1)"
    found = f"(SELECT min(prefix) FROM prefixes px WHERE px.graph = {graph} AND px.namespace = {ns} AND {ns} <> '' AND {c} <> {ns})"
    return f"CASE WHEN {found} IS NULL THEN {c} WHEN {found} = '' THEN substr({c}, length({ns}) + 1) ELSE {found} || ':' || substr({c}, length({ns}) + 1) END"


def flat(row: str, position: str, name: str) -> str:
    """The columns of a variable bound to the subject or object of a row of ``t``: text, kind, datatype, language."""
    if position == "s":
        return f"{row}.s AS {name}, {row}.s_kind AS {name}_kind, '' AS {name}_datatype, '' AS {name}_lang"
    datatype = f"CASE WHEN {row}.o_kind = 'literal' THEN coalesce({row}.o_datatype, CASE WHEN {row}.o_lang IS NOT NULL THEN '{v.RDF}langString' ELSE '{X}string' END) ELSE '' END"
    return f"{row}.o AS {name}, {row}.o_kind AS {name}_kind, {datatype} AS {name}_datatype, lower(coalesce({row}.o_lang, '')) AS {name}_lang"


def closure(name: str, edges: str, seeds: str, *, reflexive: bool) -> list[tuple[str, str]]:
    """Distinct reachable pairs (graph, start, node)."""
    first = f"SELECT graph, start, start AS node FROM {seeds}" if reflexive else f"SELECT e.graph, e.a AS start, e.b AS node FROM {edges} e JOIN {seeds} s ON s.graph = e.graph AND s.start = e.a"
    return [(f"{name}(graph, start, node)", f"{first} UNION SELECT c.graph, c.start, e.b FROM {name} c JOIN {edges} e ON e.graph = c.graph AND e.a = c.node")]


BASE: list[tuple[str, str]] = [
    ("t(graph, s, s_kind, p, o, o_kind, o_datatype, o_lang)", f"SELECT * FROM ({kg_sql()}) AS mapped(graph, s, s_kind, p, o, o_kind, o_datatype, o_lang) WHERE s IS NOT NULL AND o IS NOT NULL"),
    ("prefixes", prefixes_sql()),
    ("il", "SELECT graph, s, p, o FROM t WHERE s_kind = 'iri' AND o_kind = 'iri'"),
    ("tk", values(list(v.TYPE_KINDS.items()), "o", "kind")),
    ("kr", values([(k, i) for i, k in enumerate(v.KINDS)], "kind", "r")),
    ("ek", values([(p, k, w) for p, (k, w) in v.EDGE_KINDS.items()], "p", "kind", "turned")),
    ("ik", values(list(v.IMPLIED_KINDS.items()), "p", "kind")),
    ("lp", values([(p, i) for i, p in enumerate(v.LABELS)], "p", "r")),
    ("labels", "SELECT graph, s, o AS label FROM (SELECT t.graph, t.s, t.o, row_number() OVER (PARTITION BY t.graph, t.s ORDER BY lp.r, CASE WHEN o_lang IS NULL OR o_lang = 'en' THEN 0 ELSE 1 END, o) n FROM t JOIN lp USING (p) WHERE o_kind = 'literal') WHERE n = 1"),
    ("sedge", f"SELECT DISTINCT graph, CASE WHEN turned THEN o ELSE s END AS source, CASE WHEN turned THEN s ELSE o END AS target, kind, '' AS label FROM il JOIN ek USING (p) WHERE NOT (p = '{R}range' AND starts_with(o, '{X}'))"),
    ("tkinds", f"SELECT graph, s AS id, kind FROM il JOIN tk USING (o) WHERE p = '{T}' UNION SELECT graph, s, kind FROM il JOIN ik USING (p) UNION SELECT graph, o, kind FROM il JOIN ik USING (p)"),
    ("iedge", f"SELECT DISTINCT il.graph, s AS source, o AS target, 'instanceOf' AS kind, '' AS label FROM il JOIN tkinds k ON k.graph = il.graph AND k.id = il.o AND k.kind = 'class' WHERE p = '{T}'"),
    ("oprops", f"SELECT DISTINCT graph, s AS p FROM il JOIN tk USING (o) WHERE p = '{T}' AND kind = 'objectProperty'"),
    ("aedge", f"SELECT DISTINCT graph, s AS source, o AS target, 'assertion' AS kind, {local('p')} AS label FROM il WHERE (graph, p) IN (SELECT graph, p FROM oprops)"),
    ("edges", "SELECT * FROM sedge UNION ALL SELECT * FROM iedge UNION ALL SELECT * FROM aedge"),
    ("degs", "SELECT graph, id, count(*) AS degree FROM (SELECT graph, source AS id FROM edges UNION ALL SELECT graph, target FROM edges) GROUP BY ALL"),
    ("evid", "SELECT * FROM tkinds UNION SELECT graph, source, 'individual' FROM iedge i WHERE NOT EXISTS (SELECT 1 FROM tkinds k WHERE k.graph = i.graph AND k.id = i.source AND k.kind IN ('class', 'conceptScheme', 'concept')) UNION SELECT graph, source, 'other' FROM edges UNION SELECT graph, target, 'other' FROM edges"),
    ("ekinds", "SELECT graph, id, arg_min(kind, r) AS kind FROM evid JOIN kr USING (kind) GROUP BY graph, id"),
    ("nodes", f"SELECT k.graph, k.id, coalesce(l.label, {local('k.id')}) AS label, k.kind, coalesce(d.degree, 0) AS degree FROM ekinds k LEFT JOIN degs d ON d.graph = k.graph AND d.id = k.id LEFT JOIN labels l ON l.graph = k.graph AND l.s = k.id"),
    ("ranked", "SELECT *, row_number() OVER (PARTITION BY graph ORDER BY degree DESC, id) AS place FROM nodes"),
    ("subc", f"SELECT DISTINCT graph, s AS child, o AS parent FROM il WHERE p = '{v.SUBCLASS}' AND s <> o"),
    # forests
    ("cnode", f"SELECT DISTINCT graph, s AS id FROM il WHERE p = '{T}' AND {within('o', (O + 'Class', R + 'Class'))} AND (NOT {within('s', v.META_CLASSES)} OR s = '{v.THING}') UNION SELECT graph, child FROM subc WHERE NOT {within('child', v.META_CLASSES)} UNION SELECT graph, parent FROM subc WHERE NOT {within('parent', v.META_CLASSES)}"),
    ("cpar", f"SELECT graph, child, parent FROM subc WHERE parent <> '{v.THING}' AND (graph, child) IN (SELECT graph, id FROM cnode) AND (graph, parent) IN (SELECT graph, id FROM cnode)"),
    ("kraw", f"SELECT graph, s AS child, o AS parent, false AS top FROM il WHERE p = '{S}broader' AND s <> o UNION ALL SELECT graph, o, s, false FROM il WHERE p = '{S}narrower' AND s <> o UNION ALL SELECT graph, o, s, true FROM il WHERE p = '{S}hasTopConcept' AND s <> o UNION ALL SELECT graph, s, o, true FROM il WHERE p = '{S}topConceptOf' AND s <> o"),
    ("kscheme", f"SELECT graph, s AS id FROM il WHERE p = '{T}' AND o = '{S}ConceptScheme' UNION SELECT graph, parent FROM kraw WHERE top"),
    ("knode", f"SELECT graph, id, CASE WHEN (graph, id) IN (SELECT graph, id FROM kscheme) THEN 'conceptScheme' ELSE 'concept' END AS kind FROM (SELECT graph, s AS id FROM il WHERE p = '{T}' AND {within('o', (S + 'Concept', S + 'ConceptScheme'))} UNION SELECT graph, child FROM kraw UNION SELECT graph, parent FROM kraw)"),
    ("kpar", "SELECT DISTINCT graph, child, parent FROM kraw WHERE (graph, child) NOT IN (SELECT graph, id FROM kscheme)"),
    ("fnode", "SELECT graph, id, 'class' AS kind, 'class' AS forest FROM cnode UNION ALL SELECT graph, id, kind, 'concept' FROM knode"),
    ("fpar", "SELECT *, 'class' AS forest FROM cpar UNION ALL SELECT *, 'concept' FROM kpar"),
    # schema
    ("itype", f"SELECT DISTINCT graph, s, o AS type FROM il WHERE p = '{T}' AND NOT {within('o', v.META_CLASSES)}"),
    ("restcell", f"SELECT graph, s AS a, o AS b FROM t WHERE p = '{v.RDF}rest' AND o <> '{v.RDF}nil'"),
    ("sethead", f"SELECT graph, s AS a, o AS start FROM t WHERE {within('p', (O + 'intersectionOf', O + 'unionOf'))} AND o_kind <> 'literal'"),
    *closure("lcell", "restcell", "sethead", reflexive=True),
    ("litem", f"SELECT DISTINCT c.graph, c.start AS head, t.o AS member, t.o_kind AS member_kind FROM lcell c JOIN t ON t.graph = c.graph AND t.s = c.node AND t.p = '{v.RDF}first'"),
    ("smember", "SELECT DISTINCT h.graph, h.a, i.member AS b, i.member_kind AS b_kind FROM sethead h JOIN litem i ON i.graph = h.graph AND i.head = h.start"),
    ("bnest", "SELECT graph, a, b FROM smember WHERE b_kind = 'bnode'"),
    ("sexpr", "SELECT DISTINCT graph, a AS start FROM smember"),
    *closure("nexpr", "bnest", "sexpr", reflexive=True),
    ("ncls", "SELECT DISTINCT e.graph, e.start AS expression, m.b AS named FROM nexpr e JOIN smember m ON m.graph = e.graph AND m.a = e.node AND m.b_kind = 'iri'"),
    ("anest", "SELECT graph, a, b FROM smember WHERE b_kind <> 'literal'"),
    ("hung", f"SELECT DISTINCT graph, s AS source, o AS start FROM t WHERE {within('p', (v.SUBCLASS, O + 'equivalentClass'))} AND s_kind = 'iri' AND o_kind = 'bnode' AND NOT {within('s', v.META_CLASSES)}"),
    *closure("hexpr", "anest", "hung", reflexive=True),
    ("held", "SELECT DISTINCT h.graph, h.source, e.node AS s FROM hung h JOIN hexpr e ON e.graph = h.graph AND e.start = h.start"),
    ("onp", f"SELECT graph, s, min(o) AS predicate FROM t WHERE p = '{O}onProperty' AND o_kind = 'iri' GROUP BY ALL"),
    ("rtar", f"SELECT graph, s, o AS target FROM t WHERE {within('p', (O + 'someValuesFrom', O + 'allValuesFrom', O + 'onClass'))} AND o_kind = 'iri' UNION SELECT t.graph, t.s, n.named FROM t JOIN ncls n ON n.graph = t.graph AND n.expression = t.o WHERE {within('p', (O + 'someValuesFrom', O + 'allValuesFrom', O + 'onClass'))} AND o_kind = 'bnode' UNION SELECT t.graph, t.s, i.type FROM t JOIN itype i ON i.graph = t.graph AND i.s = t.o WHERE p = '{O}hasValue' AND o_kind = 'iri'"),
    ("rlink", f"SELECT DISTINCT h.graph, h.source, o.predicate, r.target FROM held h JOIN onp o ON o.graph = h.graph AND o.s = h.s JOIN rtar r ON r.graph = h.graph AND r.s = h.s WHERE NOT {within('r.target', v.META_CLASSES)} AND NOT starts_with(r.target, '{X}') AND r.target <> '{v.RDF}langString'"),
    ("scls", f"SELECT graph, type AS iri FROM itype UNION SELECT graph, iri FROM (SELECT graph, s AS iri FROM il WHERE p = '{T}' AND {within('o', (O + 'Class', R + 'Class'))} UNION SELECT graph, s FROM t WHERE p = '{v.SUBCLASS}' AND s_kind = 'iri' UNION SELECT graph, o FROM t WHERE p = '{v.SUBCLASS}' AND o_kind = 'iri' UNION SELECT graph, o FROM t WHERE p = '{R}domain' AND o_kind = 'iri' UNION SELECT graph, o FROM t WHERE p = '{R}range' AND o_kind = 'iri' AND NOT starts_with(o, '{X}') AND o <> '{v.RDF}langString') WHERE NOT {within('iri', v.META_CLASSES)} UNION SELECT graph, target FROM rlink"),
    ("cinst", "SELECT graph, type AS iri, count(*) AS instances FROM itype GROUP BY ALL"),
    ("ckind", values(list(v.CLASS_KINDS.items()), "iri", "kind")),
    ("sclass", f"SELECT c.graph, c.iri, coalesce(l.label, {local('c.iri')}) AS label, coalesce(i.instances, 0) AS instances, coalesce(k.kind, 'class') AS kind FROM scls c LEFT JOIN labels l ON l.graph = c.graph AND l.s = c.iri LEFT JOIN cinst i ON i.graph = c.graph AND i.iri = c.iri LEFT JOIN ckind k ON k.iri = c.iri"),
    ("drlink", f"SELECT DISTINCT d.graph, d.o AS source, d.s AS predicate, r.o AS target FROM il d JOIN il r ON r.graph = d.graph AND r.s = d.s AND r.p = '{R}range' WHERE d.p = '{R}domain' AND NOT starts_with(r.o, '{X}') AND r.o <> '{v.RDF}langString'"),
    # Uses are counted per object first; the aggregation keeps the two type joins apart.
    ("ouse", f"SELECT t.graph, a.type AS source, t.p, t.o, count(*) AS n FROM t JOIN itype a ON a.graph = t.graph AND a.s = t.s WHERE t.s_kind = 'iri' AND t.o_kind = 'iri' AND NOT {within('t.p', v.SCHEMA_PREDICATES)} GROUP BY ALL"),
    ("olink", "SELECT u.graph, u.source, u.p AS predicate, b.type AS target, CAST(sum(u.n) AS BIGINT) AS n FROM ouse u JOIN itype b ON b.graph = u.graph AND b.s = u.o GROUP BY ALL"),
    ("odata", f"SELECT t.graph, a.type AS class, t.p AS predicate, coalesce(o_datatype, CASE WHEN o_lang IS NOT NULL THEN '{v.RDF}langString' ELSE '{X}string' END) AS datatype, count(*) AS n FROM t JOIN itype a ON a.graph = t.graph AND a.s = t.s WHERE t.s_kind = 'iri' AND t.o_kind = 'literal' AND NOT {within('t.p', v.SCHEMA_PREDICATES)} GROUP BY ALL"),
    ("slink", "SELECT graph, source, predicate, target, bool_or(d) AS declared, bool_or(r) AS restriction, CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, false AS d, true AS r, 0 AS n FROM rlink UNION ALL SELECT *, true, false, 0 FROM drlink UNION ALL SELECT graph, source, predicate, target, false, false, n FROM olink) WHERE (graph, source) IN (SELECT graph, iri FROM scls) AND (graph, target) IN (SELECT graph, iri FROM scls) GROUP BY graph, source, predicate, target"),
    ("ddata", f"SELECT p.graph, d.o AS class, p.s AS predicate, coalesce(min(r.o), '{X}string') AS datatype FROM il p JOIN il d ON d.graph = p.graph AND d.s = p.s AND d.p = '{R}domain' LEFT JOIN il r ON r.graph = p.graph AND r.s = p.s AND r.p = '{R}range' WHERE p.p = '{T}' AND p.o = '{O}DatatypeProperty' AND (d.graph, d.o) IN (SELECT graph, iri FROM scls) AND (p.graph, d.o, p.s) NOT IN (SELECT graph, class, predicate FROM odata) GROUP BY ALL"),
    ("sdata", "SELECT graph, class, predicate, datatype, CAST(total AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY graph, class, predicate ORDER BY n DESC, datatype) k, sum(n) OVER (PARTITION BY graph, class, predicate) total FROM odata WHERE (graph, class) IN (SELECT graph, iri FROM scls)) WHERE k = 1 UNION ALL SELECT graph, class, predicate, datatype, 0 FROM ddata"),
    ("upe", f"SELECT graph, child AS a, parent AS b FROM subc WHERE parent <> '{v.THING}'"),
    ("lin0(graph, id, ancestor, depth)", "SELECT graph, iri, iri, 0 FROM scls UNION SELECT l.graph, l.id, e.b, l.depth + 1 FROM lin0 l JOIN upe e ON e.graph = l.graph AND e.a = l.ancestor WHERE l.depth < 20"),
    ("lin1", "SELECT *, row_number() OVER (PARTITION BY graph, id ORDER BY depth, ancestor) AS place FROM (SELECT graph, id, ancestor, min(depth) AS depth FROM lin0 GROUP BY ALL)"),
    ("linup", "SELECT DISTINCT l.graph, l.id, e.b AS ancestor FROM lin1 l JOIN upe e ON e.graph = l.graph AND e.a = l.ancestor WHERE l.place <= 200"),
    ("lineage", "SELECT l.graph, l.id, l.ancestor, l.depth FROM lin1 l LEFT JOIN linup u ON u.graph = l.graph AND u.id = l.id AND u.ancestor = l.ancestor WHERE l.depth = 0 OR u.id IS NOT NULL"),
    # docs
    ("profile", f"SELECT graph, CASE WHEN sch AND con AND owl THEN 'mixed' WHEN sch AND con THEN 'vocpub' ELSE 'ontpub' END AS profile FROM (SELECT graph, bool_or(p = '{T}' AND o = '{S}ConceptScheme') sch, bool_or(p = '{T}' AND o = '{S}Concept') con, bool_or(p = '{T}' AND {within('o', (O + 'Class', R + 'Class', O + 'ObjectProperty', O + 'DatatypeProperty'))}) owl FROM t GROUP BY graph)"),
]


def query(final: str, *more: tuple[str, str]) -> str:
    """``final`` over the definitions and any ``more`` of them."""
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({sql})" for name, sql in (*BASE, *more)) + "\n" + final
