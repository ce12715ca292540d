"""Small graphs with known answers."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.functions.typed import LANG_STRING, Term, bnode, iri, literal, order_keys
from graphloom.functions.vocab import OWL, RDFS, SKOS, THING, TYPE, XSD
from graphloom.operators import closure, docs, hierarchy, ranking, results, schema
from graphloom.operators import entity_graph as eg
from graphloom.operators.pattern import Filter, Frame, Link, Prop, QueryState, Step, filter_condition, number, run_pattern, var_names
from graphloom.sources import library, ntriples
from graphloom.streaming.throttle import activity_stream, throttle_events, throttle_stream

E = "http://example.org/#"
SCHEMA = "graph string, s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string"


def graph(spark, *rows):
    """(s, p, o) with IRIs in full or short after ':', '_:' blank nodes, and literals as tuples (text, datatype, lang)."""
    full = lambda x: E + x[1:] if x.startswith(":") else x
    kind = lambda x: "bnode" if x.startswith("_:") else "iri"
    out = []
    for s, p, o in rows:
        literal = isinstance(o, tuple)
        text, datatype, lang = (*o, None, None)[:3] if literal else (full(o), None, None)
        out.append(("g", full(s), kind(s), full(p), text, "literal" if literal else kind(full(o)), datatype, lang))
    return spark.createDataFrame(out, SCHEMA)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def short(xs):
    return [x.replace(E, "") for x in xs]


@pytest.fixture(scope="module")
def space(spark):
    return graph(
        spark,
        (":Body", TYPE, OWL + "Class"),
        (":Planet", RDFS + "subClassOf", ":Body"),
        (":Dwarf", RDFS + "subClassOf", ":Planet"),
        (":Star", TYPE, OWL + "Class"),
        (":orbits", TYPE, OWL + "ObjectProperty"),
        (":orbits", RDFS + "domain", ":Body"),
        (":orbits", RDFS + "range", ":Body"),
        (":mass", TYPE, OWL + "DatatypeProperty"),
        (":mass", RDFS + "range", XSD + "decimal"),
        (":Earth", TYPE, ":Planet"),
        (":Sun", TYPE, ":Star"),
        (":Moon", TYPE, ":Body"),
        (":Earth", ":orbits", ":Sun"),
        (":Moon", ":orbits", ":Earth"),
        (":Earth", ":mass", ("5.97", XSD + "decimal")),
        (":Moon", ":mass", ("heavy", XSD + "decimal")),
        (":Earth", RDFS + "label", ("Terre", None, "fr")),
        (":Earth", RDFS + "label", ("Earth", None, "en")),
        (":Sun", SKOS + "prefLabel", ("Soleil", None, "fr")),
        (":Sun", RDFS + "label", ("Sun",)),
    )


def test_entity_graph(space):
    nodes, edges = eg.entity_graph(space)
    kinds = {r["id"].replace(E, ""): (r["kind"], r["label"], r["degree"]) for r in nodes.collect()}
    assert kinds["Planet"][0] == "class" and kinds["orbits"][0] == "objectProperty" and kinds["mass"][0] == "datatypeProperty"
    assert kinds["Earth"] == ("individual", "Earth", 3)
    assert kinds["Sun"][1] == "Soleil"  # a foreign prefLabel goes before an English label
    found = {(r["source"].replace(E, ""), r["kind"], r["target"].replace(E, "")) for r in edges.collect()}
    assert ("Earth", "assertion", "Sun") in found and ("Planet", "subClassOf", "Body") in found
    assert not any(k == "range" and t.startswith(XSD) for _, k, t in found)


def test_self_loop_counts_twice(spark):
    nodes, _ = eg.entity_graph(graph(spark, (":a", SKOS + "related", ":a")))
    assert rows(nodes, "degree") == [(2,)]


def test_local_names(spark):
    cases = {"http://x/a#": "http://x/a", "http://x/a/b": "b", "urn:x:y": "y", "plain": "plain", "http://x/a/": "a"}
    df = spark.createDataFrame([(k,) for k in cases], "iri string")
    got = {r[0]: r[1] for r in df.select("iri", terms.local_name(F.col("iri"))).collect()}
    assert got == cases


def test_forests(spark):
    t = graph(spark, (":A", RDFS + "subClassOf", THING), (":A", TYPE, OWL + "Class"), (":B", RDFS + "subClassOf", ":C"), (":C", RDFS + "subClassOf", ":B"), (":D", RDFS + "subClassOf", ":D"), (":D", TYPE, OWL + "Class"))
    nodes, parents = hierarchy.class_forest(t)
    assert short(r[0] for r in rows(nodes, "id")) == ["A", "B", "C", "D"]
    roots = {r["id"].replace(E, ""): r["promoted"] for r in hierarchy.forest_roots(nodes, parents).collect()}
    assert roots == {"A": False, "D": False, "B": True}
    assert short(r[0] for r in rows(hierarchy.cycle_marks(parents), "id")) == ["B", "C"]


def test_concepts(spark):
    t = graph(spark, (":S", SKOS + "hasTopConcept", ":T"), (":T", SKOS + "narrower", ":U"), (":L", TYPE, SKOS + "Concept"), (":S", SKOS + "broader", ":T"))
    nodes, parents = hierarchy.concept_forest(t)
    assert [(c.replace(E, ""), p.replace(E, "")) for c, p in rows(parents, "child", "parent")] == [("T", "S"), ("U", "T")]
    assert dict(rows(nodes, "id", "kind"))[E + "S"] == "conceptScheme"


def test_closure_handles_cycles_and_depth(spark):
    ring = spark.createDataFrame([("g", f"n{i}", f"n{(i + 1) % 5}") for i in range(5)], "graph string, a string, b string")
    assert closure.path_closure(ring).count() == 25
    seeds = spark.createDataFrame([("g", "n0")], "graph string, start string")
    assert closure.path_closure(ring, seeds, max_depth=2).count() == 2


def test_restrictions(spark):
    t = graph(
        spark,
        (":Crewed", TYPE, OWL + "Class"),
        (":Crewed", RDFS + "subClassOf", "_:r"),
        ("_:r", OWL + "onProperty", ":carries"),
        ("_:r", OWL + "someValuesFrom", ":Astronaut"),
    )
    found = schema.schema_links(t)
    assert [(r.source.replace(E, ""), r.target.replace(E, ""), r.declared, r.restriction, r.n) for r in found.collect()] == [("Crewed", "Astronaut", False, True, 0)]


def test_schema(space):
    links = {(r.source.replace(E, ""), r.target.replace(E, "")): (r.declared, r.n) for r in schema.schema_links(space).collect()}
    assert links[("Planet", "Star")] == (False, 1) and links[("Body", "Body")] == (True, 0)
    props = {r["class"].replace(E, ""): r["n"] for r in schema.schema_data_props(space).collect() if r["predicate"].endswith("mass")}
    assert props == {"Planet": 1, "Body": 1}


def test_patterns(space):
    state = QueryState((Step(E + "Planet", "planet", (Prop(E + "mass", "mass", XSD + "decimal", filter=Filter(">", "1")),)), Step(None, "what", link=Link(0, ((E + "orbits", False),)))))
    assert rows(run_pattern(space, state), "planet", "planetMass", "what") == [(E + "Earth", "5.97", E + "Sun")]
    optional = QueryState((Step(E + "Star", "star"), Step(None, "what", link=Link(0, ((E + "orbits", False),), optional=True))))
    assert rows(run_pattern(space, optional), "star", "what") == [(E + "Sun", None)]
    plus = QueryState((Step(None, "from", pin=(E + "Moon",)), Step(None, "to", link=Link(0, ((E + "orbits", False),), modifier="+"))))
    assert short(r[0] for r in rows(run_pattern(space, plus), "to")) == ["Earth", "Sun"]
    count = QueryState((Step(E + "Planet", "planet"),), aggregate="count")
    assert rows(run_pattern(space, count), "count") == [(1,)]
    lost = QueryState((Step(E + "Planet", "planet"), Step(None, "x", link=Link(5, ((E + "orbits", False),)))))
    assert run_pattern(space, lost).columns == ["graph", "planet"]
    assert var_names(["Big planet", "big Planet", "3d"]) == ["bigPlanet", "bigPlanet2", "v3d"]


def test_algebra(space):
    a, b = Frame.match(space, "?x", E + "orbits", "?y"), Frame.match(space, "?y", TYPE, "?t")
    assert a.and_(b).data.count() == 2
    assert a.not_exists(Frame.match(space, "?y", E + "orbits", "?z").project("y")).data.count() == 1
    with pytest.raises(ValueError):
        a.optional(b).and_(Frame.match(space, "?t", TYPE, "?u"))
    assert a.and_(Frame.match(space, "?p", TYPE, "?q")).data.count() == a.data.count() * space.where(F.col("p") == TYPE).count()


def test_ntriples_round_trip(spark):
    t = graph(spark, (":a", ":p", ('say "hi"\n\\tab\t', None, "en-GB")), ("_:b1", ":p", ":c"), (":a", ":p", ("1", XSD + "integer")), (":a", ":q", ("",)))
    lines = ntriples.ntriples_lines(t).select(F.col("line").alias("value"))
    more = spark.createDataFrame([("# note",), ("",), ("<x> <y> oops .",), ('<http://a> <http://b> "\\u00e9\\U0001F600" .',)], "value string")
    good, bad = ntriples.parse_lines(lines.unionByName(more), F.lit("g"))
    assert rows(good.where(f"p like '{E}%'"), *t.columns) == rows(t, *t.columns)
    assert [r.value for r in bad.collect()] == ["<x> <y> oops ."]
    assert good.where("s = 'http://a'").first()["o"] == "é😀"


def test_search_and_budget(space):
    nodes, edges = eg.entity_graph(space)
    assert ranking.search_nodes(nodes, " ").count() == 0
    assert short(r[0] for r in rows(ranking.search_nodes(nodes, "EAR"), "id")) == ["Earth"]
    kept, inside, totals = ranking.budget_graph(nodes, edges, 2)
    assert kept.count() == 2 and totals.first()["truncated"]
    ids = {r["id"] for r in kept.collect()}
    assert all(r["source"] in ids and r["target"] in ids for r in inside.collect())


def test_csv_and_json(spark):
    none = F.lit(None).cast("string")
    df = spark.createDataFrame([("=1+1",), ('a"b,c',), (None,)], "v string")
    cell = F.when(F.col("v").isNotNull(), results.term_struct(F.lit("literal"), F.col("v"), none, none)).alias("x")
    lines = sorted(r.line for r in results.csv_lines(df.select(cell), ["x"]).collect())
    assert lines == ["", '"a""b,c"', "'=1+1"]
    assert sorted(r.line for r in results.json_lines(df.select(cell), ["x"]).collect())[-1] == "{}"


def test_docs(space, spark):
    assert rows(docs.doc_profile(space), "profile") == [("ontpub",)]
    nodes, edges = eg.entity_graph(space)
    assert E + "Earth" not in {r["id"] for r in docs.doc_graph(space, nodes, edges)[0].collect()}
    assert rows(docs.doc_limits(space, nodes, edges, max_terms=1), "what") == [("terms",)]
    sources = spark.createDataFrame([("g", 11)], "graph string, octets long")
    broken = docs.doc_limits(space, nodes, edges, sources=sources, max_nodes=2, max_graph_bytes=50, max_source_bytes=10)
    assert rows(broken, "what") == [("graph bytes",), ("nodes",), ("source bytes",)]
    assert docs.doc_limits(space, nodes, edges, sources=sources).count() == 0


def test_throttle(spark):
    times = [0, 1, 2, 3, 60, 60, 61, 61, 200]
    df = spark.createDataFrame([(i, "k", t) for i, t in enumerate(times)], "i long, k string, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = throttle_events(df, key="k", time="ts", order="i", most=3, window=60.0)
    assert [r.accepted for r in got.orderBy("i").collect()] == [True, True, True, False, False, False, True, False, True]


def test_outline_of_a_cycle_and_of_a_deep_chain(spark):
    """A node below itself is shown once, marked; a chain of 20 is shown whole."""
    chain = [(f":n{i + 1:02}", RDFS + "subClassOf", f":n{i:02}") for i in range(20)]
    t = graph(spark, (":a2", RDFS + "subClassOf", ":b"), (":b", RDFS + "subClassOf", ":a"), (":b", RDFS + "subClassOf", ":a2"), *chain)
    found = {r.path.replace(E, ""): r.cyclic for r in hierarchy.tree_rows(*hierarchy.class_forest(t)).collect()}
    assert {p: c for p, c in found.items() if p.startswith("a")} == {"a": False, "a b": False, "a b a2": False, "a b a2 b": True}
    assert " ".join(f"n{i:02}" for i in range(21)) in found


def test_lists_of_any_length(spark):
    n = 1500
    cells = [t for i in range(n) for t in ((f"_:c{i}", "http://www.w3.org/1999/02/22-rdf-syntax-ns#first", f":m{i}"), (f"_:c{i}", "http://www.w3.org/1999/02/22-rdf-syntax-ns#rest", f"_:c{i + 1}" if i + 1 < n else "http://www.w3.org/1999/02/22-rdf-syntax-ns#nil"))]
    ring = [("_:r0", "http://www.w3.org/1999/02/22-rdf-syntax-ns#rest", "_:r1"), ("_:r1", "http://www.w3.org/1999/02/22-rdf-syntax-ns#rest", "_:r0"), ("_:r1", "http://www.w3.org/1999/02/22-rdf-syntax-ns#first", ":x")]
    heads = spark.createDataFrame([("g", "_:c0"), ("g", "_:r0")], "graph string, head string")
    found = schema.rdf_list_items(graph(spark, *cells, *ring), heads)
    assert dict(rows(found.groupBy("head").count(), "head", "count")) == {"_:c0": n, "_:r0": 1}


def test_numbers_of_filters(spark):
    """Every way to write a number in a form field compares as that number; anything else as text."""
    assert [number(x) for x in ("1e2", " .5 ", "5.", "-3", "0x1F", "abc", "1 2", "--1")] == [100, number("0.5"), 5, -3, 31, None, None, None]
    df = spark.createDataFrame([("5",), ("1500",), ("0.25",), ("many",)], "v string")
    keep = lambda op, value: sorted(r.v for r in df.where(filter_condition(Filter(op, value), XSD + "decimal", F.col("v"), F.lit(None))).collect())
    assert keep(">", "1e2") == ["1500"] and keep("<", ".5") == ["0.25"] and keep(">=", "0x5") == ["1500", "5"] and keep("<", "Infinity") == ["0.25", "1500", "5"]
    assert keep("<", "1e-12") == []


def test_blank_filters_are_none(space):
    state = QueryState((Step(E + "Planet", "planet", (Prop(E + "size", "size", XSD + "decimal", filter=Filter(">", "  ")),)),))
    assert rows(run_pattern(space, state), "planet", "planetSize") == [(E + "Earth", None)]


def test_patterns_stay_in_their_graph(spark):
    """The same words in two graphs never join."""
    one = graph(spark, (":a", ":p", ":b"), (":b", ":q", ":c"))
    two = one.withColumn("graph", F.lit("h")).where(F.col("p") == E + "q").withColumn("o", F.lit(E + "d"))
    both = one.unionByName(two)
    joined = Frame.match(both, "?x", E + "p", "?y").and_(Frame.match(both, "?y", E + "q", "?z"))
    assert rows(joined.texts(), "graph", "z") == [("g", E + "c")]
    named = Frame.match(both, "?y", E + "q", "?z").graph_("?g")
    assert rows(named.texts(), "g", "z") == [("g", E + "c"), ("h", E + "d")] and rows(named.graph_("h").texts(), "z") == [(E + "d",)]
    assert Frame.match(both, "?y", E + "q", "?z").minus(Frame.match(one, "?y", E + "q", "?w")).data.count() == 1
    lone = Frame.match(both, "?s", E + "p", "?t")
    other = Frame.match(both, "?k", E + "q", "?l")
    with pytest.raises(ValueError):
        lone.optional(other)
    assert rows(lone.and_(other).texts(), "graph", "s", "l") == [("g", E + "a", E + "c")]
    assert lone.exists(other).data.count() == 1 and lone.not_exists(other).data.count() == 0


def test_limits_are_clamped(space):
    nodes, edges = eg.entity_graph(space)
    kept, _, totals = ranking.budget_graph(nodes, edges, 0)
    assert kept.count() == 1 and (totals.first().budget, totals.first().truncated) == (1, True)
    assert ranking.budget_graph(nodes, edges, 10**6)[2].first().budget == 20_000
    center = nodes.where(F.col("id") == E + "Earth").select("graph", F.col("id").alias("center"))
    assert ranking.neighborhood(nodes, edges, center, 0)[0].count() == 2
    assert ranking.neighborhood(nodes, edges, center, 10**9)[0].where("truncated").count() == 0


def test_hierarchy_shares_its_room(spark):
    """Six classes and twelve concepts with room for nine: three and six of them."""
    t = graph(spark, *[(f":c{i}", RDFS + "subClassOf", f":c{i // 2}") for i in range(1, 6)], *[(f":k{i:02}", SKOS + "broader", f":k{i // 2:02}") for i in range(1, 12)])
    nodes, pairs, counts = hierarchy.hierarchy(t, 9)
    assert dict(rows(nodes.groupBy("forest").count(), "forest", "count")) == {"class": 3, "concept": 6}
    assert rows(counts, "classes", "concepts", "truncated") == [(6, 12, True)]
    kept = {(r.forest, r.id) for r in nodes.collect()}
    assert all((r.forest, r.child) in kept and (r.forest, r.parent) in kept for r in pairs.collect())
    below = {(r.forest, r.child) for r in pairs.collect()}
    assert {(r.forest, r.id) for r in nodes.where("root").collect()} == kept - below
    assert rows(hierarchy.hierarchy(t)[0].where("root"), "id") == [(E + "c0",), (E + "k00",)]


def test_first_mention(spark):
    texts = spark.createDataFrame([(1, "about Mars\nns1:Mars2020 first\nx ns1:Mars, then\n<http://e.org/Mars>"), (2, ":Mars."), (3, "Mars only"), (4, None), (5, "http://e.org/Marsh\n:Mars-x\n(:Mars)")], "doc long, text string")
    names = spark.createDataFrame([("http://e.org/Mars", "Mars"), ("http://e.org/Sun", "s:Sun")], "iri string, prefixed string")
    assert rows(library.first_mention(texts, names, doc="doc", text="text"), "doc", "iri", "line") == [(1, "http://e.org/Mars", 4), (2, "http://e.org/Mars", 1), (5, "http://e.org/Mars", 3)]


def test_append_class(space):
    links, labels = schema.schema_links(space), terms.pick_label(space)
    classes = space.select("graph").distinct().select("graph", F.explode(F.array(F.lit(E + "Star"), F.lit(E + "Dwarf"))).alias("class"))
    found = schema.append_class(links, schema.class_lineage(space), labels, [E + "Star", E + "Planet"], classes)
    assert {(r["class"].replace(E, ""), r.anchor, r.predicate.replace(E, ""), r.inverse) for r in found.collect()} == {("Star", 1, "orbits", False), ("Dwarf", 1, "orbits", False)}


def test_undrawn_results(space):
    nodes, _ = eg.entity_graph(space)
    hits = ranking.search_nodes(nodes, "ear")
    assert short(r[0] for r in rows(ranking.undrawn_results(hits, nodes.where("kind = 'class'")), "id")) == ["Earth"]
    assert ranking.undrawn_results(hits, nodes.where("kind = 'individual'")).count() == 0


def test_places_of_the_whole_table(spark):
    df = spark.createDataFrame([(i * 37 % 101,) for i in range(100)] + [(5,)] * 20, "v long").repartition(5)
    assert [r.place for r in results.with_places(df, F.desc("v")).orderBy("place").collect()] == list(range(1, 121))
    assert results.with_places(df.limit(0), "v").count() == 0


def test_ingest_leaves_no_trace_of_a_failed_load(space, spark, tmp_path):
    prefixes = spark.createDataFrame([("g", "e", E), ("g", "", E)], "graph string, prefix string, namespace string")
    path = f"file://{tmp_path}/lib"
    done = library.ingest_graph(space.union(space), prefixes, path, added_at="2024", load="one")
    assert rows(done, "graph", "triples", "namespaces", "load") == [("g", space.distinct().count(), f"e={E}", "one")]
    broken = space.withColumn("o", F.raise_error(F.lit("bad")).cast("string"))
    with pytest.raises(Exception, match="bad"):
        library.ingest_graph(broken, prefixes, path, added_at="2025", load="two")
    assert rows(spark.read.parquet(f"{path}/summary"), "load") == [("one",)]


def test_sinks(spark, tmp_path):
    library.activity_log_append(spark, f"{tmp_path}/log", [("Import", "a", "{}")])
    library.activity_log_append(spark, f"{tmp_path}/log", [("Export", "b", "{}"), ("Export", "c", "{}")])
    log = spark.read.json(f"{tmp_path}/log")
    assert rows(log, "`@type`", "subject") == [("Export", "b"), ("Export", "c"), ("Import", "a")] and log.where("at is null").count() == 0
    none = F.lit(None).cast("string")
    frame = spark.createDataFrame([("x,1",), ("y",)], "v string").select(results.term_struct(F.lit("literal"), F.col("v"), none, none).alias("a b"))
    results.export_csv(frame, ["a b"], f"{tmp_path}/csv")
    results.export_json(frame, ["a b"], f"{tmp_path}/json")
    raw = lambda part: sorted(p.read_bytes() for p in (tmp_path / "csv" / part).glob("part-*") if p.read_bytes())
    assert raw("header") == [b"a b\r\n"] and b"".join(raw("rows")).count(b"\r\n") == 2 and b'"x,1"' in b"".join(raw("rows"))
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/json").collect())[0] == '{"a b":{"type":"literal","value":"x,1"}}'


def test_streams(spark, tmp_path):
    """Files in, decisions and log lines out; state goes on from one batch to the next."""
    (tmp_path / "in").mkdir()
    part = lambda n, ts: spark.createDataFrame([("k", t) for t in ts], "k string, t long").select("k", F.timestamp_seconds("t").alias("ts"), F.col("t").alias("i")).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    part("a", [1000, 1001, 1002])
    part("b", [1003, 1061])
    source = lambda: spark.readStream.schema("k string, ts timestamp, i long").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*")
    throttled = throttle_stream(source(), key="k", time="ts", order="i", most=2, window=60.0)
    throttled.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "t", "accepted") == [(1000.0, True), (1001.0, True), (1002.0, False), (1003.0, False), (1061.0, True)]
    query = activity_stream(source().select("k"), f"{tmp_path}/log", f"{tmp_path}/c2")
    query.processAllAvailable()
    query.stop()
    assert spark.read.json(f"{tmp_path}/log").count() == 5


def test_empty_graph(spark):
    t = spark.createDataFrame([], SCHEMA)
    nodes, edges = eg.entity_graph(t)
    assert nodes.count() == edges.count() == 0
    assert hierarchy.hierarchy(t)[2].count() == 0
    assert schema.schema_links(t).count() == 0


def test_terms_of_one_text_and_four_kinds(spark):
    """The IRI :b, a plain, a tagged and a typed literal and a blank node, all with the same text."""
    text = E + "b"
    t = graph(spark, (":a", ":p", ":b"), (":a", ":p", (text,)), (":a", ":p", (text, None, "en")), (":a", ":p", (text, E + "t")), (":a", ":p", "_:b"), (":b", ":q", ":end"), ("_:b", ":q", ":blank"), (":c", ":p", (text, XSD + "string")))
    hop = Frame.match(t, "?x", E + "p", "?y").and_(Frame.match(t, "?y", E + "q", "?z"))
    assert rows(hop.texts(), "y", "z") == [("_:b", E + "blank"), (text, E + "end")]
    state = QueryState((Step(None, "x", pin=(E + "a",)), Step(None, "y", link=Link(0, ((E + "p", False),))), Step(None, "z", link=Link(1, ((E + "q", False),)))))
    assert rows(run_pattern(t, state), "z") == [(E + "blank",), (E + "end",)]
    closure_ = QueryState((Step(None, "x", pin=(E + "a",)), Step(None, "z", link=Link(0, ((E + "p", False), (E + "q", False)), modifier="+"))), distinct=True)
    assert run_pattern(t, closure_).count() == 7 and run_pattern(t, closure_, terms=True).select("z.kind").distinct().count() == 3
    for term, n in ((text, 1), (literal(text), 2), (literal(text, lang="EN"), 1), (literal(text, E + "t"), 1), (bnode("_:b"), 1), (literal(text, lang="fr"), 0), (bnode(text), 0)):
        assert Frame.match(t, "?x", E + "p", term).data.count() == n, term
    same = Frame.match(t, "?x", E + "p", "?y").project("y").distinct()
    assert same.data.count() == 5 and same.and_(Frame.match(t, E + "c", E + "p", "?y")).flat().first().asDict() == {"graph": "g", "y": text, "y_kind": "literal", "y_datatype": XSD + "string", "y_lang": ""}
    assert Frame.match(t, "?x", "?x", "?y").data.count() == 0 and Frame.match(graph(spark, (":p", ":p", ":p")), "?x", "?x", "?x").data.count() == 1
    left = Frame.match(t, "?x", E + "p", "?y")
    assert left.exists(Frame.match(t, "?y", E + "q", "?z")).data.count() == 2 and left.minus(Frame.match(t, "?y", E + "q", "?z")).data.count() == 4
    assert rows(left.optional(Frame.match(t, "?y", E + "q", "?z")).texts().where("z is null"), "x") == [(E + "a",)] * 3 + [(E + "c",)]


def test_values(spark):
    t = graph(spark, (":a", ":p", ":x"), (":b", ":p", ("x",)), (":c", ":p", (E + "x",)))
    f = Frame.match(t, "?s", E + "p", "?o")
    assert rows(f.values("o", [E + "x"]).texts(), "s") == [(E + "a",)]
    assert rows(f.values("o", [literal("x"), literal(E + "x"), literal("x")]).texts(), "s") == [(E + "b",), (E + "b",), (E + "c",)]
    both = f.values(["s", "o", "n"], [(E + "a", None, literal("1")), (None, literal("x"), None), (E + "a", literal("x"), literal("2")), (None, None, literal("3"))])
    assert sorted(str(tuple(r)) for r in both.texts().select("s", "n").collect()) == sorted(map(str, [(E + "a", "1"), (E + "b", None), (E + "a", "3"), (E + "b", "3"), (E + "c", "3")])) and "n" in both.nullable
    assert f.values("s", []).data.count() == 0 and f.values(["m"], [(iri(E + "m"),)]).data.count() == 3
    with pytest.raises(ValueError):
        both.values("n", [literal("1")])
    with pytest.raises(ValueError):
        f.values(["s", "o"], [(E + "a",)])


def test_products_check_their_size(spark, monkeypatch):
    from graphloom.operators import pattern

    t = graph(spark, *[(f":a{i}", ":p", ":x") for i in range(6)], *[(f":b{i}", ":q", ":y") for i in range(9)])
    a, b = Frame.match(t, "?s", E + "p", "?o"), Frame.match(t, "?k", E + "q", "?l")
    assert a.and_(b).data.count() == b.and_(a).data.count() == 54
    monkeypatch.setattr(pattern, "MAX_PRODUCT", 6)
    assert b.and_(a).data.count() == 54
    monkeypatch.setattr(pattern, "MAX_PRODUCT", 5)
    with pytest.raises(ValueError):
        a.and_(b)


def test_order_of_terms(spark):
    """A column of every kind, against a key made in Python."""
    import random
    from datetime import datetime
    from decimal import Decimal

    dec, boo, day, moment = (XSD + x for x in ("decimal", "boolean", "date", "dateTime"))
    terms_ = [None, bnode("_:b"), bnode("_:a"), iri("z"), iri("a"), iri("10"), literal("b"), literal("B"), literal("10"), literal("b", lang="fr"), literal("b", lang="de"), literal("a", lang="fr"), literal("9", dec), literal("10", XSD + "integer"), literal("10.0", dec), literal("-1e3", XSD + "double"), literal("many", dec), literal("true", boo), literal("false", boo), literal("maybe", boo), literal("2020-01-02", day), literal("2019-12-31Z", day), literal("2020-01-01T10:00:00", moment), literal("soon", moment), literal("x", "urn:t"), literal("", XSD + "string"), literal("é")]

    def key(t):
        if t is None:
            return (0,)
        rest = (t.text, t.lang, t.datatype)
        if t.kind != "literal":
            return (1 if t.kind == "bnode" else 2, *rest)
        number = boolean = time = None
        if t.datatype in (dec, XSD + "integer", XSD + "double") and t.text != "many":
            number = Decimal(t.text)
        if t.datatype == boo and t.text in ("true", "false"):
            boolean = t.text == "true"
        if t.datatype in (day, moment) and t.text[0] == "2":
            time = datetime.fromisoformat(t.text.rstrip("Z"))
        group = 0 if number is not None else 1 if boolean is not None else 2 if time else {XSD + "string": 3, LANG_STRING: 4}.get(t.datatype, 5)
        return (3, group, number or 0, boolean or False, time or datetime.min, *rest)

    mixed = terms_ * 2
    random.Random(4).shuffle(mixed)
    frame = spark.createDataFrame([("g", None if t is None else tuple(vars(t).values())) for t in mixed], "graph string, x struct<kind:string,text:string,datatype:string,lang:string>").repartition(3)
    got = [None if r.x is None else Term(*r.x) for r in Frame(frame).order_by("x").data.collect()]
    assert got == sorted(mixed, key=key)
    assert [None if r.x is None else Term(*r.x) for r in Frame(frame).order_by("-x").data.collect()] == sorted(mixed, key=key)[::-1]
    placed = results.with_places(frame, *order_keys(F.col("x"))).orderBy("place").collect()
    assert [None if r.x is None else Term(*r.x) for r in placed] == got


def test_assertions_stay_in_their_graph(spark):
    """A property declared in one graph makes no facts in another."""
    one = graph(spark, (":knows", TYPE, OWL + "ObjectProperty"), (":a", ":knows", ":b"))
    both = one.unionByName(graph(spark, (":c", ":knows", ":d")).withColumn("graph", F.lit("h")))
    assert rows(eg.assertion_edges(both), "graph", "source", "label") == [("g", E + "a", "knows")]


def test_search_is_one_list_a_graph(spark):
    nodes = spark.createDataFrame([("g", f"http://x/{i:02}", f"Name {i}", "class", 1) for i in range(30)] + [("h", "http://x/h", "A name", "class", 1)], "graph string, id string, label string, kind string, degree long")
    found = ranking.search_nodes(nodes, "name", 5)
    assert rows(found, "graph", "place") == [("g", i) for i in range(1, 6)] + [("h", 1)]


def edge_table(spark, pairs, g="g"):
    return spark.createDataFrame([(g, a, b) for a, b in pairs], "graph string, a string, b string")


def reached(pairs, start):
    """Fewest steps from ``start`` to each node that a path of one step or more leads to."""
    onward, depth, level, steps = {}, {}, [start], 0
    for a, b in pairs:
        onward.setdefault(a, []).append(b)
    while level:
        steps += 1
        level = list({b for a in level for b in onward.get(a, ()) if b not in depth})
        depth.update(dict.fromkeys(level, steps))
    return depth


def test_deep_paths_are_found_by_doubling(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(5000)]
    seeds = spark.createDataFrame([("g", "n3"), ("g", "n4990")], "graph string, start string")
    found = closure.path_closure(edge_table(spark, chain), seeds)
    assert {(r.start, r.node): r.depth for r in found.collect()} == {(s, n): d for s in ("n3", "n4990") for n, d in reached(chain, s).items()}


def test_deep_cyclic_paths(spark, monkeypatch):
    import random

    monkeypatch.setattr(closure, "SINGLE_STEPS", 3)
    r = random.Random(2)
    ring = [(f"n{i}", f"n{(i + 1) % 60}") for i in range(60)] + [(f"n{r.randrange(60)}", f"m{r.randrange(9)}") for _ in range(9)] + [("m1", "m2"), ("m2", "m1"), ("m3", "n5"), ("m4", "m4")]
    found = closure.path_closure(edge_table(spark, ring))
    assert {(x.start, x.node, x.depth) for x in found.collect()} == {(s, n, d) for s in {a for a, _ in ring} for n, d in reached(ring, s).items()}
    near = closure.path_closure(edge_table(spark, ring), max_depth=7)
    assert {(x.start, x.node, x.depth) for x in near.collect()} == {(s, n, d) for s in {a for a, _ in ring} for n, d in reached(ring, s).items() if d <= 7}


@pytest.mark.parametrize("local", [True, False])
def test_components_and_least_values(spark, monkeypatch, local):
    """Both ways of settling a graph, on many small random ones with chains and rings."""
    import random

    from graphloom.operators import components

    if not local:
        monkeypatch.setattr(components, "LOCAL_EDGES", 0)
    r = random.Random(5)
    edges, values, strong, least = [], [], set(), set()
    for g in range(25):
        names = [f"n{i:02}" for i in range(r.randint(2, 12))]
        pairs = {(r.choice(names), r.choice(names)) for _ in range(r.randint(1, 18))} | (set(zip(names, names[1:], strict=False)) if g % 4 == 0 else set()) | ({(names[-1], names[0])} if g % 8 == 0 else set())
        below = {n: set(reached(pairs, n)) | {n} for n in names}
        value = {n: (r.randint(0, 3), n) for n in names}
        edges += [(f"g{g}", a, b) for a, b in pairs]
        values += [(f"g{g}", n, *value[n]) for n in names]
        for n in names:
            part = {m for m in names if m in below[n] and n in below[m]}
            strong |= {(f"g{g}", n, min(part))} if len(part) > 1 else set()
            least.add((f"g{g}", n, *min(value[m] for m in names if n in below[m])))
    frame = spark.createDataFrame(edges, "graph string, a string, b string")
    assert {tuple(x) for x in components.strong_components(frame).collect()} == strong
    assert {tuple(x) for x in components.least_reaching(frame, spark.createDataFrame(values, "graph string, node string, rank int, id string")).collect()} == least


def test_a_ring_of_100_000_nodes(spark):
    """Far beyond what one task settles; a tail hangs on it, and another leads to it."""
    n, size = 100_000, F.lit(100_000)
    name = lambda c: F.concat(F.lit("x"), F.lpad(c.cast("string"), 6, "0"))
    ring = spark.range(n).select(F.lit("g").alias("graph"), name((F.col("id") + 1) % size).alias("child"), name(F.col("id")).alias("parent"))
    tails = spark.createDataFrame([("g", "y1", "x000005"), ("g", "y2", "y1"), ("g", "x000009", "w")], "graph string, child string, parent string")
    parents = ring.unionByName(tails)
    assert hierarchy.cycle_marks(parents).count() == n
    nodes = parents.select("graph", F.explode(F.array("child", "parent")).alias("id")).distinct()
    assert hierarchy.promoted_roots(nodes, parents).count() == 0
    assert rows(hierarchy.promoted_roots(nodes.where("id <> 'w'"), parents.where("parent <> 'w'")), "id") == [("x000000",)]


def test_outline_of_a_chain_of_5000(spark):
    parents = spark.createDataFrame([("g", f"n{i + 1}", f"n{i}") for i in range(4999)] + [("g", "z", "n4998"), ("g", "a", "n4998")], "graph string, child string, parent string")
    nodes = spark.createDataFrame([("g", f"n{i}") for i in range(5000)] + [("g", "z"), ("g", "a"), ("g", "m")], "graph string, id string")
    found = sorted((r.position, r.id, r.depth) for r in hierarchy.tree_rows(nodes, parents).select("position", "id", "depth").collect())
    assert found[:2] == [(1, "m", 0), (2, "n0", 0)] and found[-4:] == [(5000, "n4998", 4998), (5001, "a", 4999), (5002, "n4999", 4999), (5003, "z", 4999)]


def test_outline_positions(spark):
    """A walk from the top, children by id, with a node in two places and a cycle."""
    below = {"r": ["b", "a"], "a": ["c", "d"], "b": ["c"], "d": ["a", "e"], "s": []}
    parents = [(c, p) for p, cs in below.items() for c in cs]
    want = []

    def walk(path):
        again = path[-1] in path[:-1]
        want.append((" ".join(path), again))
        for c in sorted(below.get(path[-1], ())) if not again else ():
            walk([*path, c])

    for root in ("r", "s"):
        walk([root])
    nodes = spark.createDataFrame([("g", n) for n in "rabcdes"], "graph string, id string")
    out = hierarchy.tree_rows(nodes, spark.createDataFrame([("g", c, p) for c, p in parents], "graph string, child string, parent string")).orderBy("position").collect()
    assert [(r.path, r.cyclic) for r in out] == want and [r.position for r in out] == list(range(1, len(want) + 1))


def test_places_within_groups(spark):
    """A group over many partitions, small ones beside it, repeated rows."""
    data = [("big", i * 7 % 997) for i in range(3000)] + [(f"k{i % 40}", i) for i in range(200)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = results.places_within(spark.createDataFrame(data, "k string, v long").repartition(5), ["k"], "v").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by = {}
    for r in out:
        by.setdefault(r.k, []).append((r.place, r.v))
    for k, found in by.items():
        assert sorted(found) == list(enumerate(sorted(v for kk, v in data if kk == k), 1))


def test_throttle_cuts_keys_at_pauses(spark):
    """Long keys over many partitions, pauses of exactly the window and a little more, equal times, null keys and times."""
    import random
    from collections import deque

    from graphloom.streaming.throttle import decide, stretches

    r = random.Random(6)
    data, i = [], 0
    for key in ("a", "b", None):
        t = 0.0
        for _ in range(700):
            t += r.choice([0, 0, 1, 5, 9, 60, 61])
            data.append((i, key, t))
            i += 1
    data += [(i, "a", None), (i + 1, None, None)]
    events = spark.createDataFrame(data, "i long, k string, t double").withColumn("ts", F.timestamp_micros((F.col("t") * 1000000).cast("long"))).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x.i: x.accepted for x in throttle_events(events, key="k", time="ts", order="i", most=3, window=60.0).collect()}
        timed = events.where("t is not null").withColumn("_t", F.col("t"))
        cut = stretches(timed, "k", "i", 60.0).select("k", "_stretch", F.spark_partition_id().alias("p")).where("k = 'a'").distinct().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {n: False for n, _, t in data if t is None}
    for key in ("a", "b", None):
        own = sorted((t, n) for n, k, t in data if k == key and t is not None)
        want.update(zip([n for _, n in own], decide([t for t, _ in own], deque(), 3, 60.0), strict=True))
    assert got == want
    times = sorted(t for _, k, t in data if k == "a" and t is not None)
    assert len({x._stretch for x in cut}) == 1 + sum(b - a > 60 for a, b in zip(times, times[1:], strict=False)) and len({x.p for x in cut}) > 1


def test_late_events_and_state_that_ends(spark, tmp_path):
    """A late event counts what was accepted before it; one behind the watermark is dropped; state goes with the watermark."""
    part = lambda ts: spark.createDataFrame([(k, t) for k, t in ts], "k string, t long").select("k", F.timestamp_seconds("t").alias("ts"), F.col("t").alias("i")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    kept = []
    for events in ([("k", 100), ("k", 101), ("k", 190)], [("k", 120), ("k", 195), ("k", 196), ("z", 1)], [("y", 1000)], [("y", 1001)]):
        part(events)
        stream = throttle_stream(spark.readStream.schema("k string, ts timestamp, i long").parquet(f"{tmp_path}/in"), key="k", time="ts", order="i", most=2, window=60.0, delay="100 seconds")
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination()
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    out = spark.read.parquet(f"{tmp_path}/out")
    assert rows(out.where("k = 'k'"), "t", "accepted") == [(100.0, True), (101.0, True), (120.0, False), (190.0, True), (195.0, True), (196.0, False)]
    assert rows(out.where("k <> 'k'"), "k", "t") == [("y", 1000.0), ("y", 1001.0)]
    states = spark.read.format("statestore").option("stateVarName", "accepted").load(f"{tmp_path}/c")
    assert {r.key.k for r in states.select("key").collect()} == {"y"}


def test_logs_go_on(spark, tmp_path):
    rows_ = spark.createDataFrame([("Import", "a", "{}")], "`@type` string, subject string, attributes string").withColumn("at", F.timestamp_seconds(F.lit(5)))
    library.activity_log_append(spark, f"{tmp_path}/log", rows_)
    library.activity_log_append(spark, f"{tmp_path}/log", [("Export", "b", "{}")])
    log = library.activity_log(spark, f"{tmp_path}/log")
    assert rows(log, "type", "subject", "attributes") == [("Export", "b", "{}"), ("Import", "a", "{}")] and rows(log.where("subject = 'a'").select(F.unix_seconds("at").alias("s")), "s") == [(5,)]


def test_lookups_read_only_their_buckets(spark, tmp_path):
    """Neighbourhoods and statements from tables in buckets equal those from whole tables; other buckets are not read."""
    from graphloom.operators import adjacency

    t = graph(spark, (":p", TYPE, OWL + "ObjectProperty"), *[(f":n{i}", ":p", f":n{(i * 7 + j) % 40}") for i in range(40) for j in range(4)], (":n1", ":p", ":n1"), (":n1", ":q", ("text",)))
    nodes, edges = eg.entity_graph(t)

    def table(name, frame, node):
        adjacency.bucketed(frame, node, 8).write.partitionBy("bucket").parquet(f"{tmp_path}/{name}")
        return adjacency.Table(spark.read.parquet(f"{tmp_path}/{name}"), node, 8)

    people, ends, told = table("people", nodes.select("graph", "id", "kind", "degree"), "id"), table("ends", adjacency.edge_ends(nodes, edges), "node"), table("told", adjacency.statements(t), "id")
    centers = spark.createDataFrame([("g", E + "n1"), ("g", E + "n2"), ("g", E + "lost"), ("h", E + "n1")], "graph string, center string")
    for plain, fast in zip(ranking.neighborhood(nodes, edges, centers, 3), ranking.neighborhood(nodes, edges, centers, 3, people=people, ends=ends), strict=True):
        assert plain.count() and sorted(map(str, plain.collect())) == sorted(map(str, fast.select(*plain.columns).collect()))
    one = spark.createDataFrame([("g", E + "n1")], "graph string, id string")
    slow, fast = ranking.node_details(t, one), ranking.node_details(t, one, told=told)
    assert slow.count() and sorted(map(str, slow.collect())) == sorted(map(str, fast.select(*slow.columns).collect()))
    plan = told.of(one)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert plan.count("Exchange hashpartitioning") == 0
    assert [adjacency.bucket_count(n) for n in (0, 10**6, 10**12)] == [8, 32, 4096]


def test_search_by_trigrams(spark):
    nodes = spark.createDataFrame([("g", "http://x/alpha", "Beta", "class", 1), ("g", "http://x/b", "alphabet", "class", 2), ("h", "http://x/c", "ALP", "class", 0), ("g", "http://x/d", "alp hab", "class", 0), ("g", "http://x/é", "Ünïcode", "class", 0), ("g", "x", "y", "class", 0)], "graph string, id string, label string, kind string, degree long")
    postings = ranking.search_postings(nodes)
    for query in ("alpha", "ALP", "al", "ünï", "habet", "b", "http://x", "zzz", " ", "phab"):
        plain, fast = ranking.search_nodes(nodes, query, 3), ranking.search_nodes(nodes, query, 3, postings=postings)
        assert sorted(map(str, plain.collect())) == sorted(map(str, fast.select(*plain.columns).collect())), query


def test_merge_counts(spark):
    nodes = lambda *ids: spark.createDataFrame([("g", i) for i in ids], "graph string, id string")
    edges = lambda *pairs: spark.createDataFrame([("g", a, b, "k", "") for a, b in pairs], "graph string, source string, target string, kind string, label string")
    got = eg.merge_counts(nodes("a", "b"), edges(("a", "b")), nodes("b", "c"), edges(("a", "b"), ("b", "c"), ("c", "d")), nodes(*"abcdef"), edges(("a", "b"), ("b", "c"), ("c", "d"), ("e", "f")))
    assert tuple(got.first()) == ("g", 1, 1, 3, 2, 6, 4)


def test_escapes_of_any_text(spark):
    """Backslashes before letters that mean something, and a text with U+0000, come back as they were."""
    odd = ["a\x00b", "\\n", "\\\\", "\\\\t\\", "\\u0041", "tab\tline\nquote\" \\\" end", "é\x00\\", ""]
    t = graph(spark, *[(f":s{i}", ":p", (x,)) for i, x in enumerate(odd)])
    good, bad = ntriples.parse_lines(ntriples.ntriples_lines(t).select(F.col("line").alias("value")), F.lit("g"))
    assert bad.count() == 0 and dict(rows(good, "s", "o")) == {E + f"s{i}": x for i, x in enumerate(odd)}
    assert [r.u for r in spark.createDataFrame([("\\u0041\\\\u0041\\U0001F600",)], "x string").select(ntriples.unescape(F.col("x")).alias("u")).collect()] == ["A\\u0041\U0001F600"]


def test_lineage_goes_on_from_the_nearest(spark):
    t = graph(spark, (":a", RDFS + "subClassOf", ":b"), (":a", RDFS + "subClassOf", ":c"), (":b", RDFS + "subClassOf", ":d"), (":c", RDFS + "subClassOf", ":e"), (":d", RDFS + "subClassOf", ":f"))
    above = lambda n: short(r[0] for r in rows(schema.class_lineage(t, expanded=n).where(F.col("id") == E + "a"), "ancestor"))
    assert above(200) == list("abcdef") and above(1) == list("abc") and above(2) == list("abcd") and above(3) == list("abcde")
