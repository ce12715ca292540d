"""What a task holds, and what moves, does not follow from how a table was made."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions.vocab import OWL, RDFS, SUBCLASS, TYPE
from graphloom.operators import entity_graph as eg
from graphloom.operators import adjacency, ranking, schema
from graphloom.operators.adjacency import Table, statements
from graphloom.plans import queries, tables
from graphloom.sources import kg, library, ntriples

SMALL = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(monkeypatch):
    """Plans of the tables that an operator writes, by their label."""
    plans = {}

    def keep(frame, label):
        plans[label] = plan(frame)
        return tables.written(frame, label)

    for module in (ranking, library):
        monkeypatch.setattr(module, "written", keep, raising=False)
    return plans


def triples(frame, p, o, o_kind="iri"):
    return frame.select("graph", "s", F.lit("iri").alias("s_kind"), F.lit(p).alias("p"), o.alias("o"), F.lit(o_kind).alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"))


@pytest.fixture(scope="module")
def orders(spark):
    return spark.range(1_000).select(F.lit("trade").alias("graph"), F.concat(F.lit("http://kg/order/"), F.col("id") + 1_000_000).alias("s"))


def test_a_task_reads_a_bounded_share(spark, monkeypatch):
    monkeypatch.setattr(tables, "FILE_ROWS", 100)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64MB")
    found = tables.written(spark.range(0, 1_000, 1, 1), "files")
    assert len(found.inputFiles()) == 10 and found.count() == 1_000
    assert tables._bytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")) <= tables.SHARE_BYTES
    assert tables._bytes(spark.conf.get("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes")) <= tables.HUB_BYTES


def test_order_lines_are_made_distinct_as_numbers(spark):
    """Made distinct as triples, each line would take eight texts in the aggregate and in the shuffle."""
    found = kg.kg_triples(spark, SMALL).where(F.col("p") == kg.V + "contains")
    assert "keys=[l_orderkey" in plan(found)
    plain = spark.read.parquet(f"{SMALL}/lineitem.parquet").where("l_orderkey is not null and l_partkey is not null").select("l_orderkey", "l_partkey").distinct()
    assert found.count() == found.distinct().count() == plain.count()


def test_a_hub_is_cut_where_its_neighbours_are(spark, orders, stored):
    edges = orders.select("graph", F.col("s").alias("source"), F.lit("http://kg/hub").alias("target"), F.lit("assertion").alias("kind"), F.lit("of").alias("label"))
    nodes = orders.select("graph", F.col("s").alias("id"), F.lit("x").alias("label"), F.lit("individual").alias("kind"), F.lit(1).cast("long").alias("degree"))
    nodes = nodes.union(spark.createDataFrame([("trade", "http://kg/hub", "hub", "class", 1_000)], nodes.schema))
    near, inside = ranking.neighborhood(nodes, edges, spark.createDataFrame([("trade", "http://kg/hub")], "graph string, center string"), 3)
    assert "WindowGroupLimit" in stored["hood"] and "SortMergeJoin" not in stored["pairs"]  # edges meet their nodes only as hits
    assert [(r.id, r.place, r.neighbors) for r in near.orderBy("place").collect()] == [("http://kg/hub", 0, 1_000)] + [(f"http://kg/order/{1_000_000 + i}", i + 1, 1_000) for i in range(3)]
    assert inside.count() == 3
    added, links = eg.merge_graph(nodes.where("id = 'http://kg/hub'"), edges.limit(0), near, inside)
    assert added.count() == 3 and links.count() == 3


def test_no_edge_moves_to_meet_a_drawing(spark, orders):
    nodes = tables.written(orders.select("graph", F.col("s").alias("id"), F.col("s").alias("label"), F.lit("individual").alias("kind"), F.lit(1).cast("long").alias("degree")), "nodes")
    edges = orders.select("graph", F.col("s").alias("source"), F.concat("s", F.lit("0")).alias("target"), F.lit("assertion").alias("kind"), F.lit("of").alias("label"))
    kept, inside, _ = ranking.budget_graph(nodes, edges.union(edges.withColumn("target", F.col("source"))), 3)
    assert "SortMergeJoin" not in plan(inside) and inside.count() == kept.count() == 3


def test_a_lookup_writes_no_index_of_all(spark, orders, stored):
    t = triples(orders, "http://kg/p", F.lit("http://kg/hub"))
    found = ranking.node_details(t, spark.createDataFrame([("trade", "http://kg/hub")], "graph string, id string"), 2, told=Table(statements(t), "id"))
    assert "BroadcastHashJoin" in stored["told"] and "Exchange hashpartitioning(id" not in stored["told"]
    assert {(r.direction, r.place, r.total) for r in found.collect()} == {("in", 1, 1_000), ("in", 2, 1_000)}
    tables.forget()
    assert queries.QUERIES["node_details_lookup"](spark, SMALL).count() > 0
    queries.QUERIES["merge_graph"](spark, SMALL)
    assert not [key for _, key in tables._VIEWS if "|told" in key or "|ends" in key]


def told_by_hand(rows, limit):
    told = {}
    for r in rows:
        told.setdefault((r.graph, r.s, "out"), []).append((r.p, r.o, True))
        if r.o_kind != "literal":
            told.setdefault((r.graph, r.o, "in"), []).append((r.p, r.s, r.s_kind == "iri"))
    return sorted((*key, p, value, place, len(all_)) for key, all_ in told.items() for place, (p, value, _) in enumerate(sorted(x for x in all_ if x[2])[:limit], 1))


def test_details_of_all_move_once_share_by_share(spark, monkeypatch):
    """What lies in shuffle files at a time is a share of the statements, each of them once; a hub is cut where its statements are."""
    monkeypatch.setattr(adjacency, "SHARE_ROWS", 5_000, raising=False)
    monkeypatch.setattr(adjacency, "HUB_ROWS", 500, raising=False)
    plans = []
    monkeypatch.setattr(ranking, "written", lambda frame, label: (plans.append(plan(frame)), tables.written(frame, label))[1])
    found = queries.QUERIES["node_details"](spark, SMALL)
    hubs, *shares = [*plans, plan(found)]
    assert len(shares) == 3 and all(x.count("Exchange hashpartitioning") == 1 and "Join" not in x for x in shares)
    assert "WindowGroupLimit" in hubs and "partial_count" in hubs
    assert sorted(map(tuple, found.collect())) == told_by_hand(queries.Kg(spark, SMALL).t.collect(), 30)


@pytest.mark.parametrize("share, hub", [(10**6, 10**6), (20, 5), (1, 0)])
def test_details_of_odd_statements(spark, monkeypatch, share, hub):
    monkeypatch.setattr(adjacency, "SHARE_ROWS", share)
    monkeypatch.setattr(adjacency, "HUB_ROWS", hub)
    rows = [("g", f"x:{i}", "iri", "x:p", "x:hub", "iri") for i in range(20)] + [("g", f"_:b{i}", "bnode", "x:a", "x:hub", "iri") for i in range(5)]
    rows += [("g", "x:1", "iri", "x:p", "x:2", "literal"), ("g", "x:1", "iri", "x:p", "x:2", "iri"), ("g", "x:1", "iri", "x:p", "x:2", "iri"), ("h", "x:1", "iri", "x:q", "x:1", "iri"), ("g", "_:b0", "bnode", "x:q", "_:b1", "bnode")]
    t = spark.createDataFrame(rows, "graph string, s string, s_kind string, p string, o string, o_kind string")
    lost = spark.createDataFrame([("g", None, "iri", "x:p", "x:9", "literal"), (None, "x:1", "iri", "x:p", "x:2", "iri")], t.schema)
    wanted = told_by_hand(t.collect(), 3)
    assert {x[-2:] for x in wanted if x[1] == "x:hub"} == {(1, 25), (2, 25), (3, 25)}
    assert sorted(map(tuple, ranking.node_details(t.union(lost), limit=3).collect())) == wanted
    some = spark.createDataFrame([("g", "x:1"), ("g", "x:hub"), ("g", "x:hub"), ("h", "x:2"), ("g", None)], "graph string, id string")
    assert sorted(map(tuple, ranking.node_details(t.union(lost), some, 3).collect())) == [x for x in wanted if x[:2] in {("g", "x:1"), ("g", "x:hub")}]


def test_postings_are_few(spark, orders):
    nodes = orders.select("graph", F.col("s").alias("id"), F.col("s").alias("label"), F.lit("individual").alias("kind"), F.lit(1).alias("degree"))
    postings = ranking.search_postings(nodes)
    assert postings.count() < 3 * nodes.count()  # a node alone has over twenty
    for query in ("1000123", "order/10009", "zzz", "kg/order", "r/1"):
        wanted, got = ranking.search_nodes(nodes, query, 50), ranking.search_nodes(nodes, query, 50, postings=postings)
        assert wanted.columns == got.columns and sorted(map(str, wanted.collect())) == sorted(map(str, got.collect())), query


@pytest.mark.parametrize("most", [200_000, 0])
def test_sets_are_counted_by_hashes_and_exactly(spark, orders, stored, monkeypatch, most):
    monkeypatch.setattr(library, "MAX_REPEATED", most)
    once = triples(orders, "http://kg/p", F.lit("a"), "literal")
    model = once.limit(5).withColumn("graph", F.lit("model"))
    sizes = library.set_sizes(once.unionByName(once.limit(7)).unionByName(model).unionByName(model))
    assert {tuple(r) for r in sizes.collect()} == {("trade", 1_000), ("model", 5)}
    assert "Exchange hashpartitioning(graph" in stored["again"] and "hashpartitioning(graph#" in stored["again"] and ", s#" not in stored["again"].split("Exchange")[1].split("\n")[0]


def test_lines_are_matched_once_for_all_parts(spark):
    lines = ['<http://a> <http://b> "x\\ny"^^<http://t> .', '_:s <http://b> _:o <http://g> . # "c"', "<> <http://b> <> .", '<http://a> <http://b> "" .', '<http://a> <http://b> "a b\x01"@en-GB <http://g> .', '<http://a> <http://b> "$1\\\\"^^<http://www.w3.org/2001/XMLSchema#string>.\n']
    good, bad = ntriples.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"), F.lit("d"))
    optimized = good._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in optimized and optimized.count("regexp_replace(value") == 1
    assert bad.count() == 0 and {tuple(r) for r in good.collect()} == {
        ("d", "http://a", "iri", "http://b", "x\ny", "literal", "http://t", None),
        ("http://g", "_:s", "bnode", "http://b", "_:o", "bnode", None, None),
        ("d", "", "iri", "http://b", "", "iri", None, None),
        ("d", "http://a", "iri", "http://b", "", "literal", None, None),
        ("http://g", "http://a", "iri", "http://b", "a b\x01", "literal", None, "en-GB"),
        ("d", "http://a", "iri", "http://b", "$1\\", "literal", None, None),
    }


@pytest.fixture(scope="module")
def declared_trade(spark):
    """Vips are customers; a rule says that each vip is of what the value is; carts are of no class above either."""
    links = [("Vip", SUBCLASS, "Customer"), ("Vip", SUBCLASS, "_:r"), ("_:r", OWL + "onProperty", "lives"), ("_:r", OWL + "hasValue", "n1"), ("n1", TYPE, "Nation"), ("n2", TYPE, "Nation"), ("c1", TYPE, "Customer"), ("v1", TYPE, "Vip"), ("x1", TYPE, "Cart")]
    links += [("Customer", TYPE, OWL + "Class"), ("lives", RDFS + "domain", "Customer"), ("lives", RDFS + "range", "Nation"), ("c1", "lives", "n1"), ("v1", "lives", "n1"), ("v1", "lives", "n2"), ("n1", "hosts", "v1"), ("x1", "of", "c1"), ("c1", "has", "x1")]
    kind = lambda x: "bnode" if x.startswith("_:") else "iri"
    columns = "graph string, s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string"
    return tables.written(spark.createDataFrame([("trade", s, kind(s), p, o, kind(o), None, None) for s, p, o in links], columns), "t")


@pytest.mark.parametrize("most", [20_000, 0])
def test_links_among_classes_are_those_of_all(declared_trade, monkeypatch, most):
    monkeypatch.setattr(eg, "MAX_SENT", most)
    pair, t, kept = ("Vip", "Nation"), declared_trade, {}
    monkeypatch.setattr(schema, "written", lambda frame, label: kept.setdefault(label, tables.written(frame, label)))
    every, above = schema.schema_links(t), schema.class_lineage(t)
    assert ("trade", "Vip", "lives", "Nation", False, True, 2) in {tuple(r)[:7] for r in every.collect()}  # by the value's type
    kept.clear()
    lineage = schema.class_lineage(t, of=pair)
    assert {tuple(r) for r in lineage.collect()} == {tuple(r) for r in above.where(F.col("id").isin(*pair)).collect()} == {("trade", "Vip", "Vip", 0), ("trade", "Vip", "Customer", 1), ("trade", "Nation", "Nation", 0)}
    ends = tables.written(lineage.select("graph", F.col("ancestor").alias("iri")), "ends")
    kept.clear()
    links = schema.schema_links(t, among=ends)
    assert {r.type for r in kept["types-among"].collect()} == {"Vip", "Customer", "Nation"}  # no cart is joined with its uses
    names = [r.iri for r in ends.collect()]
    assert {tuple(r) for r in links.collect()} == {tuple(r) for r in every.where(F.col("source").isin(*names) & F.col("target").isin(*names)).collect()}
    found = {tuple(r) for r in schema.inherited_links(links, lineage, *pair).collect()}
    assert found == {tuple(r) for r in schema.inherited_links(every, above, *pair).collect()} == {("trade", "lives", False, True, True, False, 2), ("trade", "hosts", True, True, False, False, 1)}


def test_a_pair_needs_no_table_of_all_types_or_links(spark):
    tables.forget()
    assert queries.QUERIES["inherited_links"](spark, SMALL).count() > 0
    assert not [key for _, key in tables._VIEWS if key.split("|")[1] in ("types", "links", "lineage", "classes")]


def test_uses_are_not_sorted_to_meet_their_types(spark, declared_trade):
    """Nor are all triples read for each kind of declaration."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "SortMergeJoin" not in plan(schema.observed_links(declared_trade)) and plan(schema.observed_links(declared_trade)).count("ShuffledHashJoin") == 2
        types, declared = tables.written(schema.instance_types(declared_trade), "types"), tables.written(schema.declarations(declared_trade), "declared")
        marked = declared_trade.where("coalesce(o_datatype, '') <> 'marker'")
        links = schema.schema_links(marked, schema.restriction_links(marked, types, declared), types=types, declared=declared)
        assert links._jdf.queryExecution().optimizedPlan().toString().count("marker") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
