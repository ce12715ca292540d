"""Plans over derived tables whose files are far smaller than their rows."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions.vocab import OWL, TYPE
from graphloom.operators import docs
from graphloom.operators import entity_graph as eg
from graphloom.plans import queries
from graphloom.plans.tables import DEALT_ROWS, INITIAL, SPLIT_BYTES, _bytes, deal, written


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def packed(spark):
    """Triples, nodes and edges of half a million subjects, in files of a few bytes a row."""
    ids = spark.range(500_000).select(F.lit("trade").alias("graph"), F.concat(F.lit("http://kg/order/"), F.when(F.col("id") < 10, F.col("id").cast("string")).otherwise(F.hex(F.xxhash64("id")))).alias("s"))
    triples = written(ids.select("graph", "s", F.lit("iri").alias("s_kind"), F.lit("http://kg/v#p").alias("p"), F.lit("http://kg/v#Order").alias("o"), F.lit("iri").alias("o_kind")), "t")
    nodes = written(ids.select("graph", F.col("s").alias("id"), F.col("s").alias("label"), F.lit("class").alias("kind"), F.lit(1).alias("degree")), "nodes")
    edges = written(ids.select("graph", F.col("s").alias("source"), F.lit("http://kg/v#Order").alias("target"), F.lit("instanceOf").alias("kind"), F.lit("").alias("label")), "edges")
    return triples, nodes, edges


def test_no_table_is_broadcast_for_its_small_files(packed):
    triples, nodes, edges = packed
    terms = docs.documentable_terms(triples, nodes)
    for frame in (terms, docs.unresolved_imports(triples), docs.doc_graph(triples, nodes, edges)[0], docs.doc_limits(triples, nodes, edges)):
        assert "BroadcastExchange" not in plan(frame)
    assert plan(docs.term_facts(triples, terms)).count("BroadcastExchange") == 2  # the fixed table of facts, for either direction
    assert terms.count() == 500_000


def test_scans_are_divided_by_rows(spark, packed):
    assert _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")) <= SPLIT_BYTES
    assert [_bytes(t) for t in ("7", "134217728b", "128m", "128MB", "2g")] == [7, 128 << 20, 128 << 20, 128 << 20, 2 << 30]


@pytest.mark.parametrize("focus", ["http://kg/order/7", "http://kg/order/none"])
def test_focus_moves_no_edge(spark, packed, focus):
    """A graph is one key: joined by a shuffle, all its edges would meet in one task."""
    _, nodes, edges = packed
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables of any size
    try:
        _check_focus(nodes, edges, focus)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)


def _check_focus(nodes, edges, focus):
    marked = eg.focus_edges(nodes, edges, "trade", focus)
    assert "SortMergeJoin" not in plan(marked) and plan(marked).count("BroadcastHashJoin") == 1
    assert {(r.mark, r["count"]) for r in marked.groupBy("mark").count().collect()} == ({("incident", 1), ("dimmed", 499_999)} if focus.endswith("7") else {("", 500_000)})
    assert "SortMergeJoin [graph" not in plan(eg.focus_neighbors(nodes, edges, "trade", focus))


def test_shuffles_are_dealt_by_the_rows_of_the_sources(spark):
    """With a fixed number of partitions a task's share grows with the input."""
    spark.conf.unset(INITIAL)
    now = int(spark.conf.get("spark.sql.shuffle.partitions"))
    deal(spark, now * DEALT_ROWS)
    assert spark.conf.get(INITIAL, None) is None
    deal(spark, 6 * now * DEALT_ROWS)
    deal(spark, DEALT_ROWS)  # a smaller folder takes nothing back
    assert spark.conf.get(INITIAL) == str(6 * now)
    spark.conf.unset(INITIAL)


def test_restored_metadata_is_read_once_a_graph(spark, monkeypatch, packed):
    monkeypatch.setattr(queries.Kg, "t", property(lambda self: packed[0]))
    restored = queries.QUERIES["library_restore"](spark, "none")
    assert restored._jdf.queryExecution().optimizedPlan().toString().count("o_kind") == 3  # the semi-join's scan, once for each part of the rows
    assert [(r.graph, r.name, r.place) for r in restored.collect()] == [("trade", "TRADE", 1)]


@pytest.mark.parametrize("most", [20_000, 0])
def test_hubs_are_not_moved_by_their_key(spark, monkeypatch, most):
    """All orders have one type: joined with the classes by a shuffle, they would meet in one task."""
    monkeypatch.setattr(eg, "MAX_SENT", most)
    ids = spark.range(1_000).select(F.lit("trade").alias("graph"), F.concat(F.lit("http://kg/order/"), F.col("id")).alias("s"))
    of = lambda frame, p, o: frame.select("graph", "s", F.lit("iri").alias("s_kind"), F.lit(p).alias("p"), F.lit(o).alias("o"), F.lit("iri").alias("o_kind"))
    declared = spark.createDataFrame([("trade", "http://kg/v#Order"), ("trade", "http://kg/v#Unused")], "graph string, s string")
    triples = of(ids, TYPE, "http://kg/v#Order").union(of(ids, TYPE, "http://kg/v#Undeclared")).union(of(declared, TYPE, OWL + "Class")).union(of(ids, "http://kg/v#to", "http://kg/v#x"))
    triples = triples.union(of(spark.createDataFrame([("trade", "http://kg/v#to")], "graph string, s string"), TYPE, OWL + "ObjectProperty"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        instances, assertions = eg.instance_edges(triples, eg.typed_kinds(triples)), eg.assertion_edges(triples)
        assert ("SortMergeJoin" in plan(instances), "SortMergeJoin" in plan(assertions)) == (most == 0, most == 0)
        assert (instances.count(), assertions.count()) == (1_000, 1_000)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
