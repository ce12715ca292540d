"""A library of graphs as tables: summaries, removal, saved queries, activity, source excerpts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.entity_graph import edge_counts, kind_counts
from graphloom.operators.ranking import budget_nodes
from graphloom.plans.tables import written
from graphloom.sources.kg import COLUMNS, canonical


def library_summary(triples: DataFrame, nodes: DataFrame, edges: DataFrame, prefixes: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """One row per graph: triples (as a set), nodes, edges, assertions, kinds, namespaces, card (20 best nodes) as texts, and addedAt.

    ``added`` (graph, addedAt) is the library's own record; graphs without one have an empty addedAt.
    """
    sizes = set_sizes(triples)
    kinds = kind_counts(nodes).groupBy("graph").agg(F.sum("n").alias("nodes"), F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "kind", "n"))), " ").alias("kinds"))
    card = budget_nodes(nodes, 20).groupBy("graph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]), " ").alias("card"))
    out = sizes.join(kinds, "graph", "left").join(edge_counts(edges), "graph", "left").join(named_spaces(prefixes), "graph", "left").join(card, "graph", "left")
    out = out.join(added.groupBy("graph").agg(F.min("addedAt").alias("addedAt")), "graph", "left") if added is not None else out.withColumn("addedAt", F.lit(""))
    return out.na.fill(0).na.fill("").select("graph", "triples", "nodes", "edges", "assertions", "kinds", "namespaces", "card", "addedAt")


#: Repeated hashes that are sent to all tasks.
MAX_REPEATED = 200_000


def set_sizes(triples: DataFrame) -> DataFrame:
    """graph, triples: the size of each graph as a set, exactly.

    Equal triples have equal hashes, so hashes are counted and only triples whose hash comes again are compared in whole: each
    graph has its rows, less those, plus the different ones among those.
    """
    hashed = triples.withColumn("_hash", F.xxhash64(*COLUMNS))
    again = written(hashed.groupBy("graph", "_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "again")
    count = lambda frame: frame.groupBy("graph").agg(F.count(F.lit(1)).alias("triples"))
    if again.limit(MAX_REPEATED + 1).count() > MAX_REPEATED:
        return count(canonical(triples))
    different = count(canonical(hashed.join(F.broadcast(again.select("graph", "_hash")), ["graph", "_hash"], "left_semi")))
    every = count(triples).unionByName(again.groupBy("graph").agg((-F.sum("_n")).alias("triples"))).unionByName(different)
    return every.groupBy("graph").agg(F.sum("triples").alias("triples"))


def named_spaces(prefixes: DataFrame) -> DataFrame:
    """graph, namespaces: the named prefixes of each graph as one text."""
    return prefixes.where("prefix <> ''").groupBy("graph").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws("=", "prefix", "namespace"))), " ").alias("namespaces"))


def ingest_graph(triples: DataFrame, prefixes: DataFrame, path: str, *, added_at: str, load: str | None = None) -> DataFrame:
    """Write the set of triples by graph, the prefixes, and last the summary rows; returns the summary of this load.

    Every load has folders of its own, and a reader goes by the summary: a load that failed on the way has no row there
    and so no trace in the library.  graph, triples, namespaces, addedAt, load.
    """
    spark, load = triples.sparkSession, load or uuid.uuid4().hex
    spread = F.pmod(F.xxhash64("s"), F.lit(64))  # types and labels are a large share of a graph: no task takes a whole predicate
    canonical(triples).repartition("graph", "p", spread).sortWithinPartitions("graph", "p", "s").write.partitionBy("graph").parquet(f"{path}/triples/load={load}")
    prefixes.select("graph", "prefix", "namespace").distinct().write.parquet(f"{path}/prefixes/load={load}")
    sizes = spark.read.parquet(f"{path}/triples/load={load}").groupBy("graph").agg(F.count(F.lit(1)).alias("triples"))
    rows = sizes.join(named_spaces(prefixes), "graph", "left").na.fill("").select("graph", "triples", "namespaces", F.lit(added_at).alias("addedAt"), F.lit(load).alias("load"))
    rows.write.mode("append").parquet(f"{path}/summary")
    return spark.read.parquet(f"{path}/summary").where(F.col("load") == load)


def library_restore(rows: DataFrame, triples: DataFrame) -> DataFrame:
    """Readable metadata rows (``json``) whose graph has data, oldest first."""
    meta = rows.select(F.from_json("json", "graph string, name string, addedAt string").alias("m")).where("m.graph is not null and m.addedAt is not null").select("m.*")
    return meta.join(triples.select("graph").distinct(), "graph", "left_semi").withColumn("place", F.row_number().over(Window.orderBy("addedAt", "graph")).cast("long"))


def library_search(summaries: DataFrame, text: str, name: str = "graph") -> DataFrame:
    return summaries.where(F.lower(name).contains(text.strip().lower()))


def remove_graphs(triples: DataFrame, saved: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Triples and saved queries without the named graphs."""
    gone = triples.sparkSession.createDataFrame([(n,) for n in names], "graph string").distinct()
    return triples.join(gone, "graph", "left_anti"), saved.join(gone, "graph", "left_anti")


def removal_impact(saved: DataFrame) -> DataFrame:
    """graph, queries, names: what a removal would delete; names are listed only up to three."""
    counts = saved.groupBy("graph").agg(F.count(F.lit(1)).alias("queries"))
    few = saved.join(counts.where("queries <= 3"), "graph", "left_semi").groupBy("graph").agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("names"))
    return counts.join(few, "graph", "left").na.fill("", ["names"])


def saved_queries(log: DataFrame) -> DataFrame:
    """The current state of an append log (id, graph, name, state, at): the first creation and the last words.

    A blank name is "Untitled query"; a row without id or state is corrupt and skipped.
    """
    rows = log.where("id is not null and state is not null")
    last = F.max_by(F.struct("graph", "name", "state"), F.struct("at", "name", "state"))
    out = rows.groupBy("id").agg(last.alias("l"), F.min("at").alias("createdAt"), F.max("at").alias("updatedAt"))
    name = F.when(F.trim(F.coalesce("l.name", F.lit(""))) == "", "Untitled query").otherwise(F.trim("l.name"))
    return out.select("id", F.col("l.graph").alias("graph"), name.alias("name"), F.col("l.state").alias("state"), "createdAt", "updatedAt")


def saved_query_list(saved: DataFrame, graph: str | None = None) -> DataFrame:
    """Newest first."""
    rows = saved if graph is None else saved.where(F.col("graph") == graph)
    return rows.orderBy(F.desc("updatedAt"), "id")


def saved_query_delete(saved: DataFrame, ids: DataFrame) -> DataFrame:
    return saved.join(ids.select("id"), "id", "left_anti")


def activity_log_append(spark: SparkSession, path: str, rows: list[tuple[str, str, str]] | DataFrame) -> None:
    """Append (type, subject, attributes as JSON) rows with the time; earlier rows are never rewritten.

    A table has the columns ``@type``, subject and attributes, and may bring its own times (``at``).
    """
    frame = rows if isinstance(rows, DataFrame) else spark.createDataFrame(rows, "`@type` string, subject string, attributes string")
    frame = frame if "at" in frame.columns else frame.withColumn("at", F.current_timestamp())
    frame.write.mode("append").json(path)


def activity_log(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a log: type, subject, at, attributes."""
    return spark.read.schema("`@type` string, subject string, at timestamp, attributes string").json(path).withColumnRenamed("@type", "type")


def source_excerpt(texts: DataFrame, text: str, most: int) -> DataFrame:
    """With excerpt, octets, lines, truncated: line ends made uniform, long texts cut at the last line end within ``most``."""
    whole = F.replace(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    rows = texts.withColumn("_whole", whole).withColumn("truncated", F.length("_whole") > most)
    head = F.substring("_whole", 1, most)
    last = F.length(head) - F.instr(F.reverse(head), "\n")
    cut = F.when(F.instr(head, "\n") > 1, F.when(last > 0, F.expr(f"left(left(_whole, {most}), cast(length(left(_whole, {most})) - instr(reverse(left(_whole, {most})), '\n') as int))")).otherwise(head)).otherwise(head)
    rows = rows.withColumn("excerpt", F.when(F.col("truncated"), cut).otherwise(F.col("_whole")))
    lines = F.length("excerpt") - F.length(F.replace("excerpt", F.lit("\n"), F.lit(""))) + 1
    return rows.withColumn("octets", F.octet_length("_whole").cast("long")).withColumn("lines", lines.cast("long")).drop("_whole")


def first_mention(texts: DataFrame, names: DataFrame, *, doc: str, text: str) -> DataFrame:
    """doc, iri, line: the first line (from 1) of a text that mentions each name (iri, prefixed).

    The whole text is searched for the full IRI; only where that is nowhere, for the prefixed form, with a colon put before it if
    it has none.  A mention must not be followed by a character that continues a name; what stands before it is free.
    Names hold no white space, so pieces between white space are cut at every place where a name may end, to every
    length that a name has, and met by equality: cost follows the text and the number of distinct lengths.
    """
    short = F.when(F.col("prefixed").contains(":"), F.col("prefixed")).otherwise(F.concat(F.lit(":"), "prefixed"))
    both = F.array(F.struct(F.lit(0).alias("turn"), F.col("iri").alias("needle")), F.struct(F.lit(1).alias("turn"), F.when(F.col("prefixed") != "", short).alias("needle")))
    needles = names.select("iri", F.explode(both).alias("n")).select("iri", "n.turn", "n.needle").where("needle <> ''").distinct()
    lengths = F.array(*[F.lit(r[0]) for r in sorted(needles.select(F.length("needle")).distinct().collect())]).cast("array<int>")  # at most the longest name
    lines = texts.select(doc, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("at", "line")).where(F.col("line").contains(":"))
    pieces = lines.select(doc, "at", F.explode(F.split("line", r"\s+")).alias("piece")).where(F.col("piece").contains(":"))
    ends = F.filter(F.sequence(F.lit(1), F.length("piece")), lambda e: ~F.col("piece").substr(e + 1, F.lit(1)).rlike(r"[A-Za-z0-9_\-%~]"))
    cut = pieces.select(doc, "at", "piece", F.explode(ends).alias("end")).select(doc, "at", "piece", "end", F.explode(F.filter(lengths, lambda n: n <= F.col("end"))).alias("n"))
    found = cut.select(doc, "at", F.col("piece").substr(F.col("end") - F.col("n") + 1, F.col("n")).alias("needle")).where(F.col("needle").contains(":"))
    best = found.join(needles, "needle").groupBy(doc, "iri").agg(F.min(F.struct("turn", "at")).alias("b"))
    return best.select(doc, "iri", (F.col("b.at") + 1).cast("long").alias("line"))
