"""Tables written in buckets by node, so that a lookup of some nodes reads only their buckets and moves nothing but hits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a bucket, about, and how many buckets there are at least and at most.
BUCKET_ROWS, FEWEST, MOST = 50_000, 8, 4_096
#: Wanted nodes that are sent to all tasks; more are joined by a shuffle.
MAX_WANTED = 20_000
#: Statements of a share of the nodes, about, and how many shares there are at most: all triples are read for each.
SHARE_ROWS, MOST_SHARES = 8_000_000, 3
#: Slots with so many statements more than the mean hold a hub, whose statements no task takes whole.
HUB_ROWS = 50_000
#: Whether a node, by the name of its column, belongs to a share.
Share = Callable[[str], Column]


def bucket_count(rows: int) -> int:
    """A power of two."""
    n = FEWEST
    while n < MOST and n * BUCKET_ROWS < rows:
        n *= 2
    return n


def bucket(node: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64("graph", node), F.lit(buckets)).cast("int")


def bucketed(frame: DataFrame, node: str, buckets: int) -> DataFrame:
    """``frame`` with ``bucket``, ready to be written by it; a bucket with a hub is several files."""
    return frame.withColumn("bucket", bucket(node, buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "graph", node)


@dataclass(frozen=True)
class Table:
    """Rows by (graph, ``node``); ``buckets`` is None for a table that is not written in buckets."""

    rows: DataFrame
    node: str
    buckets: int | None = None

    def of(self, wanted: DataFrame) -> DataFrame:
        """The rows of the ``wanted`` nodes (graph, and the node under its own name; other columns are kept)."""
        rows = self.rows
        if self.buckets:
            used = dict(wanted.groupBy(bucket(self.node, self.buckets)).count().collect())  # at most ``MOST`` numbers
            rows = rows.where(F.col("bucket").isin(list(used)) if used else F.lit(False)).drop("bucket")
            few = sum(used.values()) <= MAX_WANTED
        else:
            few = wanted.limit(MAX_WANTED + 1).count() <= MAX_WANTED
        wanted = wanted.withColumnsRenamed({"graph": "_graph", self.node: "_node"})
        return rows.join(F.broadcast(wanted) if few else wanted, (F.col("graph") == F.col("_graph")) & (F.col(self.node) == F.col("_node"))).drop("_graph", "_node")


def both_ends(edges: DataFrame) -> DataFrame:
    """graph, node, other, forward, kind, label: every edge at both its ends (a loop at one)."""
    end = lambda a, b, forward: F.struct(F.col(a).alias("node"), F.col(b).alias("other"), F.lit(forward).alias("forward"))
    both = F.when(F.col("source") == F.col("target"), F.array(end("source", "target", True))).otherwise(F.array(end("source", "target", True), end("target", "source", False)))
    return edges.select("graph", "kind", "label", F.explode(both).alias("e")).select("graph", "e.*", "kind", "label")


def edge_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``both_ends`` with other_kind and other_degree."""
    known = nodes.select("graph", F.col("id").alias("other"), F.col("kind").alias("other_kind"), F.col("degree").alias("other_degree"))
    return both_ends(edges).join(known, ["graph", "other"]).select("graph", "node", "other", "other_kind", "other_degree", "forward", "kind", "label")


def statements(triples: DataFrame) -> DataFrame:
    """graph, id, direction, p, value, listed: every statement at its subject and, where it is no literal, at its object."""
    out = triples.select("graph", F.col("s").alias("id"), F.lit("out").alias("direction"), "p", F.col("o").alias("value"), F.lit(True).alias("listed"))
    into = triples.where("o_kind <> 'literal'").select("graph", F.col("o").alias("id"), F.lit("in").alias("direction"), "p", F.col("s").alias("value"), (F.col("s_kind") == "iri").alias("listed"))
    return out.unionByName(into)


def node_shares(triples: DataFrame) -> tuple[list[Share], Share | None]:
    """Shares of the nodes with statements in like number, and one of the nodes in slots that hold hubs, if there are any.

    Statements are counted by ``MOST`` slots of a hash, so a node outside the hubs' slots has at most ``HUB_ROWS`` more than
    one in ``MOST`` of all statements.
    """
    at = F.explode(F.array(bucket("s", MOST), F.when(F.col("o_kind") != "literal", bucket("o", MOST))))
    counts = triples.select(at.alias("slot")).where("slot is not null").groupBy("slot").count().collect()
    most = sum(n for _, n in counts) // MOST + HUB_ROWS
    hubs, rest = [slot for slot, n in counts if n > most], sum(n for _, n in counts if n <= most)
    shares = min(max(-(-rest // SHARE_ROWS), 1), MOST_SHARES)

    def share(k: int) -> Share:
        return lambda node: (bucket(node, MOST) % shares == k) & ~bucket(node, MOST).isin(hubs)

    return [share(k) for k in range(shares)], (lambda node: bucket(node, MOST).isin(hubs)) if hubs else None


def statements_of(triples: DataFrame, share: Share) -> DataFrame:
    """``statements`` of the nodes of a share; the triples are read once."""
    row = lambda node, way, value, listed: F.struct(F.col(node).alias("id"), F.lit(way).alias("direction"), "p", F.col(value).alias("value"), listed.alias("listed"))
    held = lambda node: F.col("graph").isNotNull() & F.col(node).isNotNull() & share(node)
    out, into = held("s"), (F.col("o_kind") != "literal") & held("o")
    both = F.array(F.when(out, row("s", "out", "o", F.lit(True))), F.when(into, row("o", "in", "s", F.col("s_kind") == "iri")))
    return triples.where(out | into).select("graph", F.explode(both).alias("e")).where("e is not null").select("graph", "e.*")
