"""Directed graphs in few rounds: the least value that reaches a node, and strongly connected components.

Graphs are tables (graph, a, b) of any number of graphs; every round is a join on written tables whose rows are at most
those of the edges.  Chains, however long, take a logarithmic number of rounds: a node with a single predecessor points to it,
and pointers double until each leads to a node with none or several, or round a cycle.  What is left is the graph of those
nodes, treated in the same way.

Up to ``LOCAL_EDGES`` edges in all, a count made before, each graph is settled in one task.
"""

from __future__ import annotations

from math import log2

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.tables import written

LOCAL_EDGES = 50_000
VALUE = "graph string, node string, rank int, id string"


def _in_order(edges: list[tuple[str, str]], nodes: list[str]) -> list[list[str]]:
    """Strongly connected components, each before those it is reached from (depth first, without recursion)."""
    onward: dict[str, list[str]] = {n: [] for n in nodes}
    for a, b in edges:
        onward[a].append(b)
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    held: list[str] = []
    inside: set[str] = set()
    out: list[list[str]] = []
    for root in nodes:
        if root in number:
            continue
        walk = [(root, iter(onward[root]))]
        number[root] = low[root] = len(number)
        held.append(root)
        inside.add(root)
        while walk:
            node, rest = walk[-1]
            nxt = next(rest, None)
            if nxt is None:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == number[node]:
                    part = []
                    while not part or part[-1] != node:
                        part.append(held.pop())
                        inside.discard(part[-1])
                    out.append(part)
            elif nxt not in number:
                number[nxt] = low[nxt] = len(number)
                held.append(nxt)
                inside.add(nxt)
                walk.append((nxt, iter(onward[nxt])))
            elif nxt in inside:
                low[node] = min(low[node], number[nxt])
    return out


def _local_least(key: tuple, edges: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
    value = {n: (r, i) for n, r, i in zip(values["node"], values["rank"], values["id"], strict=True)}
    pairs = [(a, b) for a, b in zip(edges["a"], edges["b"], strict=True) if a in value and b in value]
    before: dict[str, list[str]] = {}
    for a, b in pairs:
        before.setdefault(b, []).append(a)
    for part in reversed(_in_order(pairs, list(value))):
        least = min(value[m] for n in part for m in (n, *before.get(n, ())))
        value.update(dict.fromkeys(part, least))
    return pd.DataFrame({"graph": [key[0]] * len(value), "node": list(value), "rank": [r for r, _ in value.values()], "id": [i for _, i in value.values()]})


def _local_components(key: tuple, edges: pd.DataFrame) -> pd.DataFrame:
    pairs = list(zip(edges["a"], edges["b"], strict=True))
    parts = [p for p in _in_order(pairs, sorted({n for pair in pairs for n in pair})) if len(p) > 1]
    return pd.DataFrame({"graph": [key[0]] * sum(map(len, parts)), "node": [n for p in parts for n in p], "component": [min(p) for p in parts for _ in p]}, dtype="object")


def distinct_edges(edges: DataFrame) -> DataFrame:
    """The edges between different nodes, written."""
    return written(edges.select("graph", "a", "b").where("a <> b").distinct(), "edges")


def least_reaching(edges: DataFrame, values: DataFrame) -> DataFrame:
    """graph, node, rank, id: the least (rank, id) among the nodes that reach each node of ``values``, itself included.

    ``edges`` (graph, a, b) lead from a to b; ``values`` (graph, node, rank, id) has each node once.
    """
    edges = distinct_edges(edges)
    if edges.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES:
        return edges.groupBy("graph").cogroup(values.select("graph", "node", F.col("rank").cast("int").alias("rank"), "id").groupBy("graph")).applyInPandas(_local_least, VALUE)
    found = _least(edges, values.select("graph", "node", F.struct(F.col("rank").cast("int").alias("rank"), "id").alias("value")))[0]
    return found.select("graph", "node", "value.rank", "value.id")


def _relax(edges: DataFrame, values: DataFrame) -> DataFrame:
    """Values sent along edges until none gets less; only nodes whose value went down send again."""
    labels = written(values, "labels")
    changed = labels
    while True:
        sent = edges.join(changed.withColumnRenamed("node", "a"), ["graph", "a"]).groupBy("graph", F.col("b").alias("node")).agg(F.min("value").alias("sent"))
        changed = written(sent.join(labels, ["graph", "node"]).where("sent < value").select("graph", "node", F.col("sent").alias("value")), "changed")
        if changed.isEmpty():
            return labels
        both = labels.join(changed.withColumnRenamed("value", "less"), ["graph", "node"], "left")
        labels = written(both.select("graph", "node", F.coalesce("less", "value").alias("value")), "labels")


def _chains(edges: DataFrame, values: DataFrame) -> tuple[DataFrame, bool]:
    """graph, node, top, value, round_: for each node with one predecessor the first node above that has none or several, and
    the least value on the way to it (without that node's); ``round_`` where the way only goes round.  And whether there are any."""
    single = edges.groupBy("graph", F.col("b").alias("node")).agg(F.min("a").alias("top"), F.max("a").alias("last")).where("top = last").drop("last")
    chain = written(single.join(values, ["graph", "node"]).withColumn("round_", F.lit(True)), "chain")
    n = chain.count()
    for _ in range(int(log2(n)) + 2 if n else 0):  # then every way has been gone to its end, or all round
        ahead = chain.select("graph", F.col("node").alias("top"), F.col("top").alias("next"), F.col("value").alias("more"))
        both = chain.join(ahead, ["graph", "top"], "left")
        chain = written(both.select("graph", "node", F.coalesce("next", "top").alias("top"), F.least("value", "more").alias("value"), F.col("next").isNotNull().alias("round_")), "chain")
        if chain.where("round_").isEmpty():
            break
    return chain, n > 0


def _least(edges: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Least values (graph, node, value), and the nodes (graph, node) known to lie below no cycle."""
    values = written(values, "values")
    chain, some = _chains(edges, values)
    headed = edges.select("graph", F.col("b").alias("node"))
    sources = values.select("graph", "node").join(headed, ["graph", "node"], "left_anti")
    if not some:
        return _relax(edges, values), sources
    hubs = values.join(chain.select("graph", "node"), ["graph", "node"], "left_anti")
    into = edges.join(hubs.select("graph", F.col("node").alias("b")), ["graph", "b"], "left_semi")
    ways = into.join(chain.select("graph", F.col("node").alias("a"), "top", "value", "round_"), ["graph", "a"], "left")
    ways = ways.select("graph", "b", F.when(F.col("round_").isNull(), F.col("a")).when(~F.col("round_"), F.col("top")).alias("a"), F.col("value").alias("passed"))
    ways = written(ways, "ways")
    passed = ways.groupBy("graph", F.col("b").alias("node")).agg(F.min("passed").alias("passed"))
    base = hubs.join(passed, ["graph", "node"], "left").select("graph", "node", F.least("value", "passed").alias("value"))
    above = written(ways.where("a is not null and a <> b").select("graph", "a", "b").distinct(), "above")
    labels = written(base if above.isEmpty() else _least(above, base)[0], "labels")
    tops = labels.select("graph", F.col("node").alias("top"), F.col("value").alias("highest"))
    below = chain.join(tops, ["graph", "top"], "left").select("graph", "node", F.when(F.col("round_"), F.col("value")).otherwise(F.least("value", "highest")).alias("value"))
    free = chain.where("not round_").join(sources.withColumnRenamed("node", "top"), ["graph", "top"], "left_semi").select("graph", "node")
    return labels.unionByName(below), sources.unionByName(free)


def strong_components(edges: DataFrame) -> DataFrame:
    """graph, node, component: the nodes of components of two nodes or more, with the smallest node of each.

    A round gives every node a random number, new in each round, and finds the least that reaches it and the least it
    reaches.  Where both are the same they are the component's own.  Nodes that differ in either are in different
    components, so edges between them go, as do nodes below or above no cycle; the rest is the next round's.  The
    expected number of rounds is logarithmic.
    """
    edges = distinct_edges(edges)
    if edges.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES:
        return edges.groupBy("graph").applyInPandas(_local_components, "graph string, node string, component string")
    found, turn = [], 0
    while not edges.isEmpty():
        turn += 1
        nodes = edges.select("graph", F.explode(F.array("a", "b")).alias("node")).distinct()
        values = written(nodes.withColumn("value", F.struct(F.xxhash64("node", F.lit(turn)).alias("rank"), F.col("node").alias("id"))), "numbers")
        down, above = _least(edges, values)
        up, below = _least(written(edges.select("graph", F.col("b").alias("a"), F.col("a").alias("b")), "turned"), values)
        free = above.unionByName(below).distinct().withColumn("free", F.lit(True))
        both = down.withColumnRenamed("value", "f").join(up.withColumnRenamed("value", "g"), ["graph", "node"]).join(free, ["graph", "node"], "left")
        marks = written(both.where("free is null").select("graph", "node", "f", "g"), "marks")
        settled = marks.where("f = g")
        found.append(written(settled.join(settled.groupBy("graph", "f").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n")).where("n > 1"), ["graph", "f"]).select("graph", "node", "component"), "strong"))
        open_ = marks.where("f <> g")
        ends = lambda name: open_.select("graph", F.col("node").alias(name), F.struct("f", "g").alias(f"m{name}"))
        edges = written(edges.join(ends("a"), ["graph", "a"]).join(ends("b"), ["graph", "b"]).where("ma = mb").select("graph", "a", "b"), "edges")
    out = edges.sparkSession.createDataFrame([], "graph string, node string, component string")
    for part in found:
        out = out.unionByName(part)
    return out
