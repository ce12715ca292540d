"""Reachability over written tables: step by step, then by doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.tables import written


#: Steps taken one by one; longer paths are found by doubling.
SINGLE_STEPS = 40


def path_closure(edges: DataFrame, seeds: DataFrame | None = None, *, reflexive: bool = False, max_depth: int | None = None) -> DataFrame:
    """graph, start, node, depth: distinct pairs reachable over (graph, a, b), with the fewest steps.

    ``seeds`` (graph, start) bounds where paths begin; without it every left end begins one.  Cycles end by
    themselves, and there is no limit to the depth: after ``SINGLE_STEPS`` rounds of one step, jumps double every round.
    ``max_depth`` stops after so many steps by intent.
    """
    edges = written(edges.select("graph", "a", "b").distinct(), "closure-edges")
    starts = edges.select("graph", F.col("a").alias("start")) if seeds is None else seeds.select("graph", "start")
    starts = starts.distinct()
    step = starts.join(edges.withColumnRenamed("a", "start"), ["graph", "start"]).select("graph", "start", F.col("b").alias("node"), F.lit(1).alias("depth"))
    frontier = written(step.distinct(), "closure")
    levels, depth = [frontier], 1
    while not frontier.isEmpty():
        if max_depth is not None and depth >= max_depth:
            break
        if depth >= SINGLE_STEPS:
            levels = [_doubled(edges, levels[0] if len(levels) == 1 else written(_union(levels), "closure"), depth)]
            if max_depth is not None:
                levels = [levels[0].where(F.col("depth") <= max_depth)]
            break
        depth += 1
        onward = frontier.join(edges.withColumnRenamed("a", "node"), ["graph", "node"]).select("graph", "start", F.col("b").alias("node"), F.lit(depth).alias("depth")).distinct()
        for seen in levels:
            onward = onward.join(seen.select("graph", "start", "node"), ["graph", "start", "node"], "left_anti")
        frontier = written(onward, "closure")
        levels.append(frontier)
        if len(levels) > 8:  # few tables to look through
            levels = [written(_union(levels), "closure"), frontier.limit(0)]
    pairs = _union(levels)
    if reflexive:
        zero = starts.select("graph", "start", F.col("start").alias("node"), F.lit(0).alias("depth"))
        pairs = zero.unionByName(pairs.join(zero.select("graph", "start", "node"), ["graph", "start", "node"], "left_anti"))
    return pairs


def _doubled(edges: DataFrame, found: DataFrame, depth: int) -> DataFrame:
    """All pairs, given those of up to ``depth`` steps.

    Found pairs of up to d steps followed by walks of exactly j <= d steps are those of up to d + j; walks double each round.
    A round that finds no pair ends it: one further away would have one on its way there.
    """
    jump, length = edges, 1
    while length * 2 <= depth:
        jump, length = _twice(jump), length * 2
    n, before = found.count(), -1
    while n != before:
        ahead = found.join(jump.withColumnRenamed("a", "node"), ["graph", "node"]).select("graph", "start", F.col("b").alias("node"), (F.col("depth") + length).alias("depth"))
        found = written(found.select("graph", "start", "node", "depth").unionByName(ahead).groupBy("graph", "start", "node").agg(F.min("depth").alias("depth")), "closure")
        depth += length
        n, before = found.count(), n
        while n != before and length * 2 <= depth:
            jump, length = _twice(jump), length * 2
    return found


def _twice(jump: DataFrame) -> DataFrame:
    onward = jump.select("graph", F.col("b").alias("mid"), F.col("a").alias("first"))
    return written(onward.join(jump.withColumnRenamed("a", "mid"), ["graph", "mid"]).select("graph", F.col("first").alias("a"), "b").distinct(), "jump")


def chain_closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """graph, start, node: the seeds (graph, start) and all they reach, for chains (each left end has one right end, or few).

    Jumps double every round, so a chain of n cells takes log2 n rounds whatever its length; cycles end by themselves.
    """
    jump = written(edges.select("graph", "a", "b").distinct(), "jump")
    found = written(seeds.select("graph", "start").distinct().withColumn("node", F.col("start")), "chain")
    n, before = found.count(), -1
    while n != before:
        ahead = found.join(jump.withColumnRenamed("a", "node"), ["graph", "node"]).select("graph", "start", F.col("b").alias("node"))
        found = written(found.unionByName(ahead).distinct(), "chain")
        jump = _twice(jump)
        n, before = found.count(), n
    return found


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def path_zero_or_one(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """graph, start, node: each seed itself or one step, distinct."""
    seeds = seeds.select("graph", "start").distinct()
    one = seeds.join(edges.select("graph", F.col("a").alias("start"), F.col("b").alias("node")), ["graph", "start"])
    return one.unionByName(seeds.withColumn("node", F.col("start"))).distinct()
