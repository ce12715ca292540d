"""Nearest neighbours by learned partitions.

Equal vectors are one point with the ``k + 1`` smallest of their ids: no other copy can be among anyone's k nearest.
Points are cut into cells, level by level.  For every cell to be cut a bounded sample of it (about ``SAMPLE`` points,
lowest id hashes) is taken, its neighbour graph is built and parted in balance: recursive median splits, then moves
of vertices to the part of most of their neighbours, never beyond a part's room.  A small network learns
which parts hold a point's neighbours.  It puts every point of the cell into its most probable part, and sends each query to
the several most probable ones, as many as the sample needed for ``TARGET`` recall, and on until they should hold
``ROOM`` times the points asked for.  All points are cut once, and
cells of more than ``CELL_POINTS`` again, so a cell's size does not grow with the table.
In its cells each query is compared exactly, in double precision, and the cells' lists are merged.  Cells that are cut or
searched are dealt to tasks in bounded slices of their points.

Defined results: null or zero vectors, vectors with null or non-finite parts, and vectors of another than the most
common dimension (ties: the smallest) take no part, nor do rows with a null id; ties go to the smaller id; a query without
candidates gets no row; a row that repeats the query's id is not a candidate of it, and
rows of one id with unlike vectors are queries of their own; fewer than ``SMALLEST`` points
are one cell; columns other than the two named are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.scratch import stash

SAMPLE, GRAPH_K, HIDDEN, TARGET = 8192, 10, 64, 0.985
CELL_POINTS, SLICE_POINTS, SMALLEST, ROOM = 16_384, 8192, 256, 8


@dataclass(frozen=True)
class Router:
    """A one-layer network from vectors to part probabilities, each part's share of the sample, and how many parts a query visits."""

    shift: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    load: np.ndarray
    visits: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.shift) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def nearest(queries: np.ndarray, points: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k nearest points, nearest first."""
    out, norms = [], (points**2).sum(axis=1)
    for at in range(0, len(queries), 512):
        d = norms - 2 * queries[at : at + 512] @ points.T
        near = np.argpartition(d, min(k, d.shape[1] - 1), axis=1)[:, :k]
        out.append(np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out)


def split_balanced(x: np.ndarray, parts: int) -> np.ndarray:
    """Parts of nearly equal size by recursive splits across the widest direction."""
    label = np.zeros(len(x), dtype=np.int64)

    def halve(rows: np.ndarray, first: int, n: int) -> None:
        if n == 1:
            label[rows] = first
            return
        centred = x[rows] - x[rows].mean(axis=0)
        axis = np.ones(x.shape[1])
        gram = centred.T @ centred
        for _ in range(8):
            axis = gram @ axis
            axis /= np.linalg.norm(axis) + 1e-12
        order = rows[np.argsort(centred @ axis, kind="stable")]
        cut = round(len(rows) * (n // 2) / n)
        halve(order[:cut], first, n // 2)
        halve(order[cut:], first + n // 2, n - n // 2)

    halve(np.arange(len(x)), 0, parts)
    return label


def refine(label: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """Move vertices to the part of most of their neighbours while it has room."""
    n, label = len(label), label.copy()
    room = int(np.ceil(slack * n / parts))
    load = np.bincount(label, minlength=parts)
    for _ in range(rounds):
        votes = np.zeros((n, parts), dtype=np.int32)
        np.add.at(votes, (np.repeat(np.arange(n), graph.shape[1]), label[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(label, graph.shape[1])), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), label]
        moved = 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if load[best[v]] < room:
                load[label[v]] -= 1
                load[best[v]] += 1
                label[v] = best[v]
                moved += 1
        if moved < n // 200:
            break
    return label


def train_router(x: np.ndarray, parts: int, *, k: int = 10, seed: int = 3) -> Router:
    """Fit graph, parts and network on sample vectors (distinct rows)."""
    rng, n = np.random.default_rng(seed), len(x)
    graph = nearest(x, x, GRAPH_K + 1)[:, 1:]
    label = refine(split_balanced(x, parts), graph, parts)
    goal = np.zeros((n, parts))
    np.add.at(goal, (np.repeat(np.arange(n), GRAPH_K), label[graph].ravel()), 1.0 / (GRAPH_K + 3))
    goal[np.arange(n), label] += 3.0 / (GRAPH_K + 3)
    shift, scale = x.mean(axis=0), float(x.std() + 1e-9)
    z = (x - shift) / scale
    dims = [(x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN, parts), (parts,)]
    params = [rng.normal(0, np.sqrt(2 / d[0]), d) if len(d) == 2 else np.zeros(d) for d in dims]
    m, v = [np.zeros(d) for d in dims], [np.zeros(d) for d in dims]
    steps = max(600, 24 * n // 256)
    for t in range(1, steps + 1):
        rows = rng.integers(0, n, 256)
        h = np.maximum(z[rows] @ params[0] + params[1], 0)
        out = h @ params[2] + params[3]
        p = np.exp(out - out.max(axis=1, keepdims=True))
        err = (p / p.sum(axis=1, keepdims=True) - goal[rows]) / len(rows)
        back = (err @ params[2].T) * (h > 0)
        for i, g in enumerate((z[rows].T @ back, back.sum(axis=0), h.T @ err, err.sum(axis=0))):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            params[i] = params[i] - 3e-3 * (1 - t / (steps + 1)) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    logits = Router(shift, scale, *params, load=np.zeros(parts), visits=parts).logits(x)
    home, order = logits.argmax(axis=1), np.argsort(-logits, axis=1, kind="stable")
    trial = rng.choice(n, min(n, 1000), replace=False)
    truth = home[nearest(x[trial], x, min(k, n - 1) + 1)[:, 1:]]
    rank = np.argsort(order[trial], axis=1)  # place of each part in the query's order
    needed = np.take_along_axis(rank, truth, axis=1)
    visits = next(i for i in range(1, parts + 1) if i == parts or (needed < i).mean() >= TARGET)
    return Router(shift, scale, *params, load=np.bincount(home, minlength=parts) / n, visits=visits)


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def distinct_points(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Points (point: smallest id, vector, ids: the ``k + 1`` smallest, asks, cell: the one before any cut) and the queries (query_id, point) of equal vectors."""
    by_vector = Window.partitionBy("vector").orderBy("vec_id")
    distinct_ids = vectors.groupBy("vector", "vec_id").agg(F.bool_or("asks").alias("asks"))
    few = distinct_ids.select("vector", "vec_id").withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
    points = few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = distinct_ids.where("asks").select("vector", F.col("vec_id").alias("query_id"))
    points = points.join(asked.select("vector", F.lit(True).alias("asks")).distinct(), "vector", "left")
    points = stash(points.select(F.get("ids", F.lit(0)).alias("point"), "vector", "ids", F.coalesce("asks", F.lit(False)).alias("asks"), F.lit(0).cast("long").alias("cell")), "points")
    return points, stash(asked.join(points.select("vector", "point"), "vector").select("query_id", "point"), "asked")


def _slices(n: Column) -> Column:
    """Into how many slices a cell of ``n`` points is dealt."""
    return F.ceil(n / F.lit(SLICE_POINTS)).cast("int")


def cut_cells(points: DataFrame, asked: DataFrame, cells: DataFrame, dim: int, k: int, level: int) -> tuple[DataFrame, DataFrame]:
    """Points and asked points (point, vector, cell) with the named cells (cell, n) cut into parts.

    A part's cell is numbered ``cell * 1024 + part + 1``.
    """
    kind = points.schema["vector"].dataType.simpleString()
    share = F.least(F.lit(1.0), F.lit(1.2 * SAMPLE) / F.col("n")) * F.lit(1 << 30)
    drawn = points.join(cells, "cell").where(F.pmod(F.xxhash64("point", F.lit(level)), F.lit(1 << 30)) < share).select("cell", "n", "point", "vector")

    def learn(sample: pa.Table) -> pa.Table:
        sample = sample.sort_by("point")
        n, x = sample["n"][0].as_py(), _matrix(sample["vector"].combine_chunks(), dim)
        parts = int(np.clip(min(round(np.sqrt(n) / 8), len(x) // 16), 2, 256))
        return pa.table({"cell": sample["cell"].slice(0, 1), "router": pa.array([pickle.dumps(train_router(x, parts, k=k))], pa.binary())})

    routers = stash(drawn.groupBy("cell").applyInArrow(learn, "cell bigint, router binary"), "routers").join(cells, "cell").withColumn("slices", _slices(F.col("n")))
    dealt_routers = routers.select("cell", "n", "router", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))

    def route(rows: DataFrame, every: bool) -> DataFrame:
        """Each row of a cut cell in its most probable part, or with ``every`` in all parts that a query visits."""

        def run(rows: pa.Table, router: pa.Table) -> pa.Table:
            if not rows.num_rows:
                return rows.select(["point", "vector", "cell"])
            r: Router = pickle.loads(router["router"][0].as_py())
            logits = r.logits(_matrix(rows["vector"].combine_chunks(), dim))
            order = np.argsort(-logits, axis=1, kind="stable")
            before = np.cumsum(r.load[order], axis=1) - r.load[order]  # share of the points in the parts ahead of each
            visit = (np.arange(order.shape[1]) < r.visits) | (before * router["n"][0].as_py() < ROOM * (k + 1)) if every else np.arange(order.shape[1]) < np.ones((len(order), 1))
            at, place = np.nonzero(visit)
            return rows.select(["point", "vector"]).take(pa.array(at)).append_column("cell", pa.array(rows["cell"].to_numpy()[at] * 1024 + order[at, place] + 1))

        inside = rows.join(routers.select("cell", "slices"), "cell").select("point", "vector", "cell", F.pmod(F.xxhash64("point"), F.col("slices")).cast("int").alias("slice"))
        moved = inside.groupBy("cell", "slice").cogroup(dealt_routers.groupBy("cell", "slice")).applyInArrow(run, f"point bigint, vector {kind}, cell bigint")
        return stash(rows.join(cells.select("cell"), "cell", "left_anti").select("point", "vector", "cell").unionByName(moved), "routed")

    return route(points, False), route(asked, True)


def search(rows: DataFrame, is_query: Column, *, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the k nearest found of every query row."""
    spark = rows.sparkSession
    vectors = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    dim = vectors.agg(F.mode(F.size("vector"), True)).first()[0]
    if dim is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    points, queries = distinct_points(vectors.where(F.size("vector") == dim), k)

    placed, asked = points.select("point", "vector", "cell"), stash(points.where("asks").select("point", "vector", "cell"), "asking")
    for level in range(6):
        sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        large = stash(sizes.where(F.col("n") > (CELL_POINTS if level else SMALLEST - 1)), "cells")
        if large.isEmpty():
            break
        placed, asked = cut_cells(placed, asked, large, dim, k, level)

    slices = stash(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", _slices(F.col("n")).alias("slices")), "slices")
    asked = asked.join(slices, "cell").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select("cell", "slice", "point", "vector")
    candidates = placed.join(slices, "cell").select("cell", F.pmod(F.xxhash64("point"), F.col("slices")).cast("int").alias("slice"), "point", "vector")

    def compare(queries: pa.Table, points: pa.Table) -> pa.Table:
        """Each query's ``k + 1`` nearest points of a slice, itself among them; ties: the smaller id."""
        empty = {"query": pa.array([], pa.int64()), "point": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        if not queries.num_rows or not points.num_rows:
            return pa.table(empty)
        q, c = _matrix(queries["vector"].combine_chunks(), dim), _matrix(points["vector"].combine_chunks(), dim)
        q_ids, c_ids = queries["point"].to_numpy(), points["point"].to_numpy()
        norms, found = (c**2).sum(axis=1), []
        most = min(k + 1, len(c))
        for at in range(0, len(q), 256):
            block = q[at : at + 256]
            own = (block**2).sum(axis=1)
            d = own[:, None] + norms - 2 * block @ c.T
            kth = np.partition(d, most - 1, axis=1)[:, most - 1]
            slack = 1e-9 * (own + norms.max() + 1)
            for i in range(len(block)):
                near = np.flatnonzero(d[i] <= kth[i] + slack[i])
                exact = np.sqrt(((c[near] - block[i]) ** 2).sum(axis=1))
                best = np.lexsort((c_ids[near], exact))[: k + 1]
                found.append((np.full(len(best), q_ids[at + i]), c_ids[near[best]], exact[best]))
        columns = [np.concatenate(f) for f in zip(*found, strict=True)]
        return pa.table(dict(zip(empty, columns, strict=True)))

    near = asked.groupBy("cell", "slice").cogroup(candidates.groupBy("cell", "slice")).applyInArrow(compare, "query bigint, point bigint, score double")
    best = near.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("score", "point"))).where(F.col("n") <= k + 1)
    ids = best.join(points.select("point", "ids"), "point").select("query", "score", F.explode("ids").alias("vec_id"))
    listed = ids.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("n") <= k + 1)
    own = queries.join(listed.drop("n"), queries["point"] == listed["query"]).where("vec_id <> query_id").select("query_id", "point", "vec_id", "score")
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "point").orderBy("score", "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
