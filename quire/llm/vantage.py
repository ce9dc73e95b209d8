"""Nearest neighbours by vantage-point trees of shards.

A tree over a bounded sample deals all rows to shards: at each of its nodes a row goes to the inner side
if its distance to the node's vantage point is at most the median, else to the outer side. Leaves with
more rows than a shard takes are split by a hash of the row. Each shard has a tree of the same kind over all its rows.

A query first searches the shard it lies in, which gives it a radius: the distance of its k-th
nearest row so far. By the triangle inequality no row within the radius lies beyond a vantage point's
sphere by more than the radius, so a side is skipped if ``factor`` times the gap exceeds the radius, in the upper tree, which tells the
other shards to visit, as in those of the shards. Factor 1 is exact; a greater one skips more.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .registry import register
from .vectors import Heaps, matrix, streamed, usable

K = 10
FACTOR = 1.5                # of the gap: 1 is exact
SAMPLE_BYTES = 8 << 20      # of vectors that the upper tree is fitted on
SHARD_BYTES = 4 << 20       # of the vectors of a shard
LEAF = 128                  # rows of a leaf in a shard
TRIALS = 8                  # vantage points tried at a node
SLACK = 1e-9                # relative, against rounding in bounds only


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances row by row, or of rows to one vector."""
    gap = x - y
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


@dataclass
class Node:
    """A vantage point with the least and greatest distance to it on both sides, or a leaf's number and rows."""
    point: np.ndarray | None = None
    ranges: tuple = ()
    sides: tuple = ()
    split: float = 0.0
    leaf: int = -1
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def build(x: np.ndarray, leaf: int, open_ranges: bool = False) -> tuple[Node, int]:
    """The tree over the rows of x, leaves of at most ``leaf`` rows unless more are equal, and how many leaves it has. Of a few
    points that tried as vantage point is taken whose distances spread most. ``open_ranges`` is for trees that take rows they were not built on."""
    rng, count = np.random.default_rng(len(x)), 0

    def made(rows: np.ndarray) -> Node:
        nonlocal count
        if len(rows) > leaf:
            tried = [x[i] for i in rng.choice(rows, min(TRIALS, len(rows)), replace=False)]
            some = rng.choice(rows, min(256, len(rows)), replace=False)
            point = max(tried, key=lambda p: float(np.var(distances(x[some], p))))
            d = distances(x[rows], point)
            split = float(np.median(d))
            inner = d <= split
            if inner.all():  # the upper half is one distance: split below it
                split = float(d[d < split].max(initial=-1.0))
                inner = d <= split
            if inner.any():
                ranges = ((0.0, split), (split, np.inf)) if open_ranges else (
                    (float(d[inner].min()), float(d[inner].max())), (float(d[~inner].min()), float(d[~inner].max())))
                return Node(point, ranges, (made(rows[inner]), made(rows[~inner])), split)
        count += 1
        return Node(leaf=count - 1, rows=rows)

    root = made(np.arange(len(x)))
    return root, count


def skips(d: np.ndarray, limits: tuple[float, float], radius: np.ndarray, factor: float) -> np.ndarray:
    """Which queries at distance d of the vantage point need not visit rows whose distances lie within the limits."""
    gap = np.maximum(np.maximum(limits[0] - d, d - limits[1]), 0)
    return gap * factor > radius + SLACK * (d + np.where(np.isfinite(radius), radius, 0))


def leaf_of(root: Node, x: np.ndarray) -> np.ndarray:
    """The leaf that each row belongs to."""
    out = np.zeros(len(x), np.int64)

    def down(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.point is None:
            out[rows] = node.leaf
            return
        inner = distances(x[rows], node.point) <= node.split
        down(node.sides[0], rows[inner])
        down(node.sides[1], rows[~inner])

    down(root, np.arange(len(x)))
    return out


def leaves_within(root: Node, x: np.ndarray, radius: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf): the leaves that each query has to visit."""
    at, leaves = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def down(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.point is None:
            at.append(rows)
            leaves.append(np.full(len(rows), node.leaf))
            return
        d = distances(x[rows], node.point)
        for side, limits in zip(node.sides, node.ranges):
            down(side, rows[~skips(d, limits, radius[rows], factor)])

    down(root, np.arange(len(x)))
    return np.concatenate(at), np.concatenate(leaves)


def search(root: Node, x: np.ndarray, ids: np.ndarray, nodes: np.ndarray, q: np.ndarray, own: np.ndarray, radius: np.ndarray,
           k: int, factor: float) -> Heaps:
    """The k nearest rows of x of each query, itself (by node) left out, none beyond its radius. Each query goes down its own side first."""
    best, square = Heaps(len(q), k, np.float64), (x * x).sum(1)
    radius, q_square = radius.copy(), (q * q).sum(1)

    def scan(rows: np.ndarray, members: np.ndarray) -> None:
        product = q_square[rows][:, None] + square[members][None] - 2 * (q[rows] @ x[members].T)
        slack = SLACK * (q_square[rows] + square[members].max())
        product[own[rows][:, None] == nodes[members][None]] = np.inf
        limit = radius[rows] ** 2
        if len(members) > k:
            limit = np.minimum(limit, np.partition(product, k - 1, 1)[:, k - 1])
        r, c = np.nonzero(product <= (limit + slack)[:, None])
        d = distances(q[rows[r]], x[members[c]])
        near = (d <= radius[rows[r]]) & (own[rows[r]] != nodes[members[c]])
        best.push(rows[r[near]], d[near], ids[members[c[near]]], nodes[members[c[near]]])
        radius[:] = np.minimum(radius, best.worst(np.inf))

    def down(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.point is None:
            scan(rows, node.rows)
            return
        d = distances(q[rows], node.point)
        inner = d <= node.split
        for own_side in (True, False):
            for side, limits, here in zip(node.sides, node.ranges, (inner, ~inner)):
                go = here == own_side
                down(side, rows[go][~skips(d[go], limits, radius[rows[go]], factor)])

    down(root, np.arange(len(q)))
    return best


def _upper_trees(rows: DataFrame, shard_bytes: int, sample_bytes: int) -> dict[int, Node]:
    """By vector length, the tree that deals rows to leaves. It is fitted on the rows whose hash falls under a share, about ``sample_bytes`` in all."""
    total = rows.agg(F.sum("d").alias("numbers")).first().numbers
    if not total:
        return {}
    share = min(1.0, sample_bytes / (8 * total))
    sample = rows.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("d", "x").collect()
    trees = {}
    for d in {r.d for r in sample}:
        x = np.array([np.frombuffer(r.x, np.float64) for r in sample if r.d == d])
        shards = min(-(-x.nbytes // (shard_bytes * share)), max(1, len(x) // 16))
        trees[d] = build(x, -(-len(x) // int(shards)), open_ranges=True)[0]
    return trees


def _by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    d = batch.column("d").to_numpy()
    for n in np.unique(d):
        at = np.flatnonzero(d == n)
        yield int(n), at, matrix(batch.column("x").take(pa.array(at)), np.float64)


def _dealt(rows: DataFrame, trees: dict[int, Node]) -> DataFrame:
    """A column more: the leaf of the upper tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = np.zeros(batch.num_rows, np.int64)
            for d, at, x in _by_dimension(batch):
                if d in trees:
                    leaves[at] = leaf_of(trees[d], x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves)], names=[*batch.schema.names, "leaf"])
    return rows.mapInArrow(run, "node long, id long, asks boolean, d long, x binary, leaf long")


def _visits(queries: DataFrame, trees: dict[int, Node], factor: float) -> DataFrame:
    """The queries once for each leaf within their radius."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in _by_dimension(batch):
                radius = batch.column("radius").to_numpy()[at]
                rows, leaves = leaves_within(trees[d], x, radius, factor) if d in trees else (np.arange(len(at)), np.zeros(len(at), np.int64))
                part = batch.take(pa.array(at[rows]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "id", "d", "x", "radius", "home")), pa.array(leaves)],
                                                 names=["node", "id", "d", "x", "radius", "home", "leaf"])
    return queries.mapInArrow(run, "node long, id long, d long, x binary, radius double, home struct<leaf:long,part:long>, leaf long")


def _searched(shards: DataFrame, queries: DataFrame, k: int, factor: float, leaf: int) -> DataFrame:
    """(node, query_id, vec_id, score, other): the k nearest of each query in each of its shards."""
    def work(held: dict):
        x, ids, nodes = matrix(held["x"], np.float64), held["id"].to_numpy(), held["node"].to_numpy()
        root, _ = build(x, leaf)

        def ask(part: dict) -> Iterator[pa.RecordBatch]:
            q, node, query = matrix(part["x"], np.float64), part["node"].to_numpy(), part["id"]
            best = search(root, x, ids, nodes, q, node, part["radius"].to_numpy(), k, factor)
            g = pa.array(best.group)
            yield pa.RecordBatch.from_arrays([part["node"].take(g), query.take(g), pa.array(best.id), pa.array(best.key), pa.array(best.node)],
                                             names=["node", "query_id", "vec_id", "score", "other"])
        return ask

    columns = ["node", "id", "d", "x", "leaf", "part", "radius"]
    return streamed(shards.withColumn("radius", F.lit(0.0)).select(columns), queries.select(columns), ["d", "leaf", "part"], work,
                    "node long, query_id long, vec_id long, score double, other long")


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", is_query: str | Column = "vec_id % 100 = 0", k: int = K,
            factor: float = FACTOR, shard_bytes: int = SHARD_BYTES, sample_bytes: int = SAMPLE_BYTES, leaf: int = LEAF) -> DataFrame:
    """The ``k`` nearest rows of each query row: query_id, rank (from 1), vec_id, score (Euclidean distance in double precision).

    Queries are the rows for which ``is_query`` holds; candidates are all rows but the query's own, nearest first, ties to the
    smaller id; all candidates, if fewer than k. With ``factor`` 1 the result is exact; a greater one may miss some
    rows, but scores are exact always. Rows whose id or vector is null, and vectors that are empty,
    zero or hold null or non-finite components, take no part. Vectors of different lengths are not comparable: a query
    finds rows of its own length. A repeated row is a candidate like any other and, as a query, gives its rows again. Other
    columns are read by ``is_query`` alone. An empty table gives no rows.
    """
    asks = F.expr(is_query) if isinstance(is_query, str) else is_query
    rows = vectors.filter(F.col(id_col).isNotNull()).select(
        F.monotonically_increasing_id().alias("node"), F.col(id_col).cast("long").alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"),
        F.col(vector_col).alias("v"))
    rows = written(usable(rows, zeros=False), "vectors")
    trees = _upper_trees(rows, shard_bytes, sample_bytes)
    placed = _dealt(rows, trees)
    parts = written(placed.groupBy("d", "leaf").agg(F.ceil(F.sum("d") * 8 / shard_bytes).alias("parts")), "leaves")
    shards = written(placed.join(parts, ["d", "leaf"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts")).drop("parts"), "shards")
    queries = shards.filter("asks").select("node", "id", "d", "x", "leaf", "part")
    near = written(_searched(shards, queries.withColumn("radius", F.lit(float("inf"))), k, factor, leaf), "near")
    reach = near.groupBy("node").agg(F.when(F.count(F.lit(1)) >= k, F.max("score")).alias("radius"))
    queries = queries.join(reach, "node", "left").select(
        "node", "id", "d", "x", F.coalesce("radius", F.lit(float("inf"))).alias("radius"), F.struct("leaf", "part").alias("home"))
    others = (_visits(queries, trees, factor).join(parts, ["d", "leaf"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
              .filter((F.col("home.leaf") != F.col("leaf")) | (F.col("home.part") != F.col("part"))))
    found = near.union(_searched(shards, others, k, factor, leaf))
    order = Window.partitionBy("node").orderBy("score", "vec_id", "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@register("op12_vantage_neighbours")
def op12_vantage_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
