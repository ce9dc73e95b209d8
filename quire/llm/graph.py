"""Connected components by random contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

FEW = 10_000  # edges that one task contracts to the end


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, to) for each end of a few edges (a, b): the least node reachable."""
    parts = [np.stack([b.column("a").to_numpy(), b.column("b").to_numpy()]) for b in batches if b.num_rows]
    if not parts:
        return
    nodes, ends = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    to, (a, b) = np.arange(len(nodes)), ends.reshape(2, -1)
    while (to[a] != to[b]).any():
        least = np.minimum(to[a], to[b])
        for end in (a, b):
            np.minimum.at(to, to[end], least)
        while (to[to] != to).any():
            to = to[to]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[to])], names=["a", "to"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each end of ``edges`` (a, b), both long: equal roots are one component.

    In each round a node moves to that node among itself and its neighbours that comes first
    in an order (the first round's is that of the numbers, then each round draws one), and
    edges are drawn between the nodes moved to; a constant share of the nodes goes in each
    round. Minima are combined before the shuffle, so a node with very many edges is no hot group. The last
    ``FEW`` edges are contracted by one task, however many there were.
    """
    edges = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    roots = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node"))
    step = 0
    while n := edges.count():
        if n <= FEW:
            moves = edges.coalesce(1).mapInArrow(_contracted, "a long, to long")
            roots = roots.join(moves.select(F.col("a").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            break
        rank = lambda c, k=step: F.struct((F.xxhash64(F.lit(k), c) if k else F.col(c)).alias("h"), F.col(c).alias("node"))
        best = edges.union(edges.select("b", "a")).groupBy("a").agg(F.min(rank("b")).alias("m"))
        moves = written(best.select("a", F.least("m", rank("a"))["node"].alias("to")), "moves")
        left = moves.select(F.col("a"), F.col("to").alias("a2"))
        right = moves.select(F.col("a").alias("b"), F.col("to").alias("b2"))
        roots = roots.join(left.select(F.col("a").alias("root"), F.col("a2").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        edges = written(edges.join(left, "a").join(right, "b").filter("a2 <> b2")
                        .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
        step += 1
    return written(roots, "roots")
