"""Epsilon grid order join of embeddings.

Cosine >= c between unit vectors is a distance of at most sqrt(2 - 2c). Vectors
are rotated to principal axes and sorted by the cells of a grid on the leading
ones. The sequence is cut into blocks, and an interval tree over the blocks keeps, per
interval, the box of the leading coordinates and the range of the norm of
the rest. Pairs of intervals are joined recursively from the root: a pair whose
boxes and norms are provably farther apart than the limit is skipped with
all that lies below it. Blocks lie in the shared folder once, and a task reads two slices of them and compares the pairs of
blocks between them that remain, again by parts. On vectors spread evenly hardly a pair goes, so nothing is
shuffled by pairs. A first product of the axes that hold half of the length, and of the norms of the rest, bounds
the cosine from above, and what reaches the limit by it is compared in double precision.
A pair of blocks returns how many links each vector has and edges that span
its connected vectors, never all its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, table, written
from .graph import components
from .registry import register
from .vectors import binaries, by_length

COSINE = 0.9
AXES = 8         # leading principal dimensions that order and bound
BLOCK = 8192     # vectors of a block
PART = 512       # vectors compared at once within a block
FAN = 8          # children of an interval
SLACK = 1e-9     # of squared distances, against rounding in the bounds only
SLICE_BYTES = 64 << 20  # of the blocks that a task holds while others pass by
BATCH_BYTES = 8 << 20   # of the pairs of blocks that go to Python at once


def unit_rows(x: np.ndarray) -> np.ndarray:
    """The rows, none of them zero, as unit vectors in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True, initial=0)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _usable(batch: pa.RecordBatch, dimension: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix) of the vectors of one length that are not zero and hold finite numbers only."""
    for at, x in by_length(batch.column("v")):
        if x.shape[1] == dimension and x.any():
            yield at[x.any(1)], x[x.any(1)]


def principal_axes(vectors: DataFrame, dimension: int) -> np.ndarray:
    """The leading eigenvectors of the sum of outer products, ``AXES`` or as many as hold the length that the first one holds and half of
    the remaining; only dimension**2 entries reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimension, dimension))
        for batch in batches:
            for _, x in _usable(batch, dimension):
                x = unit_rows(x)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimension ** 2)), pa.array(total.ravel())], names=["k", "s"])

    total = np.zeros(dimension ** 2)
    for r in vectors.select("v").mapInArrow(run, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).collect():
        total[r.k] = r.s
    held, axes = np.linalg.eigh(total.reshape(dimension, dimension))
    held, axes = held[::-1], axes[:, ::-1]
    enough = 1 + int(np.searchsorted(np.cumsum(held), (held.sum() + held[0]) / 2))
    return axes[:, :min(dimension, max(AXES, enough))].copy()


def box_of(low: np.ndarray, rest: np.ndarray) -> list[float]:
    """Least and largest leading coordinates, then those of the norm of the rest."""
    return [*low.min(0).tolist(), float(rest.min()), *low.max(0).tolist(), float(rest.max())]


def _blocks(vectors: DataFrame, kind: str, axes: np.ndarray, width: float, block: int, parts: int) -> DataFrame:
    """The sequence in grid order as rows (part, place, nodes, x, box): ``block`` vectors each, as they were given, of type ``kind``."""
    dimension = len(axes)
    lead = axes[:, :AXES]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _usable(batch, dimension):
                low = np.floor(unit_rows(x) @ lead / width).astype(np.int64) + (1 << 20)
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(at)), binaries(x.astype(kind)), binaries(low.astype(">u4"))],
                                                 names=["node", "x", "cell"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, place = TaskContext.get().partitionId(), 0
        nodes, rows = [], []

        def made(n):
            nonlocal nodes, rows, place
            x = b"".join(rows[:n])
            low = unit_rows(np.frombuffer(x, kind).reshape(-1, dimension)) @ lead
            rest = np.sqrt(np.maximum(0, 1 - (low * low).sum(1)))
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([place], pa.int32()), pa.array([np.array(nodes[:n], np.int64).tobytes()], pa.binary()),
                 pa.array([x], pa.binary()), pa.array([box_of(low, rest)], pa.list_(pa.float64()))],
                names=["part", "place", "nodes", "x", "box"])
            nodes, rows, place = nodes[n:], rows[n:], place + 1
            return out

        for batch in batches:
            nodes += batch.column("node").to_pylist()
            rows += batch.column("x").to_pylist()
            while len(rows) >= block:
                yield made(block)
        if rows:
            yield made(len(rows))

    placed = vectors.mapInArrow(cells, "node long, x binary, cell binary")
    return (placed.repartitionByRange(parts, "cell", "node").sortWithinPartitions("cell", "node").select("node", "x")
            .mapInArrow(cut, "part int, place int, nodes binary, x binary, box array<double>"))


def _apart(a: str, b: str, axes: int) -> Column:
    """Lower bound of the squared distance between the vectors of two boxes."""
    at = lambda side, i: F.col(f"{side}.box")[i]
    total = F.lit(0.0)
    for i in range(axes + 1):
        gap = F.greatest(at(a, i) - at(b, axes + 1 + i), at(b, i) - at(a, axes + 1 + i), F.lit(0.0))
        total = total + gap * gap
    return total


def _tree(blocks: DataFrame, axes: int) -> DataFrame:
    """Rows (i, parent, box): the intervals of one level up."""
    m = axes + 1
    ends = [F.min(F.col("box")[i]) for i in range(m)] + [F.max(F.col("box")[m + i]) for i in range(m)]
    up = blocks.groupBy(F.col("parent").alias("i")).agg(F.array(*ends).alias("box"))
    return up.select("i", F.floor(F.col("i") / FAN).alias("parent"), "box")


def _block_pairs(boxes: DataFrame, n: int, axes: int, limit: float) -> DataFrame:
    """(a, b), a <= b: blocks that are not provably apart, found by recursive descent."""
    levels = [boxes]
    while n > 1:
        levels.append(cut_lineage(_tree(levels[-1], axes)))
        n = -(-n // FAN)
    pairs = levels[-1].select(F.col("i").alias("a"), F.col("i").alias("b"))
    for level in levels[-2::-1]:
        left, right = level.alias("l"), level.alias("r")
        pairs = (pairs.join(left, F.col("a") == F.col("l.parent")).join(right, F.col("b") == F.col("r.parent"))
                 .filter((F.col("l.i") <= F.col("r.i")) & (_apart("l", "r", axes) <= limit + SLACK))
                 .select(F.col("l.i").alias("a"), F.col("r.i").alias("b")))
    return pairs


def spanning(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, of the edges u - v among n nodes."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def faced(x: np.ndarray, axes: np.ndarray, part: int = PART) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, their coordinates on the axes with the norm of the rest in single precision, and the boxes of their parts."""
    low = x @ axes
    rest = lambda m: np.sqrt(np.maximum(0, 1 - (m * m).sum(1)))
    lead, others = low[:, :AXES], rest(low[:, :AXES])
    boxes = [box_of(lead[i:i + part], others[i:i + part]) for i in range(0, len(x), part)]
    return x, np.concatenate((low, rest(low)[:, None]), 1).astype(np.float32), np.array(boxes)


def _cosines(x: np.ndarray, y: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The products of rows ``r`` of x with rows ``c`` of y."""
    if 8 * len(r) > len(x) * len(y):
        return (x @ y.T)[r, c]
    step = max(1, (1 << 21) // x.shape[1])
    return np.concatenate([np.einsum("ij,ij->i", x[r[k:k + step]], y[c[k:k + step]]) for k in range(0, len(r), step)])


def compare_faced(one: tuple, other: tuple | None, cosine: float, part: int = PART) -> tuple[np.ndarray, np.ndarray]:
    """:func:`compare` of what :func:`faced` returns."""
    own, n = other is None, len(one[0])
    (x, sx, bx), (y, sy, by) = one, one if own else other
    shift = 0 if own else n
    count, u, v = np.zeros(shift + len(y), np.int64), [], []
    k = bx.shape[1] // 2
    least = np.float32(cosine - sx.shape[1] * 2.0 ** -21)  # against rounding in single precision
    for i in range(len(bx)):
        gap = np.maximum(np.maximum(bx[i, :k] - by[:, k:], by[:, :k] - bx[i, k:]), 0)
        for j in np.flatnonzero((gap * gap).sum(1) <= 2 - 2 * cosine + SLACK):
            if own and j < i:
                continue
            a, b = i * part, j * part
            bound = sx[a:a + part] @ sy[b:b + part].T
            r, c = np.divmod(np.flatnonzero(bound >= least), bound.shape[1])
            if own and i == j:
                r, c = r[r < c], c[r < c]
            if len(r):
                near = _cosines(x[a:a + part], y[b:b + part], r, c) >= cosine
                r, c = r[near] + a, c[near] + b + shift
            if len(r):
                np.add.at(count, r, 1)
                np.add.at(count, c, 1)
                label = spanning(r, c, len(count))
                moved = np.flatnonzero(label != np.arange(len(count)))
                u.append(moved)
                v.append(label[moved])
    return count, spanning(np.concatenate(u), np.concatenate(v), len(count)) if u else np.arange(len(count))


def compare(x: np.ndarray, y: np.ndarray | None, axes: np.ndarray, cosine: float, part: int = PART) -> tuple[np.ndarray, np.ndarray]:
    """Links within x (y is None) or between x and y: links of each vector of x, then of y, and component labels
    (the least position). Parts that are provably apart are skipped."""
    return compare_faced(faced(x, axes, part), None if y is None else faced(y, axes, part), cosine, part)


def _compare_rows(kind: str, axes: np.ndarray, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, one = None, None
        face = lambda v: faced(unit_rows(np.frombuffer(v.as_py(), kind).reshape(-1, len(axes))), axes)
        for batch in batches:
            for a, b, na, nb, xa, xb in zip(*(batch.column(c) for c in ("a", "b", "na", "nb", "xa", "xb"))):
                own = a.as_py() == b.as_py()
                if a.as_py() != held:
                    held, one = a.as_py(), face(xa)
                nodes = np.frombuffer(na.as_py() + (b"" if own else nb.as_py()), np.int64)
                count, label = compare_faced(one, None if own else face(xb), cosine)
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[label[some]]), pa.array(count[some])], names=["node", "to", "n"])
    return run


def _met(rows: DataFrame, dimension: int, count: int, cosine: float, block: int) -> DataFrame:
    """(node, to, n): links of the vectors of one length by pairs of blocks; edges to ``to`` span each pair's connected vectors."""
    vectors = rows.filter(F.size("v") == dimension)
    kind = "<f4" if isinstance(rows.schema["v"].dataType.elementType, T.FloatType) else "<f8"
    axes = principal_axes(vectors, dimension)
    limit = 2 - 2 * cosine
    # each two slices are a task, about half of which have pairs
    slices = max(-(-count * dimension * int(kind[-1]) // SLICE_BYTES), int(np.ceil(np.sqrt(8 * rows.sparkSession.sparkContext.defaultParallelism))))
    parts = max(min(slices, -(-count // block)), -(-count // (8 * block)))
    blocks = written(_blocks(vectors, kind, axes, float(np.sqrt(limit)) / 4, block, parts), "blocks")
    sizes = blocks.groupBy("part").agg(F.count(F.lit(1)).alias("c"))  # a row per task
    before = sizes.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("before"))
    blocks = blocks.join(F.broadcast(cut_lineage(before)), "part").withColumn("i", F.col("before") + F.col("place")).drop("part", "place", "before")
    boxes = cut_lineage(blocks.select("i", F.floor(F.col("i") / FAN).alias("parent"), "box"))
    pairs = _block_pairs(boxes, boxes.count(), min(AXES, axes.shape[1]), limit)
    meets = written(pairs.groupBy("a").agg(F.collect_list("b").alias("meets")), "meets")  # numbers of blocks
    own = blocks.join(meets, F.col("i") == F.col("a")).select("a", F.col("nodes").alias("na"), F.col("x").alias("xa"), "meets").coalesce(slices)
    other = blocks.select(F.col("i").alias("b"), F.col("nodes").alias("nb"), F.col("x").alias("xb")).coalesce(slices)
    sides = own.join(other, F.array_contains("meets", F.col("b"))).drop("meets")
    met = sides.mapInArrow(_compare_rows(kind, axes, cosine), "node long, to long, n long")
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    given = conf.get(key)
    conf.set(key, str(BATCH_BYTES))
    try:
        return cut_lineage(met)
    finally:
        conf.set(key, given)


def grid_join(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE,
              block: int = BLOCK) -> DataFrame:
    """One row per input row: ``id_col``, n_links, component_id, kept.

    Two vectors are linked if their cosine in double precision is at least ``cosine``
    (above 0). ``n_links`` counts the other rows linked directly; ``component_id`` is the
    smallest id reachable, the row's own included; ``kept`` says that it is the
    row's own. Vectors that are null, zero, or hold null or non-finite components link with nothing, and vectors of
    different lengths not with each other; each length is joined on its own. Repeated rows are linked with each other; null
    ids are never the smallest unless a component has no other. Other columns are not read.
    An empty table gives no rows.
    """
    spark = vectors.sparkSession
    single = isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    v = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    rows = written(vectors.select(F.col(id_col).alias("id"), v.alias("v"), F.monotonically_increasing_id().alias("node")), "vectors")
    sizes = rows.filter("v is not null").groupBy(F.size("v").alias("d")).count().filter("d > 0 and count > 1").orderBy("d").collect()
    met = spark.createDataFrame([], "node long, to long, n long")
    for r in sizes:  # a row per vector length that two vectors have
        met = met.union(_met(rows.select("node", "v"), r.d, r["count"], cosine, block))
    links = met.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(met.select(F.col("node").alias("a"), F.col("to").alias("b")))
    whole = rows.select("node", "id").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = whole.groupBy("root").agg(F.min("id").alias("least"))
    return whole.join(least, "root").select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                                            F.col("least").alias("component_id"), F.col("id").eqNullSafe(F.col("least")).alias("kept"))


@register("op6_grid_join")
def op6_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_join(table(spark, sf_dir, "embeddings"))
