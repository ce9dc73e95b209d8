"""Hard negatives from exact integer scores, tile by tile.

Components become whole numbers, and the score of a row is its inner product with the
anchor. Candidates are dealt to groups; a task holds the candidates of a group and lets the anchors
pass by in tiles. A tile of anchors times a tile of candidates is multiplied by Strassen's recursion on int64
with zero padding: additions wrap modulo 2**64, so results are exact whenever the score itself fits.

Two passes keep memory bounded. The first fills a heap of the nearest rows of the same label for each
anchor; heaps of the groups are merged in Spark. The second has a heap for each anchor and positive, for the best rows
of other labels whose scores lie in the window that the positive opens; they are merged in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .registry import register
from .vectors import Heaps, binaries, matrix, streamed, usable

POSITIVES = 5
NEGATIVES = 5
LOW, HIGH = 80, 100          # window of negative scores, in percent of the positive's
SCALE = 256
GROUP_BYTES = 16 << 20       # of the numbers of a group of candidates
TILE = (256, 1024)           # anchors and candidates of a tile
BASE = 32                    # tiles of a side up to this are multiplied directly
_NONE = np.iinfo(np.int64).max


def strassen(a: np.ndarray, b: np.ndarray, base: int = BASE) -> np.ndarray:
    """The product of two int64 matrices modulo 2**64 by Strassen's seven products; odd sides are padded with zeros."""
    m, k, n = len(a), a.shape[1], b.shape[1]
    if min(m, k, n) <= base:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
    h, i, j = len(a) // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1 = strassen(a11 + a22, b11 + b22, base)
    p2 = strassen(a21 + a22, b11, base)
    p3 = strassen(a11, b12 - b22, base)
    p4 = strassen(a22, b21 - b11, base)
    p5 = strassen(a11 + a12, b22, base)
    p6 = strassen(a21 - a11, b11 + b12, base)
    p7 = strassen(a12 - a22, b21 + b22, base)
    out = np.empty((2 * h, 2 * j), np.int64)
    out[:h, :j], out[:h, j:] = p1 + p4 - p5 + p7, p3 + p5
    out[h:, :j], out[h:, j:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


def push_best(heaps: Heaps, keys: np.ndarray, groups: np.ndarray, ids: np.ndarray, nodes: np.ndarray) -> None:
    """Push into heap ``groups[r]`` the entries of row r that may be among its best; ``_NONE`` marks no entry."""
    limit = heaps.worst(_NONE - 1)[groups]
    if keys.shape[1] > heaps.k:
        limit = np.minimum(limit, np.partition(keys, heaps.k - 1, 1)[:, heaps.k - 1])
    r, c = np.nonzero((keys <= limit[:, None]) & (keys != _NONE))
    heaps.push(groups[r], keys[r, c], ids[c], nodes[c])


class _Group:
    """The candidates of a group, cut into tiles, and the codes of their labels."""

    def __init__(self, held: dict, tile: tuple[int, int]):
        self.tile = tile
        self.x, self.id, self.node = matrix(held["x"], np.int64), held["id"].to_numpy(), held["node"].to_numpy()
        self.names, self.label = np.unique(np.array(held["label"].to_pylist(), str), return_inverse=True)

    def codes(self, labels: pa.Array) -> np.ndarray:
        """Codes of the anchors' labels, -1 if no candidate has it."""
        labels = np.array(labels.to_pylist(), str)
        at = np.minimum(np.searchsorted(self.names, labels), len(self.names) - 1)
        return np.where(self.names[at] == labels, at, -1)

    def tiles(self, anchors: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray]]:
        """(rows of anchors, candidates, scores) tile by tile."""
        for a in range(0, len(anchors), self.tile[0]):
            rows = slice(a, a + self.tile[0])
            for c in range(0, len(self.x), self.tile[1]):
                some = slice(c, c + self.tile[1])
                yield rows, some, strassen(anchors[rows], self.x[some].T)


def _positives(k: int, tile: tuple[int, int]):
    def work(held: dict):
        group = _Group(held, tile)

        def ask(part: dict) -> Iterator[pa.RecordBatch]:
            x, label, node = matrix(part["x"], np.int64), group.codes(part["label"]), part["node"].to_numpy()
            heaps = Heaps(len(x), k, np.int64)
            for rows, some, scores in group.tiles(x):
                same = (label[rows][:, None] == group.label[some]) & (node[rows][:, None] != group.node[some])
                push_best(heaps, np.where(same, -scores, _NONE), np.arange(len(x))[rows], group.id[some], group.node[some])
            yield pa.RecordBatch.from_arrays([part["node"].take(pa.array(heaps.group)), pa.array(-heaps.key), pa.array(heaps.id), pa.array(heaps.node)],
                                             names=["anchor", "score", "id", "node"])
        return ask
    return work


def _negatives(k: int, low: int, high: int, tile: tuple[int, int]):
    def work(held: dict):
        group = _Group(held, tile)

        def ask(part: dict) -> Iterator[pa.RecordBatch]:
            x, label = matrix(part["x"], np.int64), group.codes(part["label"])
            opened = part["positives"]
            counts = np.asarray(opened.value_lengths())
            first, scores_of = np.cumsum(counts) - counts, opened.flatten().to_numpy()  # of all anchors, one after the other
            heaps = Heaps(len(scores_of), k, np.int64)
            for rows, some, scores in group.tiles(x):
                keys = np.where(label[rows][:, None] != group.label[some], -scores, _NONE)
                for place in range(int(counts[rows].max(initial=0))):
                    has = np.flatnonzero(counts[rows] > place)
                    heap = first[rows][has] + place
                    top, own = scores_of[heap][:, None], keys[has]
                    inside = (own != _NONE) & (-100 * own <= high * top) & (-100 * own >= low * top)
                    push_best(heaps, np.where(inside, own, _NONE), heap, group.id[some], group.node[some])
            at = np.repeat(np.arange(len(x)), counts)
            place = np.arange(len(scores_of)) - np.repeat(first, counts)
            yield pa.RecordBatch.from_arrays([part["node"].take(pa.array(at[heaps.group])), pa.array(place[heaps.group]), pa.array(-heaps.key),
                                              pa.array(heaps.id), pa.array(heaps.node)], names=["anchor", "place", "score", "id", "node"])
        return ask
    return work


def _whole_numbers(rows: DataFrame, scale: float) -> DataFrame:
    """floor(scale * x) of each component; ``size`` is the norm of the result."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.column("d").to_numpy()
            for n in np.unique(d):
                at = pa.array(np.flatnonzero(d == n))
                x = np.floor(scale * matrix(batch.column("x").take(at), np.float64))
                part = batch.take(at)
                size = np.sqrt((x * x).sum(1))
                whole = np.where(size[:, None] < 2.0 ** 62, x, 0).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "id", "label", "asks", "d")), binaries(whole), pa.array(size)],
                                                 names=["node", "id", "label", "asks", "d", "x", "size"])
    return rows.mapInArrow(run, "node long, id long, label string, asks boolean, d long, x binary, size double")


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   is_anchor: str | Column = "vec_id % 100 = 0", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
                   scale: float = SCALE, group_bytes: int = GROUP_BYTES, tile: tuple[int, int] = TILE) -> DataFrame:
    """Per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row's score is the inner product with the anchor of floor(``scale`` * component), exact in 64 bits; higher scores come
    first, ties by smaller id. An anchor's positives are its first ``positives`` other rows of its label, the negatives of a
    positive the first ``negatives`` rows of other labels with low * positive score <= 100 * score <= high * positive score;
    all, if fewer. A positive without negatives gives no row; so does a negative positive score, whose window is empty if low < high.

    Rows whose id, label or vector is null, and vectors that are empty or hold null or non-finite components, take no part; zero
    vectors do. Vectors of different lengths are not comparable: an anchor meets rows of its own length. A repeated row is a row like any
    other. Scores must stay below 2**54 in size so that the window's products fit; larger vectors end the job with an
    error. Other columns are read by ``is_anchor`` alone. An empty table gives no rows.
    """
    asks = F.expr(is_anchor) if isinstance(is_anchor, str) else is_anchor
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.monotonically_increasing_id().alias("node"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
        F.coalesce(asks, F.lit(False)).alias("asks"), F.col(vector_col).alias("v"))
    rows = written(_whole_numbers(usable(rows, zeros=True), scale), "numbers")
    largest = rows.agg(F.max("size").alias("s"), F.max(F.when(F.col("asks"), F.col("size"))).alias("a")).first()
    if (largest.s or 0.0) * (largest.a or 0.0) >= 2.0 ** 54:
        raise ValueError("hard_negatives: scores of this table may exceed 54 bits")
    groups = rows.groupBy("d").agg(F.ceil(F.count(F.lit(1)) * F.col("d") * 8 / group_bytes).alias("groups"))
    rows = rows.join(groups, "d")
    held = rows.select("node", "id", "label", "d", "x", F.pmod(F.xxhash64("node"), "groups").alias("part"), F.lit(None).cast("array<long>").alias("positives"))
    anchors = rows.filter("asks").select("node", "id", "label", "d", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("part"))

    def best(found: DataFrame, heap: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*heap).orderBy(F.desc("score"), "id", "node")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    first = streamed(held, anchors.withColumn("positives", F.lit(None).cast("array<long>")), ["d", "part"], _positives(positives, tile),
                     "anchor long, score long, id long, node long")
    near = written(best(first, ["anchor"], positives), "positives")
    opened = near.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]).alias("positives"))  # at most ``positives``
    asking = anchors.join(opened.withColumnRenamed("anchor", "node"), "node").select("node", "id", "label", "d", "x", "part", "positives")
    second = streamed(held, asking, ["d", "part"], _negatives(negatives, low, high, tile), "anchor long, place long, score long, id long, node long")
    found = best(second, ["anchor", "place"], negatives).select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = rows.filter("asks").select(F.col("node").alias("anchor"), F.col("id").alias("anchor_id"))
    chosen = near.select("anchor", (F.col("rank") - 1).cast("long").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(chosen.join(named, "anchor"), ["anchor", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@register("op13_hard_negatives", """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same,
         cast(list_sum(list_transform(list_zip(a.q, c.q), lambda p: p[1] * p[2])) as bigint) as score
  from v a join v c on a.vec_id % 100 = 0 and a.vec_id <> c.vec_id and len(a.q) = len(c.q)),
p as (
  select * from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (
  select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
         row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) as rank
  from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 5
""")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives(rows)
