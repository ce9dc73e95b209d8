"""Vectors in tasks: usable rows, groups streamed against the rows that ask for them, and mergeable heaps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix in double precision) of the lists of each length that are not null or empty and hold finite numbers only."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    values = np.asarray(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)  # nulls become NaN
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    for d in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == d)
        x = values[starts[at][:, None] + np.arange(d)]
        good = np.isfinite(x).all(1)
        if good.any():
            yield at[good], x[good]


def usable(rows: DataFrame, zeros: bool) -> DataFrame:
    """The rows whose list ``v`` is of finite numbers, not all zero unless ``zeros``: its other columns, its length d and, as x, its
    bytes in double precision."""
    others = [f for f in rows.schema.fields if f.name != "v"]
    schema = T.StructType([*others, T.StructField("d", T.LongType()), T.StructField("x", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in by_length(batch.column("v")):
                if not zeros:
                    at, x = at[x.any(1)], x[x.any(1)]
                kept = [batch.column(f.name).take(pa.array(at)) for f in others]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.full(len(x), x.shape[1], np.int64)), binaries(x)], names=schema.names)
    return rows.mapInArrow(run, schema)


def binaries(x: np.ndarray) -> pa.Array:
    """A row of the matrix as bytes each."""
    return pa.array([r.tobytes() for r in x], pa.binary())


def matrix(column: pa.Array, dtype) -> np.ndarray:
    """Equally long byte strings as the rows of a matrix."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1)


def streamed(held: DataFrame, asking: DataFrame, key: list[str], work: Callable, schema: str) -> DataFrame:
    """For each key of whole numbers, ``work(held rows)`` returns a function that takes a part of the asking rows and yields
    record batches; rows are dicts of Arrow columns.

    Both tables, of the same columns, are dealt by ``key``. A task sorts its rows by key, held rows first, keeps those of one key and
    lets the asking rows pass by, so its memory is bounded by the held rows of a key, not by those that ask.
    """
    both = held.withColumn("asks", F.lit(False)).unionByName(asking.withColumn("asks", F.lit(True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        at, made = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in key] + [batch.column("asks").to_numpy(zero_copy_only=False).astype(np.int64)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                part = {n: batch.column(n).slice(a, b - a) for n in batch.schema.names}
                now, asks = tuple(keys[a, :-1].tolist()), bool(keys[a, -1])
                if now != at:
                    rows, at, made = [], now, None
                if not asks:
                    rows.append(part)
                elif rows:
                    if made is None:
                        made = work({n: pa.concat_arrays([r[n] for r in rows]) for n in rows[0]})
                    yield from made(part)

    return both.repartition(*key).sortWithinPartitions(*key, "asks").mapInArrow(run, schema)


class Heaps:
    """The ``k`` best entries of each of ``groups`` groups: smallest key first, ties to the smaller id. Entries may be
    pushed in any order and in parts; heaps of the same groups merge by pushing one's entries into the other."""

    def __init__(self, groups: int, k: int, dtype):
        self.k, self.groups, self.dtype = k, groups, dtype
        self.group = np.zeros(0, np.int64)
        self.key, self.id, self.node = np.zeros(0, dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def push(self, group: np.ndarray, key: np.ndarray, id: np.ndarray, node: np.ndarray) -> None:
        group, key = np.concatenate([self.group, group]), np.concatenate([self.key, key])
        id, node = np.concatenate([self.id, id]), np.concatenate([self.node, node])
        order = np.lexsort((node, id, key, group))
        first = np.searchsorted(group[order], group[order])
        order = order[np.arange(len(order)) - first < self.k]
        self.group, self.key, self.id, self.node = group[order], key[order], id[order], node[order]

    def worst(self, none) -> np.ndarray:
        """The greatest key of each full group, ``none`` for the others."""
        out = np.full(self.groups, none, self.dtype)
        first = np.searchsorted(self.group, np.arange(self.groups))
        full = np.bincount(self.group, minlength=self.groups) == self.k
        out[full] = self.key[first[full] + self.k - 1]
        return out
