"""Exact ordered positions without a single-task window.

``row_number() over (partition by k order by o)`` puts every row of a key into
one task; when one key (one run date, one feed) holds a third of the data that
task is the whole job. :func:`ordered_positions` computes the same numbers
with a range-partitioned sort and per-task offsets:

1. range-partition on ``(k, o)`` and sort inside each task - every task holds a
   contiguous slice of the global order, so a hot key spans many tasks;
2. inside a task the row index comes from ``monotonically_increasing_id``;
3. a small table (one row per task x key) gives, by a running sum, how many
   rows of the key lie in earlier tasks;
4. position = rows in earlier tasks + index inside the task + 1.

``order`` must be a total order (append a unique key as a tie-breaker) so the
sort is reproducible when a lost task is recomputed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

_LOW_BITS = (1 << 33) - 1


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def ordered_positions(df: DataFrame, by: list[str], order: list, name: str = "pos",
                      num_partitions: int | None = None, materialize: bool = True) -> DataFrame:
    """Add ``name`` = 1-based position of each row inside its ``by`` group.

    The per-task counts and the numbered rows must see the *same* range
    partitioning. Two separate range exchanges would each sample their
    input, and after an upstream shuffle the samples (hence the bounds) can
    differ, so by default the sorted slices are written once (reliable
    checkpoint into the shared checkpoint dir) and both branches read them.
    ``materialize=False`` is only safe when the input is read in a fixed
    order (a plain file scan) - it saves the write.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = _cols(by) + _cols(order)
    tagged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_li", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS))))
    if materialize:
        tagged = cut_lineage(tagged)
    stats = tagged.groupBy("_pid", *by).agg(F.min("_li").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return (_join_null_safe(tagged, stats.drop("_n"), ["_pid", *by])
            .withColumn(name, (F.col("_before") + F.col("_li") - F.col("_first") + 1).cast("long"))
            .drop("_pid", "_li", "_first", "_before"))


def _join_null_safe(df: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on equal keys; a null key is a group of its own. The keys of ``df`` stay."""
    side = side.select(*(F.col(k).alias(f"_key_{k}") if k in keys else F.col(k) for k in side.columns))
    on = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return df.join(side, on).drop(*(f"_key_{k}" for k in keys))


def group_sizes(df: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    """Rows per group as a (partial) aggregate, joined back on the keys."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    if by:
        return _join_null_safe(df, sizes, by)
    # one global count: a scalar subquery, no join
    return df.withColumn(name, sizes.scalar())


def carry_header_forward(sections: DataFrame, key: str, pos: str, header: str, name: str = "current") -> DataFrame:
    """WN-04: the latest non-null ``header`` at or before each row, per ``key``
    (a document); rows before the first header get null. The window is per
    document, whose number of sections is bounded by the document."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return sections.withColumn(name, F.last(header, ignorenulls=True).over(w))
