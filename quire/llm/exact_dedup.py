"""Exact deduplication with a heavy-hitter split (DataFrame functions only).

Texts are compared by SHA-256 digest, so they never leave the scan. A
Misra-Gries sketch (``approx_top_k``, a fixed number of counters) names the
digests that may be frequent. Their exact counts and winners are verified in one
map-side combined aggregation of at most ``heavy`` groups and broadcast: rows
of frequent digests are decided without a shuffle, however large their groups
are. All other digests take the ordinary shuffle, where no group can hold more
than about ``rows / tracked`` rows, because the sketch keeps every larger one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, documents, fresh, text_or_empty
from .registry import register

HEAVY = 256      # frequent digests decided by broadcast, at most
TRACKED = 4096   # counters of the sketch


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty. Of equal texts
    the row with the largest id stays (a null id is smaller than any other).
    Among repeated rows that share that id exactly one is ``kept``. Other
    columns of ``docs`` are not read, so their names cannot clash. An empty
    table gives no rows.
    """
    rows = cut_lineage(docs.select(F.col(id_col).alias("id"),
                                   F.sha2(text_or_empty(text_col), 256).alias("digest"),
                                   F.monotonically_increasing_id().alias("row")))
    frequent = (rows.agg(F.expr(f"approx_top_k(digest, {int(heavy)}, {int(tracked)})").alias("top"))
                .select(F.explode("top.item").alias("digest")))
    verified = cut_lineage(_winners(rows.join(F.broadcast(frequent), "digest")))  # at most `heavy` rows
    split = rows.join(F.broadcast(verified), "digest", "left")
    rest = split.filter(F.col("n").isNull()).drop("n", "best")
    decided = split.filter(F.col("n").isNotNull()).unionByName(rest.join(_winners(rest), "digest"))
    return decided.select(F.col("id").alias(id_col), F.col("best.id").alias("keep_id"),
                          F.col("n").alias("group_size"), (F.col("best.row") == F.col("row")).alias("kept"),
                          F.col("digest").alias("text_sha256"))


def _winners(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "row")).alias("best"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops, columns unchanged.

    Rows that agree in id and text are copies of each other; one of them stays.
    """
    digest, key = fresh("digest", docs), fresh("kept_id", docs)
    keep = (exact_dedup(docs, id_col, text_col).filter("kept")
            .select(F.col(id_col).alias(key), F.col("text_sha256").alias(digest)))
    named = docs.withColumn(digest, F.sha2(text_or_empty(text_col), 256))
    met = named.join(keep, (named[digest] == keep[digest]) & named[id_col].eqNullSafe(keep[key]), "left_semi")
    return met.dropDuplicates([digest, id_col]).drop(digest)


OP5_SQL = """
select doc_id,
       max(doc_id) over (partition by coalesce(text, '')) as keep_id,
       count(*) over (partition by coalesce(text, '')) as group_size,
       doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
"""


@register("op5_exact_dedup", OP5_SQL)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))
