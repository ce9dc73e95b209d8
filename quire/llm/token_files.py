"""Token-id files: Parquet with list columns, read selectively.

Layout of a token file: one row per document in ascending id order; columns
``doc_id``, ``part``, ``local_start``, ``n_tokens`` (plain integers, delta
encoded), ``tokens`` (list of int32, dictionary encoded: an id takes at most 16 bits
for a vocabulary of 50,000). Row groups and pages are kept small and carry
page indexes, so a range of documents reads only its pages, and metadata reads
never touch the token column. Files follow each other in id order; ``part``
numbers them.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import documents, scratch_path, text_or_empty
from .registry import register
from .tokens import library_encoder, slices, with_end

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 128 << 10
PAGE_ROWS = 2_000


def write_tokens(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = END_ID) -> None:
    """Encodes whole texts, appends ``end_id`` to each and writes token files to ``path``.

    A null text counts as empty (its row holds only the end id). Rows are
    ordered by id, then text; a null id comes first; repeated rows stay
    repeated. Other columns are not read. An empty table writes empty files.
    Texts are shuffled once, by id range; encoding follows, so that the
    sampling of the ranges does not encode.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        encoder, before, part = library_encoder(vocabulary), 0, TaskContext.get().partitionId()
        for batch, texts in slices(batches, "text"):
            flat, at = with_end(*encoder.encode(texts), end_id)
            n = np.diff(at)
            tokens = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.view(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(before + at[:-1]), pa.array(n), tokens],
                names=["doc_id", "part", "local_start", "n_tokens", "tokens"])
            before += int(at[-1])

    one = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    (one.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(encode, "doc_id long, part int, local_start long, n_tokens long, tokens array<int>")
     .write.option("compression", "zstd")
     .option("parquet.writer.version", "v2").option("parquet.block.size", ROW_GROUP_BYTES)
     .option("parquet.page.size", PAGE_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS)
     .option("parquet.enable.dictionary", "true")
     .option("parquet.enable.dictionary#doc_id", "false").option("parquet.enable.dictionary#local_start", "false")
     .option("parquet.enable.dictionary#n_tokens", "false")
     .parquet(path))


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens, tokens of the token files, of ids ``low`` to ``high`` if given.
    Columns that are not used further on are not read."""
    rows = spark.read.parquet(path)
    # one row per file; the ids of all files before it
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    if low is not None:
        rows = rows.filter(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.filter(F.col("doc_id") <= high)
    return rows.join(F.broadcast(before), "part").select(
        "doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "tokens")


def _crc32(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    import numpy as np

    for batch in batches:
        tokens = batch.column("tokens")
        offsets, flat = tokens.offsets.to_numpy(), tokens.values.to_numpy().astype("<u4", copy=False)
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())],
                                         names=["doc_id", "start", "n_tokens", "ids_crc32"])


@register("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_tokens(documents(spark, sf_dir), path, public_tokenizers.path(VOCABULARY))
    return read_tokens(spark, path).mapInArrow(_crc32, "doc_id long, start long, n_tokens long, ids_crc32 long")
