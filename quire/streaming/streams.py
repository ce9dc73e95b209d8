"""Structured Streaming forms of the repeated daily runs (SM-01..04).

A cron run becomes ``trigger(availableNow=True)`` over a file source with a
checkpoint: re-running with the same checkpoint processes only new files.
All state is built-in (aggregation, deduplication, windows); no custom state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.catalog import fold_interactions
from ..session import ensure_checkpoint_dir
from ..sinks import catalog_store
from ..sources.feeds import PAPER_FILE

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def as_instant(ts) -> "F.Column":
    """Event time for watermarks from a ``TIMESTAMP_NTZ`` column: the wall
    clock is read as UTC, whatever the session time zone (the landed event
    tables carry NTZ wall clocks)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), c.cast("timestamp_ntz")).cast("timestamp")


def utc_date(instant) -> "F.Column":
    """The UTC calendar date of an instant (independent of the session zone)."""
    c = F.col(instant) if isinstance(instant, str) else instant
    return F.to_date(F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz")))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh directory under the shared checkpoint dir (never machine-local)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def table_stream(spark: SparkSession, sf_dir: str, name: str, schema: T.StructType,
                 max_files: int | None = None) -> DataFrame:
    """A driver table as a file stream (explicit schema; glob keeps to one table).

    ``max_files`` caps files per micro-batch (bounded batches for a backlog);
    by default one trigger takes everything that has landed.
    """
    base = sf_dir.rstrip("/")
    r = spark.readStream.schema(schema).option("basePath", base)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(f"{base}/{name}.parque[t]")


def interactions_from_events(events: DataFrame) -> DataFrame:
    """The user-action log (works on batch and streaming frames alike)."""
    et = F.col("event_type")
    return (events.filter(et.isin("click", "view", "purchase"))
            .select(F.col("event_id").alias("seq"), as_instant("ts").alias("ts"),
                    F.col("user_id").alias("doc_id"),
                    F.when(et == "click", "favourite").when(et == "view", "dismiss")
                     .when(et == "purchase", "note").alias("action"),
                    F.when(et == "purchase", F.concat(F.lit("note-"), F.col("event_id").cast("string"))).alias("note")))


def stream_interactions(interactions: DataFrame, key: str = "doc_id") -> DataFrame:
    """SM-02: toggle parity and last note as keyed state; equals the batch fold
    (AG-12/13). In ``update`` mode a micro-batch puts out the keys that it
    changed, with their totals since the start."""
    return fold_interactions(interactions, key=key)


def stream_dedupe(source: DataFrame, key: str = "seq", delay: str = "1 day", ts: str = "ts") -> DataFrame:
    """SM-03: drop replayed rows (same key) that arrive within the watermark
    delay. The watermark column must be TIMESTAMP (NTZ is cast)."""
    return (source.withColumn(ts, as_instant(ts)).withWatermark(ts, delay)
            .dropDuplicatesWithinWatermark([key]))


def stream_daily_counts(source: DataFrame, delay: str = "1 day", ts: str = "ts") -> DataFrame:
    """SM-04: rows per event-time day; in append mode a day is emitted once
    the watermark passes its end, in complete/update mode on every trigger."""
    s = source.withColumn(ts, as_instant(ts)).withWatermark(ts, delay)
    return (s.groupBy(F.window(ts, "1 day")).agg(F.count(F.lit(1)).alias("n"))
            .select(utc_date(F.col("window.start")).alias("day"), "n"))


def run_available(df: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None,
                  key: str | None = None) -> DataFrame:
    """Run a streaming frame over all available input into Parquet files beside its checkpoint and return the
    result of all runs on that checkpoint, so a run without new input returns the same rows:

    * ``append``: the rows of all micro-batches;
    * ``complete``: those of the last one;
    * ``update``: of each ``key`` the latest row. A micro-batch writes only the keys it changed.

    A replayed micro-batch replaces its own files."""
    spark = df.sparkSession
    checkpoint = checkpoint or scratch_dir(spark, "ckpt-" + name)
    path = f"{checkpoint.rstrip('/')}-out"

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    q = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    if not catalog_store._exists(spark, path):
        return spark.createDataFrame([], df.schema)
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("epoch", T.LongType())])).parquet(path)
    if mode == "complete":
        return rows.filter(F.col("epoch") == rows.select(F.max("epoch")).first()[0]).drop("epoch")
    if mode == "update":
        others = [c for c in df.columns if c != key]
        return (rows.groupBy(key).agg(F.max_by(F.struct(*others), "epoch").alias("_r"))
                .select(*[F.col(c) if c == key else F.col(f"_r.{c}").alias(c) for c in df.columns]))
    return rows.drop("epoch")


def stream_ingest(spark: SparkSession, feed_dir: str, catalog_root: str, run_date,
                  checkpoint: str | None = None, multiline: bool = False) -> None:
    """SM-01: landed JSON paper files (JSON lines, or arrays with
    ``multiline``) -> catalog upsert, one micro-batch per
    trigger. Rows without an id or title are set aside by the store. The
    commit carries (checkpoint, epoch), so a batch that is delivered again after a failure is not merged again."""
    checkpoint = checkpoint or scratch_dir(spark, "ckpt-ingest")
    src = (spark.readStream.schema(PAPER_FILE).option("multiLine", str(multiline).lower()).json(feed_dir)
           .select("*", F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start").alias("_file"))
           .withColumnRenamed("arxiv_id", "paper_id"))
    merge = merge_batch(catalog_root, run_date, checkpoint)
    q = src.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def merge_batch(catalog_root: str, run_date, stream: str):
    """The function that merges micro-batch ``epoch`` of ``stream`` into the catalog, once however often it is called."""
    def merge(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            # arrival order decides in-batch duplicates: file time, path, then place in the file
            batch = batch.withColumn("pos", F.struct("_file", F.monotonically_increasing_id().alias("row"))).drop("_file")
            catalog_store.upsert(batch.sparkSession, catalog_root, batch, run_date, stream, epoch)
    return merge
