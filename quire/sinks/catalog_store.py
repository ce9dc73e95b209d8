"""Versioned Parquet catalog with a commit log (SNK-07/08/09, SRC-10, SM-01).

Layout under ``root``::

    data/<commit>/part-*.parquet   files of one commit, sorted by (date_added, paper_id)
    _log/v=N                       rows of commit N: files added and removed, one row about the commit
    _log/state=N                   files live at version N, every CHECKPOINT_EVERY commits
    _snapshots/date=D              a kept version by date
    _rejected/<commit>             rows that a commit did not accept, with the reason

The log keeps for each file its range of ids, its range of dates, its size and a bitmap of hashed ids. An upsert
compares the batch's ids with these and opens only files that may hold one of them; it rewrites those
that do. New papers go to new files, so other files of their date stay as they are.

A commit writes its files first and then renames its log folder into place, so readers never see part of it,
and files of a crashed commit are never read. Versions are found by probing names: no folder is listed. There is one
writer at a time. A commit may carry (stream, epoch); the log remembers them, so a
batch that is delivered again is skipped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.catalog import add_missing_columns, upsert_catalog, validate_papers
from ..operators.reports import expired_snapshots
from ..schemas import CATALOG, SNAPSHOT_MIN_BYTES, SNAPSHOT_RETENTION_DAYS
from ..session import cut_lineage

CHECKPOINT_EVERY = 10
BITMAP_BITS = 8 * 4096       # of Spark's bitmap_construct_agg
INTERVALS = 64               # ranges that a batch's ids are summed up in
SMALL_FILE_BYTES = 32 << 20  # files below this are compacted

LOG = T.StructType([
    T.StructField("v", T.LongType()), T.StructField("kind", T.StringType()),  # add, remove, commit
    T.StructField("path", T.StringType()), T.StructField("n_rows", T.LongType()), T.StructField("n_bytes", T.LongType()),
    T.StructField("min_id", T.StringType()), T.StructField("max_id", T.StringType()),
    T.StructField("min_date", T.DateType()), T.StructField("max_date", T.DateType()), T.StructField("ids", T.BinaryType()),
    T.StructField("stream", T.StringType()), T.StructField("epoch", T.LongType()),
    T.StructField("n_live", T.LongType()), T.StructField("n_opened", T.LongType()), T.StructField("n_rewritten", T.LongType()),
    T.StructField("n_rejected", T.LongType()),
])


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _put(spark: SparkSession, rows: DataFrame, root: str, name: str) -> None:
    """Write ``rows`` aside and rename them to ``_log/name``."""
    aside = f"{root}/_log/.{uuid.uuid4().hex}"
    rows.coalesce(1).write.parquet(aside)
    fs, source = _fs(spark, aside)
    target = _fs(spark, f"{root}/_log/{name}")[1]
    if fs.exists(target) or not fs.rename(source, target):
        raise RuntimeError(f"catalog {root}: another writer has committed {name}")


# ---------------------------------------------------------------------------
# Versions and live files
# ---------------------------------------------------------------------------
def _state_at(spark: SparkSession, root: str, version: int) -> int:
    """The last version up to ``version`` with a state, 0 if none."""
    n = version // CHECKPOINT_EVERY * CHECKPOINT_EVERY
    while n and not _exists(spark, f"{root}/_log/state={n}"):
        n -= CHECKPOINT_EVERY
    return n


def head(spark: SparkSession, root: str) -> int:
    """The current version, 0 if nothing was committed. Probes a number of names that grows with the logarithm of the commits."""
    high = CHECKPOINT_EVERY
    while _exists(spark, f"{root}/_log/v={high}"):
        high *= 2
    low = high // 2 if high > CHECKPOINT_EVERY else 0
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if _exists(spark, f"{root}/_log/v={mid}") else (low, mid)
    return low


def next_version(spark: SparkSession, root: str) -> int:
    return head(spark, root) + 1


def _log(spark: SparkSession, root: str, version: int) -> DataFrame:
    """The last state and the commits after it."""
    state = _state_at(spark, root, version)
    paths = ([f"{root}/_log/state={state}"] if state else []) + [f"{root}/_log/v={n}" for n in range(state + 1, version + 1)]
    return spark.read.schema(LOG).parquet(*paths) if paths else spark.createDataFrame([], LOG)


def live_files(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The log's rows of the files that make up a version (by default the current one)."""
    log = _log(spark, root, head(spark, root) if version is None else version)
    removed = log.filter("kind = 'remove'").select("path")
    return log.filter("kind = 'add'").join(removed, "path", "left_anti").select(LOG.names)


def _read(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], CATALOG)
    return spark.read.schema(CATALOG).parquet(*(f"{root}/{p}" for p in paths))


def read_catalog(spark: SparkSession, root: str, version: int | None = None, since=None, until=None) -> DataFrame:
    """SRC-10: the catalog at a version (by default the current one). With ``since`` or ``until``
    (dates) files that hold no row of that time are not opened."""
    files = live_files(spark, root, version)
    out = lambda d: d
    for day, keep, rows in ((since, F.col("max_date") >= F.lit(since).cast("date"), F.col("date_added") >= F.lit(since).cast("date")),
                            (until, F.col("min_date") <= F.lit(until).cast("date"), F.col("date_added") <= F.lit(until).cast("date"))):
        if day is not None:
            files, out = files.filter(keep), (lambda d, f=out, r=rows: f(d).filter(r))
    return out(_read(spark, root, [r.path for r in files.select("path").collect()]))


def history(spark: SparkSession, root: str) -> DataFrame:
    """One row per commit: v, stream, epoch, n_rows written, n_live files before it, n_opened, n_rewritten, n_rejected."""
    paths = [f"{root}/_log/v={n}" for n in range(1, head(spark, root) + 1)]
    log = spark.read.schema(LOG).parquet(*paths) if paths else spark.createDataFrame([], LOG)
    return log.filter("kind = 'commit'").select("v", "stream", "epoch", "n_rows", "n_live", "n_opened", "n_rewritten", "n_rejected")


# ---------------------------------------------------------------------------
# Which files may hold an id
# ---------------------------------------------------------------------------
def _bit(id_col) -> F.Column:
    return F.pmod(F.xxhash64(id_col), F.lit(BITMAP_BITS))


def files_that_may_hold(files: DataFrame, ids: DataFrame) -> DataFrame:
    """(path) of the ``files`` whose range and bitmap admit one of the ``ids`` (paper_id).

    The ids are range-partitioned into ``INTERVALS``, so that only the ends of
    these, a bounded table, meet every file; ids are then compared with the files of their interval alone.
    """
    ranged = cut_lineage(ids.select("paper_id").distinct().repartitionByRange(INTERVALS, "paper_id")
                         .select("paper_id", F.spark_partition_id().alias("i")))
    ends = ranged.groupBy("i").agg(F.min("paper_id").alias("low"), F.max("paper_id").alias("high"))
    near = (files.select("path", "min_id", "max_id", "ids")
            .join(F.broadcast(ends), (F.col("min_id") <= F.col("high")) & (F.col("max_id") >= F.col("low"))))
    byte = F.conv(F.hex(F.substring("ids", F.lit(1) + F.shiftright("bit", 3).cast("int"), F.lit(1))), 16, 10).cast("long")
    held = F.getbit(byte, F.col("bit").bitwiseAND(F.lit(7)).cast("int")) == 1
    return (ranged.withColumn("bit", _bit("paper_id")).join(near, "i")
            .filter(F.col("paper_id").between(F.col("min_id"), F.col("max_id")) & held).select("path").distinct())


# ---------------------------------------------------------------------------
# Commits
# ---------------------------------------------------------------------------
def _write(spark: SparkSession, root: str, rows: DataFrame, version: int) -> DataFrame:
    """Write ``rows`` as new files; their log rows."""
    folder = f"data/{version:08d}-{uuid.uuid4().hex[:8]}"
    (add_missing_columns(rows).repartitionByRange("date_added", "paper_id").sortWithinPartitions("date_added", "paper_id")
        .write.parquet(f"{root}/{folder}"))
    written = spark.read.schema(CATALOG).parquet(f"{root}/{folder}").select("paper_id", "date_added", "_metadata")
    stats = written.groupBy(F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_size").alias("n_bytes")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("paper_id").alias("min_id"), F.max("paper_id").alias("max_id"),
        F.min("date_added").alias("min_date"), F.max("date_added").alias("max_date"), F.bitmap_construct_agg(_bit("paper_id")).alias("ids"))
    return _rows(stats.withColumn("path", F.concat(F.lit(f"{folder}/"), "f")), version, "add")


def _rows(df: DataFrame, version: int, kind: str) -> DataFrame:
    """``df`` in the shape of the log."""
    df = df.withColumn("v", F.lit(version).cast("long")).withColumn("kind", F.lit(kind))
    return df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in LOG.fields])


def _commit(spark: SparkSession, root: str, version: int, added: DataFrame, removed: DataFrame, about: dict) -> int:
    added = cut_lineage(added)
    n_rows = added.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    note = spark.createDataFrame([(n_rows, *about.values())], ", ".join(["n_rows long", *(f"{k} {LOG[k].dataType.simpleString()}" for k in about)]))
    _put(spark, added.unionByName(_rows(removed, version, "remove")).unionByName(_rows(note, version, "commit")), root, f"v={version}")
    if version % CHECKPOINT_EVERY == 0:
        streams = _log(spark, root, version).filter("kind = 'commit' and stream is not null").groupBy("stream").agg(F.max("epoch").alias("epoch"))
        _put(spark, live_files(spark, root, version).unionByName(_rows(streams, version, "commit")), root, f"state={version}")
    return version


def _delivered(spark: SparkSession, root: str, version: int, stream: str, epoch: int) -> bool:
    last = _log(spark, root, version).filter((F.col("kind") == "commit") & (F.col("stream") == stream)).agg(F.max("epoch")).first()[0]
    return last is not None and epoch <= last


def upsert(spark: SparkSession, root: str, incoming: DataFrame, run_date, stream: str | None = None, epoch: int | None = None) -> int:
    """SNK-07: merge ``incoming`` into the stored catalog (JN-05) and return the new version.

    Rows that :func:`validate_papers` rejects go to ``_rejected`` with their reason and are counted. Only files that may hold an id
    of the batch are opened, and of these only the ids; only files that do hold one are rewritten. With ``stream`` and
    ``epoch`` a batch that was committed before changes nothing.
    """
    before = head(spark, root)
    if stream is not None and _delivered(spark, root, before, stream, epoch):
        return before
    version = before + 1
    incoming = cut_lineage(incoming)
    valid, rejected = validate_papers(incoming)
    n_rejected = rejected.count()
    if n_rejected:
        rejected.write.parquet(f"{root}/_rejected/{version:08d}-{uuid.uuid4().hex[:8]}")
    files = cut_lineage(live_files(spark, root, before))
    may_hold = [r.path for r in files_that_may_hold(files, valid.select("paper_id")).collect()]
    keys = _read(spark, root, may_hold).select("paper_id", F.concat(F.element_at(F.split("_metadata.file_path", "/data/"), -1)).alias("f")) if may_hold else None
    holding = [] if keys is None else [f"data/{r.f}" for r in keys.join(valid.select("paper_id"), "paper_id", "left_semi").select("f").distinct().collect()]
    merged = upsert_catalog(_read(spark, root, holding), valid, run_date)
    return _commit(spark, root, version, _write(spark, root, merged, version), files.filter(F.col("path").isin(holding)).select("path"),
                   dict(stream=stream, epoch=epoch, n_live=files.count(), n_opened=len(may_hold), n_rewritten=len(holding), n_rejected=n_rejected))


def compact(spark: SparkSession, root: str, small_bytes: int = SMALL_FILE_BYTES) -> int:
    """Rewrite the live files below ``small_bytes`` as few sorted ones; the version, unchanged if fewer than two are small."""
    before = head(spark, root)
    files = cut_lineage(live_files(spark, root, before))
    small = [r.path for r in files.filter(F.col("n_bytes") < small_bytes).select("path").collect()]
    if len(small) < 2:
        return before
    return _commit(spark, root, before + 1, _write(spark, root, _read(spark, root, small), before + 1), files.filter(F.col("path").isin(small)).select("path"),
                   dict(n_live=files.count(), n_opened=len(small), n_rewritten=len(small)))


def rejected(spark: SparkSession, root: str) -> DataFrame | None:
    """All rows that commits did not accept, with ``reject_reason``; None if there are none."""
    return spark.read.option("mergeSchema", "true").parquet(f"{root}/_rejected/*") if _exists(spark, f"{root}/_rejected") else None


# ---------------------------------------------------------------------------
# Snapshots
# ---------------------------------------------------------------------------
def snapshot(spark: SparkSession, root: str, snap_date) -> DataFrame | None:
    """SNK-08: keep the current version under a date; its manifest row (snapshot_date, v, n_rows, n_bytes as
    written, warn_small), or None if nothing was committed. Nothing is copied."""
    version = head(spark, root)
    if not version:
        return None
    row = live_files(spark, root, version).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).cast("long").alias("n_rows"),
                                               F.coalesce(F.sum("n_bytes"), F.lit(0)).cast("long").alias("n_bytes")).select(
        F.lit(snap_date).cast("date").alias("snapshot_date"), F.lit(version).cast("long").alias("v"), "n_rows", "n_bytes",
        (F.col("n_bytes") < SNAPSHOT_MIN_BYTES).alias("warn_small"))
    row = cut_lineage(row)
    row.coalesce(1).write.mode("overwrite").parquet(f"{root}/_snapshots/date={snap_date}")
    return row


def snapshots(spark: SparkSession, root: str) -> DataFrame:
    """The manifest: one row per kept snapshot."""
    schema = "snapshot_date date, v long, n_rows long, n_bytes long, warn_small boolean"
    if not _exists(spark, f"{root}/_snapshots"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/_snapshots").drop("date")


def read_snapshot(spark: SparkSession, root: str, snap_date) -> DataFrame:
    found = snapshots(spark, root).filter(F.col("snapshot_date") == F.lit(snap_date).cast("date")).first()
    if found is None:
        raise ValueError(f"catalog {root}: no snapshot of {snap_date}")
    return read_catalog(spark, root, found.v)


def prune(spark: SparkSession, root: str, as_of, days: int = SNAPSHOT_RETENTION_DAYS) -> DataFrame:
    """SNK-09: drop snapshots over ``days`` old, then delete the files that neither the current version nor a kept snapshot
    needs (mark and sweep over the log). One row: n_pruned, n_kept, n_files_deleted, n_files_kept."""
    marked = expired_snapshots(snapshots(spark, root), as_of, days).select("snapshot_date", "v", "expired").collect()
    kept = sorted({r.v for r in marked if not r.expired} | {head(spark, root)} - {0})
    needed = None
    for v in kept:
        paths = live_files(spark, root, v).select("path")
        needed = paths if needed is None else needed.union(paths)
    swept, n_needed = [], 0
    if needed is not None:
        needed = needed.distinct()
        log = spark.read.schema(LOG).parquet(*(f"{root}/_log/v={n}" for n in range(1, head(spark, root) + 1)))
        gone = log.filter("kind = 'add'").select("path").join(needed, "path", "left_anti")
        swept, n_needed = [r.path for r in gone.collect()], needed.count()
    for r in marked:
        if r.expired:
            fs, p = _fs(spark, f"{root}/_snapshots/date={r.snapshot_date}")
            fs.delete(p, True)
    deleted = 0
    for path in swept:
        fs, p = _fs(spark, f"{root}/{path}")
        deleted += bool(fs.exists(p) and fs.delete(p, False))
    return spark.createDataFrame([(sum(r.expired for r in marked), sum(not r.expired for r in marked), deleted, n_needed)],
                                 "n_pruned long, n_kept long, n_files_deleted long, n_files_kept long")
