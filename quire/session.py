"""Spark session helpers.

Cluster settings (shuffle partitions, executor memory, checkpoint dir) belong
to whoever launches the job; the helpers here only fill in what is unset, so
the same code runs under ``spark-submit`` on a cluster and in local tests.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every plan in this package relies on. AQE re-plans joins and
# coalesces shuffle partitions at run time; skew-join splits hot keys; the
# session time zone is pinned so DATE/TIMESTAMP arithmetic is reproducible.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpoint files (ordered positions, materialised intermediates) are
    # deleted once their DataFrame is garbage-collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "quire", driver_memory: str | None = None) -> SparkSession:
    """Build (or reuse) a session with the package defaults.

    ``master``, ``shuffle_partitions`` and ``driver_memory`` are for local runs
    and tests only (in local mode every task runs inside the driver JVM, whose
    default heap is 1 GB); on a cluster leave them ``None`` so the launcher's
    values stand.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.memory",
                                     driver_memory or os.environ.get("QUIRE_DRIVER_MEMORY", "12g"))
            # JVM log warnings (e.g. GC) to stderr, so stdout stays clean for results
            builder = builder.config("spark.driver.extraJavaOptions", "-Xlog:all=warning:stderr")
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory named by the cluster.

    ``spark.checkpoint.dir`` is read from the session. Only when it is unset
    (local tests) is a scratch directory created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="quire-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint dir (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
