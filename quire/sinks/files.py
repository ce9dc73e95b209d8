"""File sinks (SNK-01..05, SNK-08): partitioned, idempotent writes.

Every writer overwrites only the partitions it produces (dynamic partition
overwrite), so re-running a day replaces that day and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cap_authors
from ..operators.ordering import ordered_positions
from ..operators.reports import snapshot_manifest_row
from ..schemas import DIGEST_AUTHOR_CAP

# ---------------------------------------------------------------------------
# The Markdown digest layout.
# ---------------------------------------------------------------------------
MD_TITLE = "# arXiv {category} Papers - "
MD_TOTAL = "**Total papers: "
MD_RULE = "---"
MD_PDF = "📄 [PDF]("
MD_ABS = "🔗 [arXiv]("


def _writer(df: DataFrame, *partition_by: str):
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    return w.partitionBy(*partition_by) if partition_by else w


def write_candidates(ids: DataFrame, path: str, run_date) -> None:
    """SNK-01: candidate ids of a run, one JSON row per id, partitioned by date."""
    out = ids.select("paper_id").withColumn("run_date", F.lit(run_date).cast("date"))
    _writer(out, "run_date").json(path)


def write_raw_judgements(judged: DataFrame, path: str, run_date, model: str = "default") -> None:
    """SNK-02: raw judge output, partitioned by (run_date, model)."""
    out = judged.withColumn("run_date", F.lit(run_date).cast("date")).withColumn("model", F.lit(model))
    _writer(out, "run_date", "model").json(path)


def write_filtered(judged: DataFrame, path: str, run_date) -> None:
    """SNK-03: the final list of a run (Parquet, date partition replaced)."""
    _writer(judged.withColumn("run_date", F.lit(run_date).cast("date")), "run_date").parquet(path)


def write_papers(papers: DataFrame, path: str) -> None:
    """SNK-04: fetched papers as JSON lines; an empty result still leaves a readable
    (empty) dataset because the schema travels with the reader (SRC-06 with ``lines``)."""
    papers.write.mode("overwrite").json(path)


def papers_markdown(papers: DataFrame, category: str, order=("paper_id",)) -> DataFrame:
    """SNK-05: (run_date, pos, block) - a header block (pos 0) per run date,
    then one numbered block per paper; write with ``partitionBy('run_date')``."""
    numbered = ordered_positions(papers, ["run_date"], list(order), "pos")
    nl = "\n"
    block = F.concat(
        F.lit("## "), F.col("pos").cast("string"), F.lit(". "), F.col("title"), F.lit(nl * 2),
        F.lit("**arXiv ID:** ["), F.col("paper_id"), F.lit("]("), F.col("abs_url"), F.lit(")" + nl * 2),
        F.lit("**Authors:** "), cap_authors("authors", DIGEST_AUTHOR_CAP, True), F.lit(nl * 2),
        F.lit("**Categories:** "), F.array_join("categories", ", "), F.lit(nl * 2),
        F.lit("### Abstract" + nl * 2), F.col("abstract"), F.lit(nl * 2),
        F.lit(MD_PDF), F.col("pdf_url"), F.lit(") | " + MD_ABS), F.col("abs_url"), F.lit(")" + nl * 2),
        F.lit(MD_RULE + nl))
    blocks = numbered.select("run_date", "pos", block.alias("block"))
    headers = papers.groupBy("run_date").agg(F.count(F.lit(1)).alias("n")).select(
        "run_date", F.lit(0).cast("long").alias("pos"),
        F.concat(F.lit(MD_TITLE.format(category=category)), F.col("run_date").cast("string"), F.lit(nl * 2),
                 F.lit(MD_TOTAL), F.col("n").cast("string"), F.lit("**" + nl * 2 + MD_RULE + nl)).alias("block"))
    return headers.unionByName(blocks)


def write_markdown(blocks: DataFrame, path: str) -> None:
    """Write SNK-05 blocks as one text directory per run date. A date of any size is written by as many tasks as it needs;
    its files, by name, hold the blocks in order."""
    (blocks.repartitionByRange("run_date", "pos").sortWithinPartitions("run_date", "pos")
        .select("run_date", "block").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_date").text(path))


def snapshot_catalog(catalog: DataFrame, root: str, snap_date) -> DataFrame:
    """SNK-08: copy the catalog to ``root/snapshots/date=D`` and append its
    manifest row to ``root/manifest``; returns the manifest row."""
    path = f"{root}/snapshots/date={snap_date}"
    catalog.write.mode("overwrite").parquet(path)
    written = catalog.sparkSession.read.parquet(path)
    row = snapshot_manifest_row(written, snap_date, path)
    # one manifest folder per date, so a repeated run replaces its row
    row.write.mode("overwrite").parquet(f"{root}/manifest/snapshot={snap_date}")
    return row
