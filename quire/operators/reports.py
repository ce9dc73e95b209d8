"""Quality and operations reports: coverage, model comparison, snapshot and
ingest bookkeeping, stale feed days and the criteria quality signals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import short_model_name, tier_letter
from ..functions.urls import classify_urls
from ..schemas import CACHE_MIN_BYTES, SNAPSHOT_MIN_BYTES, SNAPSHOT_RETENTION_DAYS
from .ordering import ordered_positions

# ---------------------------------------------------------------------------
# Quality signals named by the criteria document.
# ---------------------------------------------------------------------------
VENUES = ("CVPR", "ICCV", "ECCV", "NeurIPS", "SIGGRAPH")
PROMISES_CODE = r"(?i)code (will be|is|to be) (released|available|made available)"


def _pct(part: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0)).otherwise(F.floor(F.lit(100) * part / total)).cast("long")


def coverage(catalog: DataFrame) -> DataFrame:
    """AG-02: per date total, with thumbnail, with code and integer-floor percentages."""
    g = catalog.groupBy("date_added").agg(
        F.count(F.lit(1)).alias("total"), F.count("thumbnail").alias("with_thumbnail"),
        F.count("code_url").alias("with_code"))
    return g.select("date_added", "total", "with_thumbnail", "with_code",
                    _pct(F.col("with_thumbnail"), F.col("total")).alias("pct_thumbnail"),
                    _pct(F.col("with_code"), F.col("total")).alias("pct_code"))


# ---------------------------------------------------------------------------
# Model comparison (AG-05..07, JN-10, SO-05, ST-04, CP-09)
# ---------------------------------------------------------------------------
def model_summary(candidates: DataFrame, judgements: DataFrame) -> DataFrame:
    """AG-05: per model the stage-1 candidate count (duplicates counted) and
    the stage-2 count."""
    c = candidates.groupBy("model").agg(F.count(F.lit(1)).alias("n_candidates"))
    j = judgements.groupBy("model").agg(F.count(F.lit(1)).alias("n_final"))
    return (c.join(j, "model", "full_outer")
             .select("model", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
                     F.coalesce("n_final", F.lit(0)).alias("n_final")))


def distinct_union_picks(judgements: DataFrame) -> DataFrame:
    """ST-04: ids picked by any model."""
    return judgements.select("paper_id").distinct()


def union_of_picks(judgements: DataFrame, approx: bool = False) -> DataFrame:
    """AG-06: number of distinct picked ids (``approx`` for HyperLogLog at scale)."""
    f = F.approx_count_distinct if approx else F.count_distinct
    return judgements.agg(f("paper_id").alias("n_union"))


def title_lookup(picks: DataFrame, papers: DataFrame, width: int = 58) -> DataFrame:
    """JN-10: title of each pick, ``?`` when unknown, cut to ``width`` chars."""
    t = papers.select("paper_id", "title")
    return picks.join(t, "paper_id", "left").withColumn(
        "title", F.left(F.coalesce("title", F.lit("?")), F.lit(width)))


def agreement_matrix(judgements: DataFrame, models: list[str], failed: list[str] = (),
                     pos: str | None = None) -> DataFrame:
    """AG-07: one row per picked id, one column per model: the tier's first
    letter upper-cased, ``''`` if not picked, ``ERR`` for a failed model; a
    duplicate pick uses the first (smallest ``pos``).

    A model failed if it is in ``failed`` or, where the rows carry a ``status``
    (:func:`~quire.operators.triage.judge`), if all its rows say ``failed``: that is known only while the job runs."""
    ok_models = [m for m in models if m not in failed]
    rows = judgements.filter(F.col("model").isin(ok_models))
    j = rows.filter(F.col("paper_id").isNotNull())
    val = F.coalesce(F.col("relevance_tier"), F.lit("?"))
    agg = F.min_by(val, pos) if pos else F.min(val)
    piv = j.groupBy("paper_id").pivot("model", ok_models).agg(agg)
    if "status" in judgements.columns:
        down = rows.groupBy("model").agg(F.min(F.col("status") == "failed").alias("down")).filter("down")
        # one array, no longer than ``models``
        piv = piv.withColumn("_down", down.agg(F.collect_set("model").alias("m")).scalar())
    cols = [F.col("paper_id")]
    for m in models:
        if m in failed:
            cols.append(F.lit("ERR").alias(m))
        else:
            cell = F.when(F.col(m).isNull(), F.lit("")).otherwise(tier_letter(F.col(m)))
            cols.append((F.when(F.array_contains("_down", m), F.lit("ERR")).otherwise(cell) if "status" in judgements.columns else cell).alias(m))
    return piv.select(*cols)


def sorted_picks(picks: DataFrame) -> DataFrame:
    """SO-05: picks ordered by id, with their position ``pos``."""
    return ordered_positions(picks, [], ["paper_id"], "pos").orderBy("pos")


def compare_models(papers: DataFrame, runs: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """CP-09: run each model's triage over the same papers; the union carries a
    ``model`` column (one lazy plan per model, one shuffle for the pivot). Where a run returns the
    ``status`` of its rows, the status rows of its batches travel with its picks, so that
    :func:`agreement_matrix` sees a model that failed while it ran."""
    out = None
    for name, run in runs.items():
        r = run(papers)
        status = F.col("status") if "status" in r.columns else F.lit("ok")
        r = r.select("paper_id", "relevance_tier", status.alias("status")).withColumn("model", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out


def model_short_names(models: DataFrame) -> DataFrame:
    """PR-09 over a table of model names."""
    return models.withColumn("short", short_model_name("model"))


# ---------------------------------------------------------------------------
# Bookkeeping (FL-13, SNK-08/09, CP-10, CP-11)
# ---------------------------------------------------------------------------
def not_yet_ingested(requested: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """FL-13: requested dates whose cached output is missing or too small."""
    if force:
        return requested
    done = manifest.filter(F.col("n_bytes") > CACHE_MIN_BYTES).select("date_added")
    return requested.join(done, "date_added", "left_anti")


def snapshot_manifest_row(catalog: DataFrame, snap_date, path: str) -> DataFrame:
    """SNK-08: the manifest row of a snapshot that is a copy (rows, bytes of its two texts in UTF-8, size warning); of a stored
    catalog :func:`quire.sinks.catalog_store.snapshot` gives the bytes as written."""
    bytes_col = F.sum(F.octet_length(F.coalesce("abstract", F.lit(""))) + F.octet_length(F.coalesce("title", F.lit(""))))
    return catalog.agg(F.count(F.lit(1)).alias("n_rows"), bytes_col.cast("long").alias("n_bytes")).select(
        F.lit(snap_date).cast("date").alias("snapshot_date"), F.lit(path).alias("path"), "n_rows", "n_bytes",
        (F.col("n_bytes") < SNAPSHOT_MIN_BYTES).alias("warn_small"))


def expired_snapshots(manifest: DataFrame, as_of, days: int = SNAPSHOT_RETENTION_DAYS) -> DataFrame:
    """SNK-09: snapshots more than ``days`` whole days old (i.e. >= days + 1)."""
    return manifest.withColumn("expired", F.datediff(F.lit(as_of).cast("date"), F.col("snapshot_date")) > days)


def stale_weekdays(catalog: DataFrame, start, end) -> DataFrame:
    """CP-10: Monday-Friday dates in [start, end] without any paper."""
    days = catalog.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date_added"))
    weekdays = days.filter(F.weekday("date_added") < 5)
    return weekdays.join(catalog.select("date_added").distinct(), "date_added", "left_anti")


def run_dates(requested: DataFrame, announced: Column, today) -> DataFrame:
    """CP-11: backfill (an explicit date) fetches and ingests under that date;
    the automatic run fetches by the announcement date and ingests under today."""
    t = F.lit(today).cast("date")
    explicit = F.col("requested_date").isNotNull()
    return requested.select(
        "requested_date",
        F.when(explicit, F.col("requested_date")).otherwise(F.coalesce(announced, t)).alias("fetch_date"),
        F.when(explicit, F.col("requested_date")).otherwise(t).alias("ingest_date"))


# ---------------------------------------------------------------------------
# CP-12 quality signals
# ---------------------------------------------------------------------------
def quality_signals(papers: DataFrame, known_authors: DataFrame | None = None) -> DataFrame:
    """CP-12: (paper_id, has_code, promises_code, venue, known_author)."""
    _, code = classify_urls(F.col("comment"), F.col("abstract"))
    text = F.concat_ws(" ", F.coalesce("comment", F.lit("")), F.coalesce("abstract", F.lit("")))
    venue = F.nullif(F.regexp_extract(text, r"\b(" + "|".join(VENUES) + r")\b", 1), F.lit(""))
    out = papers.select("paper_id", "authors", (F.size(code) > 0).alias("has_code"),
                        text.rlike(PROMISES_CODE).alias("promises_code"), venue.alias("venue"))
    if known_authors is None:
        return out.withColumn("known_author", F.lit(False)).drop("authors")
    # authors are matched by an equi-join on the exploded names (no broadcast
    # of an unbounded author list)
    hits = (out.select("paper_id", F.explode("authors").alias("author"))
            .join(known_authors.select("author").distinct(), "author", "left_semi")
            .select("paper_id").distinct().withColumn("known_author", F.lit(True)))
    return (out.drop("authors").join(hits, "paper_id", "left")
            .withColumn("known_author", F.coalesce("known_author", F.lit(False))))
