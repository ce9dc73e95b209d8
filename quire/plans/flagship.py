"""The flagship plan: one day's triage end to end.

papers --stage 1 (titles, generous)--> candidate ids --left-semi--> candidates
       --stage 2 (abstracts, strict)--> judged --upsert--> catalog
       --latest date, sections--> shown papers with their card links

One lazy plan; the abstract column is only read for the candidates, and the
catalog merge is a single keyed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import card_links
from ..operators import catalog as C
from ..operators import triage as TR
from ..operators import views as V
from ..session import cut_lineage
from ..sources import fixtures as X

RUN_DATE = "2024-02-01"


def flagship(spark: SparkSession, sf_dir: str, run_date: str = RUN_DATE) -> DataFrame:
    records = X.paper_records(spark, sf_dir)
    crit = X.criteria(spark)
    judged = TR.triage(records, crit)
    # yesterday's catalog: every paper already known, with the users' actions
    catalog = X.catalog(spark, sf_dir)
    incoming = judged.select("paper_id", "title", "authors", "abstract", "comment", "categories",
                             "published", "pdf_url", "abs_url", "relevance_tier", "relevance_summary")
    # the new catalog version: production commits it through catalog_store;
    # here it is checkpointed, and the views read it back instead of
    # recomputing the whole triage for each of their passes
    merged = cut_lineage(C.upsert_catalog(catalog, incoming, run_date))
    newest = V.latest_date(merged)  # one row
    latest = merged.join(F.broadcast(newest), "date_added", "left_semi")
    shown = V.sectioned_view(latest, materialize=False)  # input is the checkpointed version
    links = card_links(F.col("project_url"), F.col("code_url"), F.col("abstract"), F.col("comment"))
    return shown.select(
        "date_added", "section", "pos", "paper_id", "title", "relevance_tier", "relevance_summary",
        "is_favourite",
        F.array_join(F.transform(links, lambda lk: F.concat(lk["label"], F.lit(":"), lk["url"])), " ")
        .alias("links"))
