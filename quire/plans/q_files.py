"""Registered queries: files written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import triage as TR
from ..sinks import files as FS
from ..sources import feeds as S
from ..sources import fixtures as X
from ..streaming.streams import scratch_dir
from .registry import register


@register("write_candidates", views=("judgements",), sql="""
select model, paper_id, date '2024-03-15' as run_date from judgements""")
def q_write_candidates(spark, sf):
    """SNK-01: each model's ids by run date; a repeated run replaces its own day only."""
    root, out = scratch_dir(spark, "candidates"), None
    picks = X.judgements(spark, sf)
    for model in ("m1", "m2", "m3"):
        own = picks.filter(F.col("model") == model)
        for day in ("2024-03-14", "2024-03-15", "2024-03-15"):
            FS.write_candidates(own, f"{root}/{model}", day)
        back = spark.read.schema("paper_id string, run_date date").json(f"{root}/{model}").filter("run_date = '2024-03-15'").withColumn("model", F.lit(model))
        out = back if out is None else out.unionByName(back)
    return out.select("model", "paper_id", "run_date")


@register("write_raw_judgements", views=("judgements",), sql="""
select model, paper_id, relevance_tier, date '2024-03-15' as run_date from judgements""")
def q_write_raw_judgements(spark, sf):
    """SNK-02: raw judge output by run date and model."""
    path = scratch_dir(spark, "raw")
    for model in ("m1", "m2", "m3"):
        FS.write_raw_judgements(X.judgements(spark, sf).filter(F.col("model") == model).drop("model"), path, "2024-03-15", model)
    return spark.read.schema("paper_id string, relevance_tier string, run_date date, model string").json(path).select("model", "paper_id", "relevance_tier", "run_date")


@register("write_filtered", views=("papers",), sql="""
select paper_id, title, relevance_tier, date '2024-03-15' as run_date from papers where relevance_tier in ('high', 'moderate')""")
def q_write_filtered(spark, sf):
    """SNK-03: the final list of a run; writing the day again replaces it."""
    path = scratch_dir(spark, "filtered")
    papers = X.papers(spark, sf).select("paper_id", "title", "relevance_tier")
    FS.write_filtered(papers, path, "2024-03-15")
    FS.write_filtered(TR.valid_judgements(papers)[0], path, "2024-03-15")
    return spark.read.parquet(path)


@register("read_papers", views=("records",), sql="""
select paper_id, title, array_to_string(authors, '|') as authors_joined, abstract, comment, array_to_string(categories, '|') as categories_joined,
  published, pdf_url, abs_url from records""")
def q_read_papers(spark, sf):
    """SRC-06 + SNK-04: papers written as JSON and read with the paper schema."""
    path = scratch_dir(spark, "papers")
    recs = X.paper_records(spark, sf).withColumnRenamed("paper_id", "arxiv_id")
    FS.write_papers(recs.select(*[f.name for f in S.PAPER_FILE.fields if f.name in recs.columns]), path)
    return S.read_papers(spark, path, lines=True).select(
        "paper_id", "title", F.array_join("authors", "|").alias("authors_joined"), "abstract", "comment",
        F.array_join("categories", "|").alias("categories_joined"), "published", "pdf_url", "abs_url")


@register("write_markdown", views=("records",), sql="""
select date_added as run_date, count(*) as n_papers, string_agg(paper_id, ' ' order by paper_id) as ids from records group by date_added""")
def q_write_markdown(spark, sf):
    """SNK-05: the digest as text files; a date's files, by name, hold its papers in order."""
    path = scratch_dir(spark, "digest")
    recs = X.paper_records(spark, sf).withColumnRenamed("date_added", "run_date")
    FS.write_markdown(FS.papers_markdown(recs.withColumn("abstract", F.regexp_replace("abstract", "[\\r\\n]", " ")), "cs.CV"), path)
    lines = spark.read.schema("value string, run_date string").text(path).select(
        "run_date", F.col("_metadata.file_name").alias("f"), F.monotonically_increasing_id().alias("n"), F.regexp_extract("value", r"^\*\*arXiv ID:\*\* \[([^\]]*)\]", 1).alias("p"))
    found = lines.filter("p <> ''").groupBy("run_date").agg(F.array_sort(F.collect_list(F.struct("f", "n", "p"))).alias("l"))
    return found.select("run_date", F.size("l").cast("long").alias("n_papers"), F.array_join(F.transform("l", lambda x: x["p"]), " ").alias("ids"))
