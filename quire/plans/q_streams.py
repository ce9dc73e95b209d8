"""Registered queries: Structured Streaming runs (stream == batch)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sinks import catalog_store
from ..sources import fixtures as X
from ..streaming import streams as ST
from .registry import register


def _interactions_stream(spark, sf):
    return ST.interactions_from_events(ST.table_stream(spark, sf, "events", ST.EVENTS))


@register("stream_interactions", views=("folded",), sql="""
select doc_id, n_favourite, n_dismiss, last_note as note from folded""")
def q_stream_interactions(spark, sf):
    out = ST.run_available(ST.stream_interactions(_interactions_stream(spark, sf)), "stream_interactions", "update", key="doc_id")
    return out.select("doc_id", "n_favourite", "n_dismiss", F.col("last_note").alias("note"))


@register("stream_interactions_drops", views=("folded",), sql="""
select run, doc_id, n_favourite, n_dismiss, last_note as note from folded, (values (1), (2)) r(run)""")
def q_stream_interactions_drops(spark, sf):
    """Three drops of the log on one checkpoint, then a run without new files: both return the batch fold."""
    root = ST.scratch_dir(spark, "drops")
    events, out = X.table(spark, sf, "events"), None
    for drop in range(3):
        events.filter(F.col("event_id") % 3 == drop).write.mode("append").parquet(f"{root}/events")
        if drop < 2:
            _drops_so_far(spark, root)
    for run in (1, 2):
        rows = cut_lineage(_drops_so_far(spark, root)).withColumn("run", F.lit(run))
        out = rows if out is None else out.unionByName(rows)
    return out.select("run", "doc_id", "n_favourite", "n_dismiss", F.col("last_note").alias("note"))


def _drops_so_far(spark, root):
    src = spark.readStream.schema(ST.EVENTS).parquet(f"{root}/events")
    return ST.run_available(ST.stream_interactions(ST.interactions_from_events(src)), "drops", "update", f"{root}/ckpt", key="doc_id")


@register("stream_dedupe", views=("interactions",), sql="select seq, action from interactions")
def q_stream_dedupe(spark, sf):
    # the same log delivered twice (two sources): every event must come out once
    twice = _interactions_stream(spark, sf).unionByName(_interactions_stream(spark, sf))
    out = ST.run_available(ST.stream_dedupe(twice, "seq", "2 days"), "stream_dedupe", mode="append")
    return out.select("seq", "action")


@register("stream_daily_counts", sql="""
select cast(date_trunc('day', ts) as date) as day, count(*) as n from events group by 1""")
def q_stream_daily_counts(spark, sf):
    ev = ST.table_stream(spark, sf, "events", ST.EVENTS)
    return ST.run_available(ST.stream_daily_counts(ev, "1 day"), "stream_daily_counts", mode="complete")


@register("stream_ingest", views=("records",), sql="""
select paper_id, title, date '2024-02-01' as date_added from records""")
def q_stream_ingest(spark, sf):
    root = ST.scratch_dir(spark, "stream-ingest")
    recs = X.paper_records(spark, sf).select(
        F.col("paper_id").alias("arxiv_id"), "title", "authors", "abstract", "comment", "categories",
        "published", "updated", "pdf_url", "abs_url", F.floor(F.col("doc_id") / 250).alias("drop"))
    # four landed drops, one directory each (the driver tables stand in for the feed)
    recs.write.partitionBy("drop").json(f"{root}/landing")
    ST.stream_ingest(spark, f"{root}/landing", f"{root}/catalog", "2024-02-01")
    return catalog_store.read_catalog(spark, f"{root}/catalog").select("paper_id", "title", "date_added")


@register("stream_ingest_twice", views=("records",), sql="""
select count(distinct paper_id) as n_papers, 2 as n_commits,
  count(*) filter (where doc_id % 10 in (3, 4)) as n_rejected, count(*) filter (where doc_id % 10 = 3) as n_missing_id
from (select doc_id, case when doc_id % 10 not in (3, 4) then paper_id end as paper_id from records)""")
def q_stream_ingest_twice(spark, sf):
    """SM-01: two drops with rows that have no id or no title; the second batch is delivered twice."""
    root, doc = ST.scratch_dir(spark, "ingest-twice"), F.col("doc_id")
    recs = X.paper_records(spark, sf).select(
        "doc_id", F.when(doc % 10 != 3, F.col("paper_id")).alias("arxiv_id"), F.when(doc % 10 != 4, F.col("title")).alias("title"), "abstract")
    for drop in (0, 1):
        recs.filter(doc % 2 == drop).drop("doc_id").write.mode("append").json(f"{root}/landing")
        ST.stream_ingest(spark, f"{root}/landing", f"{root}/catalog", "2024-02-01", f"{root}/ckpt")
    again = recs.filter(doc % 2 == 1).drop("doc_id").withColumnRenamed("arxiv_id", "paper_id").withColumn("_file", F.struct(F.lit("x").alias("path")))
    ST.merge_batch(f"{root}/catalog", "2024-02-01", f"{root}/ckpt")(again, 1)
    papers = catalog_store.read_catalog(spark, f"{root}/catalog").agg(F.count_distinct("paper_id").alias("n_papers"))
    commits = catalog_store.history(spark, f"{root}/catalog").agg(F.count(F.lit(1)).cast("int").alias("n_commits"))
    bad = catalog_store.rejected(spark, f"{root}/catalog").agg(F.count(F.lit(1)).alias("n_rejected"), F.count_if(F.col("reject_reason") == "missing_id").alias("n_missing_id"))
    return papers.select("n_papers", commits.scalar().alias("n_commits"), bad.select("n_rejected").scalar().alias("n_rejected"),
                         bad.select("n_missing_id").scalar().alias("n_missing_id"))


# Four commits into one catalog: papers by quarter of their id's months, then new titles for one month.
def _stored(spark, sf, root):
    doc = F.col("doc_id")
    recs = X.paper_records(spark, sf).select("paper_id", "doc_id", "title", "abstract")
    for part, day in enumerate(("2024-01-01", "2024-01-02", "2024-01-03")):
        catalog_store.upsert(spark, root, recs.filter(F.floor(doc % 12 / 4) == part), day)
    catalog_store.upsert(spark, root, recs.filter(doc % 12 == 5).withColumn("title", F.concat(F.lit("U "), "title")), "2024-01-04")
    return root


STORED_SQL = """select paper_id, case when doc_id % 12 = 5 then concat('U ', title) else title end as title,
  date '2024-01-01' + cast(doc_id % 12 // 4 as int) as date_added from records"""


@register("catalog_upserts", views=("records",), sql=STORED_SQL)
def q_catalog_upserts(spark, sf):
    root = _stored(spark, sf, ST.scratch_dir(spark, "catalog"))
    return catalog_store.read_catalog(spark, root).select("paper_id", "title", "date_added")


@register("catalog_history", views=("records",), sql="""
select cast(v as bigint) as v, v = 4 as opened_some, true as opened_few, true as rewrote_what_it_opened from (values (1), (2), (3), (4)) t(v)""")
def q_catalog_history(spark, sf):
    """SNK-07: the first three batches open no file, since their ids lie in no file's range; the fourth a third of them."""
    root = _stored(spark, sf, ST.scratch_dir(spark, "catalog"))
    h = catalog_store.history(spark, root)
    return h.select("v", (F.col("n_opened") > 0).alias("opened_some"), (3 * F.col("n_opened") <= F.col("n_live")).alias("opened_few"),
                    (F.col("n_rewritten") <= F.col("n_opened")).alias("rewrote_what_it_opened"))


@register("catalog_snapshots", views=("records",), s=STORED_SQL, sql="""
select cast(1 as bigint) as n_pruned, cast(1 as bigint) as n_kept, (select count(*) from s) as n_rows, true as bytes_written, true as files_deleted,
  (select count(*) from s where starts_with(title, 'U ')) as n_updated, cast(0 as bigint) as n_left""")
def q_catalog_snapshots(spark, sf):
    """SNK-08/09: two snapshots, a later batch, retention of the second, and a read of it afterwards."""
    root = _stored(spark, sf, ST.scratch_dir(spark, "catalog"))
    catalog_store.snapshot(spark, root, "2024-01-01")
    catalog_store.compact(spark, root)
    row = catalog_store.snapshot(spark, root, "2024-02-01")
    recs = X.paper_records(spark, sf).select("paper_id", F.lit("later").alias("title"))
    catalog_store.upsert(spark, root, recs, "2024-02-02")
    done = catalog_store.prune(spark, root, "2024-02-10")
    kept = catalog_store.read_snapshot(spark, root, "2024-02-01").agg(
        F.count_if(F.col("title").startswith("U ")).alias("n_updated"), F.count_if(F.col("title") == "later").alias("n_left"))
    return done.select("n_pruned", "n_kept", row.select("n_rows").scalar().alias("n_rows"), (row.select("n_bytes").scalar() > 0).alias("bytes_written"),
                       (F.col("n_files_deleted") > 0).alias("files_deleted"), kept.select("n_updated").scalar().alias("n_updated"), kept.select("n_left").scalar().alias("n_left"))


def _flagship_sql():
    from .q_enrich import _card_text_sql
    from .q_triage import STAGE2_CTES
    ab_code, ab_proj = _card_text_sql("abstract")
    cm_code, cm_proj = _card_text_sql("comment")
    ctes = dict(STAGE2_CTES)
    ctes["merged"] = """select c.paper_id, c.title, c.abstract, c.comment, c.date_added, c.is_favourite,
  case when j.paper_id is not null then j.relevance_tier else c.relevance_tier end as relevance_tier,
  j.relevance_summary as relevance_summary
from catalog c left join (select * from judged where relevance_tier is not null) j using (paper_id)"""
    ctes["shown"] = """select *, case when is_favourite then 'favourites' when relevance_tier = 'high' then 'high'
  when relevance_tier = 'moderate' then 'moderate' end as section
from merged where date_added = (select max(date_added) from merged)"""
    body = f"""
select date_added, section, cast(row_number() over (partition by date_added, section
    order by case relevance_tier when 'high' then 0 when 'moderate' then 1 else 2 end, title, paper_id) as bigint) as pos,
  paper_id, title, relevance_tier, relevance_summary, is_favourite,
  array_to_string(list_transform(list_filter(cand, lambda s, i: list_position(list_transform(cand, lambda t: t.url), s.url) = i),
                                 lambda x: concat(x.label, ':', x.url)), ' ') as links
from (select *, list_concat({ab_code}, {ab_proj}, {cm_code}, {cm_proj}) as cand from shown where section is not null)"""
    return dict(views=("papers", "criteria", "catalog"), sql=body, **ctes)


@register("flagship", **_flagship_sql())
def q_flagship(spark, sf):
    """The end-to-end plan of ``entry``."""
    from .flagship import flagship
    return flagship(spark, sf)
