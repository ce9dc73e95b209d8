"""Registered queries: feed / page / JSON sources rendered from the fixture
papers and parsed back, plus the primary/fallback fetch merge."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import fetch as FE
from ..operators.ordering import ordered_positions
from ..sources import feeds as S
from ..sources import fixtures as X
from .registry import register
from .text_sql import collapse_sql, escape_sql

COLLAPSED = f"""paper_id, {collapse_sql('title')} as title, {collapse_sql('abstract')} as abstract"""


def _numbered(spark, sf, size=50, cols=("paper_id", "doc_id", "title", "relevance_tier")):
    """Fixture records (narrow) numbered by id, in request batches of ``size``."""
    r = ordered_positions(X.paper_records(spark, sf).select(*cols), [], ["paper_id"], "pos")
    return r.withColumn("batch_id", F.floor((F.col("pos") - 1) / size).cast("long"))


def _atom_papers(spark, sf, keep=None):
    # request batches of at most 50 ids cut by document id (ids are unique),
    # entries in id order - no global numbering of the wide records needed
    b = (X.paper_records(spark, sf).withColumn("pos", F.col("doc_id"))
         .withColumn("batch_id", F.floor(F.col("doc_id") / 50).cast("long")))
    if keep is not None:
        b = b.filter(keep)
    return S.parse_entries(S.render_atom_feeds(b), keep=("batch_id",))


@register("parse_entries", views=("records",), sql=f"""
select {COLLAPSED}, case when comment is null then null else {collapse_sql('comment')} end as comment,
  array_to_string(authors, '|') as authors_joined, array_to_string(categories, '|') as categories_joined,
  published, pdf_url, abs_url from records""")
def q_parse_entries(spark, sf):
    p = _atom_papers(spark, sf)
    return p.select("paper_id", "title", "abstract", "comment",
                    F.array_join("authors", "|").alias("authors_joined"),
                    F.array_join("categories", "|").alias("categories_joined"),
                    "published", "pdf_url", "abs_url")


def _rss(spark, sf):
    r = X.paper_records(spark, sf).select("paper_id", F.col("date_added").cast("date").alias("announced"))
    r = ordered_positions(r, ["announced"], ["paper_id"], "pos").withColumn(
        "feed", F.date_format("announced", "yyyy-MM-dd"))
    return S.render_rss(r, "feed")


def _feed_key(rss):
    # one feed per date, split into bounded parts: (feed, part) is the document key
    return rss.withColumn("doc", F.concat_ws("#", "feed", F.col("part").cast("string")))


@register("feed_item_ids", views=("papers",), sql="""
select date_added as feed, cast(row_number() over (partition by date_added order by paper_id) - 1 as int) as pos, paper_id
from papers""")
def q_feed_item_ids(spark, sf):
    ids = S.feed_item_ids(_feed_key(_rss(spark, sf)), "xml", "doc")
    feed, part = F.split("doc", "#")[0], F.split("doc", "#")[1].cast("int")
    return ids.select(feed.alias("feed"), (part * S.RSS_MAX_ITEMS + F.col("pos")).cast("int").alias("pos"),
                      "paper_id")


@register("feed_announcement_date", views=("papers",), sql="""
select distinct date_added as feed, cast(date_added as date) as announced from papers""")
def q_feed_date(spark, sf):
    d = S.feed_announcement_date(_feed_key(_rss(spark, sf)), "xml", "doc")
    return d.select(F.split("doc", "#")[0].alias("feed"), "announced").distinct()


def _listing(spark, sf):
    r = X.paper_records(spark, sf).select("paper_id", F.col("date_added").cast("date").alias("announced"))
    r = r.withColumn("page", F.floor(F.datediff("announced", F.lit("2024-01-01").cast("date")) / 7).cast("long"))
    r = ordered_positions(r, ["page", "announced"], ["paper_id"], "pos")
    return S.render_listing(r, "page")


@register("listing_ids_by_date", views=("papers",), sql="""
select cast(floor(datediff('day', date '2024-01-01', cast(date_added as date)) / 7) as bigint) as page,
  cast(date_added as date) as announced, paper_id,
  cast(row_number() over (partition by date_added order by paper_id) as bigint) as pos_in_date from papers""")
def q_listing(spark, sf):
    ids = S.listing_ids_by_date(_listing(spark, sf), "html", "page")
    ids = ids.withColumn("part", F.col("page.part")).withColumn("page", F.col("page.page"))
    # position inside the date = entries on earlier parts + position on this page
    w = Window.partitionBy("page", "announced", "part").orderBy("pos")
    return ids.select("page", "announced", "paper_id",
                      (F.col("part") * S.LISTING_MAX_ENTRIES + F.row_number().over(w)).cast("long").alias("pos_in_date"))


def _abs_pages(spark, sf):
    r = X.paper_records(spark, sf)
    return r.select("paper_id", S.render_abs_page(F.struct(*r.columns)).alias("html"))


@register("parse_abs_pages", views=("records",), sql=f"""
select {COLLAPSED},
  array_to_string(list_transform(authors, lambda a: concat(split_part(a, ', ', 2), ' ', split_part(a, ', ', 1))), '|') as authors_joined,
  case when comment is null then null else {collapse_sql(escape_sql('comment'))} end as comment,
  array_to_string(categories, '|') as categories_joined, published, pdf_url from records""")
def q_parse_abs(spark, sf):
    p = S.parse_abs_pages(_abs_pages(spark, sf))
    return p.select("paper_id", "title", "abstract", F.array_join("authors", "|").alias("authors_joined"),
                    "comment", F.array_join("categories", "|").alias("categories_joined"), "published", "pdf_url")


def _bodies(spark, sf):
    b = _numbered(spark, sf, cols=("paper_id", "doc_id", "title", "abstract", "comment", "relevance_tier"))
    rec = F.struct(F.col("paper_id").alias("arxiv_id"), "title", "abstract", "comment", "relevance_tier")
    per = b.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("pos", rec.alias("r")))).alias("_l"))
    body = F.when(F.col("batch_id") % 7 == 3, F.lit('{"papers": []}')).otherwise(
        F.to_json(F.transform("_l", lambda x: x["r"])))
    return per.select(F.col("batch_id").alias("request"), body.alias("body"))


@register("parse_ingest_payload", views=("papers",), sql="""
select request, case when request % 7 = 3 then null else pos end as pos,
  case when request % 7 = 3 then null else paper_id end as paper_id,
  case when request % 7 = 3 then null else title end as title,
  case when request % 7 = 3 then null else abstract end as abstract,
  case when request % 7 = 3 then null else comment end as comment,
  case when request % 7 = 3 then null else relevance_tier end as relevance_tier,
  case when request % 7 = 3 then 'Expected a JSON array' end as error
from (select paper_id, title, abstract, comment, relevance_tier, cast(floor((rn - 1) / 50) as bigint) as request, cast((rn - 1) % 50 as int) as pos
      from (select *, row_number() over (order by paper_id) as rn from papers))
where request % 7 <> 3 or pos = 0""")
def q_ingest_payload(spark, sf):
    return S.parse_ingest_payload(_bodies(spark, sf)).select("request", "pos", "paper_id", "title", "abstract", "comment",
                                                             "relevance_tier", "error")


def _fetch_inputs(spark, sf):
    ids = _numbered(spark, sf).select("paper_id", "pos", "doc_id")
    primary = _atom_papers(spark, sf, keep=F.col("doc_id") % 8 != 0).drop("batch_id", "feed_pos")
    secondary = S.parse_abs_pages(_abs_pages(spark, sf))
    return ids, primary, secondary


@register("papers_with_fallback", views=("papers",), sql=f"""
select paper_id, case when doc_id % 8 = 0 then 'scrape' else 'api' end as source, {collapse_sql('title')} as title
from papers""")
def q_fallback(spark, sf):
    ids, primary, secondary = _fetch_inputs(spark, sf)
    return FE.papers_with_fallback(ids, primary, secondary).select("paper_id", "source", "title")


@register("missing_from_primary", views=("papers",), sql="select paper_id from papers where doc_id % 8 = 0")
def q_missing_primary(spark, sf):
    ids, primary, _ = _fetch_inputs(spark, sf)
    return FE.missing_from_primary(ids, primary).select("paper_id")


@register("fetch_report", views=("papers",), sql="""
select count(*) as n_ids, count(*) filter (where doc_id % 8 <> 0) as n_primary,
  count(*) filter (where doc_id % 8 = 0) as n_fallback, cast(0 as bigint) as n_missing from papers""")
def q_fetch_report(spark, sf):
    ids, primary, secondary = _fetch_inputs(spark, sf)
    return FE.fetch_report(ids, FE.papers_with_fallback(ids, primary, secondary))


@register("criteria_rows", views=("criteria",), sql="""
select case tier when 'high' then 'Primary Topics' when 'moderate' then 'Secondary Topics'
  when 'low' then 'Lower Priority' else 'Exclude' end as section, topic, tier, term from criteria""")
def q_criteria_rows(spark, sf):
    doc = S.render_criteria(X.criteria(spark))
    return S.criteria_rows(doc).select("section", "topic", "tier", "term")


@register("ordered_dedupe", sql="""
select user_id, min(event_id) as first_seq, count(*) as n_events from events group by user_id""")
def q_ordered_dedupe(spark, sf):
    ev = X.table(spark, sf, "events").select("user_id", "event_id")
    return FE.ordered_dedupe(ev, ["user_id"], "event_id", "first_seq", count_as="n_events")


DOC_TERMS_SQL = """
select source, case doc_id % 4 when 0 then 'high' when 1 then 'moderate' when 2 then 'low' else 'exclude' end as tier,
  concat('lang ', lang) as topic, concat('w', cast(doc_id as varchar), ' ', lang) as term from documents where source is not null"""


def _criteria_by_source(spark, sf):
    doc = F.col("doc_id")
    tier = F.when(doc % 4 == 0, "high").when(doc % 4 == 1, "moderate").when(doc % 4 == 2, "low").otherwise("exclude")
    rows = X.table(spark, sf, "documents").filter("source is not null").select(
        "source", tier.alias("tier"), F.concat(F.lit("lang "), "lang").alias("topic"), F.concat(F.lit("w"), doc.cast("string"), F.lit(" "), "lang").alias("term"))
    return S.render_criteria(rows, by="source")


@register("criteria_documents", t=DOC_TERMS_SQL, sql="select source as doc, topic, tier, term from t where topic is not null")
def q_criteria_documents(spark, sf):
    """SRC-07: a criteria document for each source, written as Markdown files, read back whole and parsed."""
    from ..streaming.streams import scratch_dir
    path = scratch_dir(spark, "criteria")
    docs = _criteria_by_source(spark, sf)
    # a document a file: its source travels in the first line, which holds no rule
    docs.select(F.concat(F.lit("<!-- "), "doc", F.lit(" -->\n"), "text").alias("value")).repartition(4).write.option("lineSep", "\x00").text(path)
    text = S.read_criteria(spark, path).select(F.explode(F.split("text", "\x00")).alias("text")).filter("text <> ''")
    named = text.select(F.regexp_extract("text", "^<!-- (.*?) -->", 1).alias("doc"), "text")
    return S.criteria_rows(named).select("doc", "topic", "tier", "term")


@register("malformed_documents", views=("records",), sql="""
select form, batch_id, case when batch_id % 4 = 1 then concat('malformed ', form) else 'empty' end as error
from (select distinct doc_id // 50 as batch_id from records), (values ('atom'), ('json')) f(form) where batch_id % 4 in (1, 3)""")
def q_malformed_documents(spark, sf):
    """SRC-04 / SRC-09: feeds and JSON bodies that were cut short or are blank give an error row each."""
    b = X.paper_records(spark, sf).withColumn("pos", F.col("doc_id")).withColumn("batch_id", F.floor(F.col("doc_id") / 50).cast("long"))
    feeds = S.render_atom_feeds(b).select("batch_id", F.col("xml").alias("text"))
    bodies = b.groupBy("batch_id").agg(F.to_json(F.collect_list(F.struct("paper_id", "title"))).alias("text"))
    out = None
    for form, docs in (("atom", feeds), ("json", bodies)):
        k = F.col("batch_id") % 4
        cut = F.when(k == 1, F.substring("text", F.lit(1), F.length("text") - 9)).when(k == 3, " ").otherwise(F.col("text"))
        bad = S.malformed(docs.select("batch_id", cut.alias("text")), "text", "batch_id", form).distinct().select(F.lit(form).alias("form"), "batch_id", "error")
        out = bad if out is None else out.unionByName(bad)
    return out
