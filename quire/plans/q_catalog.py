"""Registered queries: catalog maintenance and read views."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import decode_array, encode_array
from ..operators import catalog as C
from ..operators import views as V
from ..sources import fixtures as X
from .oracle import PAPER_ID_SQL
from .registry import register

RUN_DATE = "2024-02-01"
VIEW_DATE = "2024-01-05"
TIER_RANK_SQL = "case relevance_tier when 'high' then 0 when 'moderate' then 1 else 2 end"


def _catalog(spark, sf):
    return X.catalog(spark, sf)


def _judged_catalog(spark, sf):
    return _catalog(spark, sf).filter(F.col("relevance_tier").isNotNull())


def _interactions(spark, sf):
    return X.interactions(spark, sf).withColumn("paper_id", X.paper_id_of(F.col("doc_id")))


# -- upsert -----------------------------------------------------------------
@register("upsert_catalog", views=("papers", "incoming"), sql=f"""
select coalesce(c.paper_id, i.paper_id) as paper_id,
  case when i.paper_id is not null then i.title else c.title end as title,
  case when i.paper_id is not null then i.comment else c.comment end as comment,
  case when i.paper_id is not null then i.relevance_tier else c.relevance_tier end as relevance_tier,
  case when i.paper_id is not null then false else c.abstract is not null end as has_abstract,
  case when c.paper_id is null then date '{RUN_DATE}' else c.date_added end as date_added
from (select paper_id, title, comment, relevance_tier, abstract, cast(date_added as date) as date_added from papers) c
full outer join (select * from incoming qualify row_number() over (partition by paper_id order by pos desc) = 1) i
  on c.paper_id = i.paper_id""")
def q_upsert_catalog(spark, sf):
    cat = C.catalog_from_papers(X.papers(spark, sf))
    inc = X.incoming(spark, sf).drop("doc_id")
    out = C.upsert_catalog(cat, inc, RUN_DATE)
    return out.select("paper_id", "title", "comment", "relevance_tier",
                      F.col("abstract").isNotNull().alias("has_abstract"), "date_added")


@register("upsert_touched_dates", views=("papers", "incoming"), sql=f"""
select distinct cast(date_added as date) as date_added from papers
where paper_id in (select paper_id from incoming)
union select date '{RUN_DATE}'""")
def q_touched_dates(spark, sf):
    cat = C.catalog_from_papers(X.papers(spark, sf))
    return C.touched_dates(cat, X.incoming(spark, sf), RUN_DATE)


@register("last_in_batch", views=("incoming",), sql="""
select paper_id, title, relevance_tier, pos from incoming
qualify row_number() over (partition by paper_id order by pos desc) = 1""")
def q_last_in_batch(spark, sf):
    return C.last_in_batch(X.incoming(spark, sf).select("paper_id", "title", "relevance_tier", "pos"))


RAW_SQL = """
select case when doc_id % 13 = 0 then null else paper_id end as paper_id,
  case when doc_id % 11 = 0 then null else title end as title, doc_id from papers"""


def _raw_papers(spark, sf):
    p = X.papers(spark, sf)
    return p.select(F.when(F.col("doc_id") % 13 == 0, None).otherwise(F.col("paper_id")).alias("paper_id"),
                    F.when(F.col("doc_id") % 11 == 0, None).otherwise(F.col("title")).alias("title"),
                    "doc_id")


@register("validate_papers", views=("papers",), raw=RAW_SQL, sql="""
select doc_id, case when paper_id is null or paper_id = '' then 'missing_id'
  when title is null then 'missing_title' end as reject_reason from raw""")
def q_validate(spark, sf):
    return C.with_reject_reason(_raw_papers(spark, sf)).select("doc_id", "reject_reason")


@register("validate_papers_rejected", views=("papers",), raw=RAW_SQL, sql="""
select doc_id from raw where paper_id is null or title is null""")
def q_validate_rejected(spark, sf):
    _, rejected = C.validate_papers(_raw_papers(spark, sf))
    return rejected.select("doc_id")


# -- interactions -------------------------------------------------------------
@register("toggle_parity", views=("folded",), sql=f"""
select {PAPER_ID_SQL.format(d="doc_id")} as paper_id, n_favourite, n_dismiss,
  n_favourite % 2 = 1 as is_favourite, n_dismiss % 2 = 1 as is_dismissed from folded""")
def q_toggle_parity(spark, sf):
    f = C.fold_interactions(_interactions(spark, sf))
    return f.select("paper_id", "n_favourite", "n_dismiss",
                    (F.col("n_favourite") % 2 == 1).alias("is_favourite"),
                    (F.col("n_dismiss") % 2 == 1).alias("is_dismissed"))


@register("latest_note", views=("folded",), sql="""
select doc_id, last_note as note from folded where last_note is not null""")
def q_latest_note(spark, sf):
    f = C.fold_interactions(X.interactions(spark, sf), key="doc_id")
    return f.filter(F.col("last_note").isNotNull()).select("doc_id", F.col("last_note").alias("note"))


@register("apply_interactions", views=("catalog",), sql="""
select paper_id, is_favourite, is_dismissed, favourite_note from catalog""")
def q_apply_interactions(spark, sf):
    return _catalog(spark, sf).select("paper_id", "is_favourite", "is_dismissed", "favourite_note")


@register("rejected_interactions", views=("papers", "interactions"), sql="""
select i.seq, i.action, 'unknown_paper' as reason from interactions i
where not exists (select 1 from papers p where p.doc_id = i.doc_id and p.relevance_tier is not null)""")
def q_rejected_interactions(spark, sf):
    r = C.rejected_interactions(_interactions(spark, sf), _judged_catalog(spark, sf))
    return r.select("seq", "action", "reason")


@register("add_missing_columns", views=("papers",), sql="""
select paper_id,
  case when doc_id % 17 = 0 then 'not json' else array_to_string(authors, '|') end as authors_joined,
  false as is_favourite, false as is_dismissed, true as thumbnail_null
from papers""")
def q_add_missing_columns(spark, sf):
    legacy = X.papers(spark, sf).select(
        "paper_id", "title",
        F.when(F.col("doc_id") % 17 == 0, F.lit("not json")).otherwise(encode_array("authors")).alias("authors"),
        F.col("date_added"))
    legacy = legacy.withColumn("authors", decode_array("authors"))
    out = C.add_missing_columns(legacy)
    return out.select("paper_id", F.array_join("authors", "|").alias("authors_joined"),
                      "is_favourite", "is_dismissed", F.col("thumbnail").isNull().alias("thumbnail_null"))


# -- views --------------------------------------------------------------------
@register("by_date", views=("catalog",), sql=f"""
select paper_id, title from catalog where date_added = date '{VIEW_DATE}'""")
def q_by_date(spark, sf):
    return V.by_date(_catalog(spark, sf), VIEW_DATE).select("paper_id", "title")


@register("favourites", views=("catalog",), sql="""
select paper_id, date_added, favourite_note from catalog where is_favourite""")
def q_favourites(spark, sf):
    return V.favourites(_catalog(spark, sf)).select("paper_id", "date_added", "favourite_note")


@register("missing_thumbnails", views=("catalog",), sql="""
select paper_id, comment, abstract from catalog where thumbnail is null""")
def q_missing_thumbnails(spark, sf):
    return V.missing_thumbnails(_catalog(spark, sf))


@register("by_id", views=("catalog", "incoming"), sql="""
select distinct i.paper_id, c.paper_id is not null as found
from incoming i left join catalog c on c.paper_id = i.paper_id""")
def q_by_id(spark, sf):
    found, unknown = V.by_id(_catalog(spark, sf), X.incoming(spark, sf))
    return (found.select("paper_id", F.lit(True).alias("found"))
            .unionByName(unknown.select("paper_id", F.lit(False).alias("found"))))


@register("daily_view", views=("catalog",), sql=f"""
select date_added, paper_id, cast(row_number() over (partition by date_added
  order by {TIER_RANK_SQL}, title, paper_id) as bigint) as pos from catalog""")
def q_daily_view(spark, sf):
    return V.daily_view(_catalog(spark, sf), columns=["paper_id"]).select("date_added", "paper_id", "pos")


@register("favourites_view", views=("catalog",), sql="""
select paper_id, date_added,
  cast(row_number() over (order by date_added desc, title, paper_id) as bigint) as pos,
  row_number() over (partition by date_added order by title, paper_id) = 1 as is_header
from catalog where is_favourite""")
def q_favourites_view(spark, sf):
    return V.favourites_view(_catalog(spark, sf), columns=["paper_id"]).select(
        "paper_id", "date_added", "pos", "is_header")


@register("latest_view", views=("catalog",), sql=f"""
select date_added, paper_id, cast(row_number() over (order by {TIER_RANK_SQL}, title, paper_id) as bigint) as pos
from catalog where date_added = (select max(date_added) from catalog)""")
def q_latest_view(spark, sf):
    return V.latest_view(_catalog(spark, sf), columns=["paper_id"]).select("date_added", "paper_id", "pos")


@register("sectioned_view", views=("catalog",), sql=f"""
select date_added, paper_id, section, cast(row_number() over (partition by date_added, section
  order by {TIER_RANK_SQL}, title, paper_id) as bigint) as pos
from (select *, case when is_favourite then 'favourites' when relevance_tier = 'high' then 'high'
      when relevance_tier = 'moderate' then 'moderate' end as section from catalog) s
where section is not null""")
def q_sectioned_view(spark, sf):
    return V.sectioned_view(_catalog(spark, sf), columns=["paper_id"]).select(
        "date_added", "paper_id", "section", "pos")


@register("available_dates", views=("catalog",), sql="""
select date_added, count(*) as n_papers from catalog group by date_added""")
def q_available_dates(spark, sf):
    return V.available_dates(_catalog(spark, sf))


@register("section_counts", views=("catalog",), sql="""
select date_added, count(*) filter (where is_favourite) as favourites,
  count(*) filter (where not is_favourite and relevance_tier = 'high') as high,
  count(*) filter (where not is_favourite and relevance_tier = 'moderate') as moderate,
  count(*) as n_total,
  count(*) filter (where is_favourite or relevance_tier in ('high', 'moderate')) as n_shown,
  concat(cast(count(*) as varchar), case when count(*) = 1 then ' paper' else ' papers' end) as count_label
from catalog group by date_added""")
def q_section_counts(spark, sf):
    return V.section_counts(_catalog(spark, sf))


@register("favourites_total", views=("catalog",), sql="""
select count(*) as n_favourites from catalog where is_favourite""")
def q_favourites_total(spark, sf):
    return V.favourites_total(_catalog(spark, sf))


@register("date_nav", views=("catalog",),
          d="select distinct date_added from catalog",
          nav="""select date_added, lag(date_added) over (order by date_added) as prev_date,
        lead(date_added) over (order by date_added) as next_date from d""",
          req="""select cast(unnest(generate_series(min(date_added) - 2, max(date_added) + 2, interval 1 day)) as date)
        as date_added from catalog""",
          sql="select r.date_added, n.prev_date, n.next_date from req r left join nav n on n.date_added = r.date_added")
def q_date_nav(spark, sf):
    cat = _catalog(spark, sf)
    dates = V.available_dates(cat)
    req = (cat.agg(F.min("date_added").alias("lo"), F.max("date_added").alias("hi"))
              .select(F.explode(F.sequence(F.date_sub("lo", 2), F.date_add("hi", 2))).alias("date_added")))
    return V.date_nav(dates, req)


@register("date_option_label", views=("catalog",), sql="""
select date_added, concat(cast(date_added as varchar), ' (', cast(count(*) as varchar), ')') as label,
  date_added = (select max(date_added) from catalog) as selected
from catalog group by date_added""")
def q_date_option_label(spark, sf):
    cat = _catalog(spark, sf)
    dates = V.available_dates(cat)
    # dates has one row per day, so a global window over it is small
    dates = dates.withColumn("current", F.max("date_added").over(Window.partitionBy()))
    return V.date_option_label(dates, F.col("current"))


@register("card_projection", views=("catalog",), sql="""
select paper_id, case when relevance_tier = 'high' then 'HIGH' else 'MOD' end as badge,
  case when len(authors) > 3 then concat(array_to_string(authors[1:3], ', '), ' et al.')
       else array_to_string(authors, ', ') end as authors_line,
  coalesce(favourite_note, '') as note, is_dismissed and not is_favourite as collapsed,
  not is_favourite as show_dismiss, not is_dismissed or is_favourite as show_star
from catalog""")
def q_card_projection(spark, sf):
    return V.card_projection(_catalog(spark, sf))


@register("number_papers", views=("papers",), sql="""
select date_added, paper_id, cast(row_number() over (partition by date_added order by paper_id) as bigint) as pos
from papers""")
def q_number_papers(spark, sf):
    """WN-02: 1-based running number per run date."""
    from ..operators.ordering import ordered_positions
    return ordered_positions(X.papers(spark, sf).select("date_added", "paper_id"), ["date_added"], ["paper_id"])


@register("set_thumbnail", views=("papers",), sql="""
select p.paper_id, coalesce(u.thumbnail, null) as thumbnail from papers p left join (
  select paper_id, arg_max(thumbnail, seq) as thumbnail from (
    select paper_id, concat('thumbs/', paper_id, '.jpg') as thumbnail, 1 as seq from papers where doc_id % 2 = 0
    union all select paper_id, concat('thumbs/', paper_id, '.png'), 2 from papers where doc_id % 3 = 0)
  group by paper_id) u using (paper_id)""")
def q_set_thumbnail(spark, sf):
    """JN-08: unconditional keyed update, the last update (by seq) wins."""
    p = X.papers(spark, sf)
    cat = C.catalog_from_papers(p)
    upd = (p.filter(F.col("doc_id") % 2 == 0).select("paper_id", F.concat(F.lit("thumbs/"), "paper_id", F.lit(".jpg"))
                                                      .alias("thumbnail"), F.lit(1).alias("seq"))
           .unionByName(p.filter(F.col("doc_id") % 3 == 0).select(
               "paper_id", F.concat(F.lit("thumbs/"), "paper_id", F.lit(".png")).alias("thumbnail"),
               F.lit(2).alias("seq"))))
    return C.set_thumbnail(cat, upd).select("paper_id", "thumbnail")


@register("with_urls", views=("papers",), sql="""
select paper_id, concat('https://arxiv.org/pdf/', paper_id) as pdf_url, concat('https://arxiv.org/abs/', paper_id) as abs_url
from papers""")
def q_with_urls(spark, sf):
    """PR-02: scraped records get a built pdf URL and the abs URL."""
    from ..sources.feeds import with_urls
    p = X.papers(spark, sf).select("paper_id", F.lit(None).cast("string").alias("pdf_url"))
    return with_urls(p).select("paper_id", "pdf_url", "abs_url")


@register("upsert_lists", views=("papers", "incoming"), sql="""
select p.paper_id, case when i.paper_id is null then len(p.authors) else 0 end as n_authors,
  case when i.paper_id is null then len(p.categories) else 0 end as n_categories
from papers p left join (select distinct paper_id from incoming) i using (paper_id)
union all select distinct paper_id, 0, 0 from incoming where paper_id not in (select paper_id from papers)""")
def q_upsert_lists(spark, sf):
    """JN-05 with a batch that has neither authors nor categories: empty lists, never null."""
    out = C.upsert_catalog(C.catalog_from_papers(X.papers(spark, sf)), X.incoming(spark, sf).drop("doc_id"), RUN_DATE)
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("long")
    return out.select("paper_id", size("authors").alias("n_authors"), size("categories").alias("n_categories"))
