"""Registered queries: scalar text / date / array functions over whole texts,
and the Markdown digest sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions.html import unescape_html
from ..functions.urls import page_base, resolve_url
from ..sinks.files import papers_markdown
from ..sources import fixtures as X
from .registry import register
from .text_sql import collapse_sql, lit


@register("collapse_ws", sql=f"select doc_id, {collapse_sql('text')} as text from documents")
def q_collapse_ws(spark, sf):
    d = X.table(spark, sf, "documents")
    return d.select("doc_id", TX.collapse_ws("text").alias("text"))


@register("extract_id", views=("papers",), sql="""
select doc_id, nullif(regexp_extract(concat('see ', abstract, ' https://arxiv.org/abs/', paper_id, 'v2'),
  '(\\d{4}\\.\\d{4,5})', 1), '') as paper_id from papers""")
def q_extract_id(spark, sf):
    p = X.papers(spark, sf)
    src = F.concat(F.lit("see "), "abstract", F.lit(" https://arxiv.org/abs/"), "paper_id", F.lit("v2"))
    return p.select("doc_id", TX.extract_id(src).alias("paper_id"))


@register("strip_tags", sql="select page_id, regexp_replace(html, '<[^>]+>', '', 'g') as text from pages")
def q_strip_tags(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", TX.strip_tags("html").alias("text"))


@register("flip_author", views=("papers",), sql="""
select paper_id, pos, author, case when contains(author, ', ')
  then concat(split_part(author, ', ', 2), ' ', split_part(author, ', ', 1)) else author end as flipped
from (select paper_id, unnest(a) as author, cast(generate_subscripts(a, 1) - 1 as int) as pos
      from (select paper_id, list_append(authors, concat('Solo', cast(doc_id as varchar))) as a from papers))""")
def q_flip_author(spark, sf):
    p = X.papers(spark, sf)
    a = F.concat("authors", F.array(F.concat(F.lit("Solo"), F.col("doc_id").cast("string"))))
    ex = p.select("paper_id", F.posexplode(a).alias("pos", "author"))
    return ex.withColumn("flipped", TX.flip_author("author"))


@register("primary_first", views=("papers",), sql="""
select paper_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') as categories
from (select paper_id, list_filter([categories[2], categories[1], categories[2], '', categories[1]],
      lambda t: t is not null and t <> '') as l from papers)""")
def q_primary_first(spark, sf):
    p = X.papers(spark, sf)
    c = F.col("categories")
    others = F.array(c[0], c[1], F.lit(""), c[0])
    return p.select("paper_id", F.array_join(TX.primary_first(c[1], others), "|").alias("categories"))


DATE_TEXT_SQL = """concat(cast(year(ts) as varchar), '-', cast(month(ts) as varchar), '-',
  cast(day(ts) + (event_id % 3) * 14 as varchar))"""


@register("valid_date", sql=f"""
select event_id, {DATE_TEXT_SQL} as s, try_cast({DATE_TEXT_SQL} as date) as d from events""")
def q_valid_date(spark, sf):
    e = X.table(spark, sf, "events")
    s = F.concat(F.year("ts").cast("string"), F.lit("-"), F.month("ts").cast("string"), F.lit("-"),
                 (F.dayofmonth("ts") + (F.col("event_id") % 3) * 14).cast("string"))
    return e.select("event_id", s.alias("s"), TX.valid_date(s).alias("d"))


@register("cap_authors", views=("papers",), sql="""
select paper_id,
  case when len(authors) > 5 then concat(array_to_string(authors[1:5], ', '), ' et al. (', cast(len(authors) as varchar), ' authors)')
       else array_to_string(authors, ', ') end as digest_authors,
  case when len(authors) > 3 then concat(array_to_string(authors[1:3], ', '), ' et al.')
       else array_to_string(authors, ', ') end as card_authors from papers""")
def q_cap_authors(spark, sf):
    p = X.papers(spark, sf)
    return p.select("paper_id", TX.cap_authors("authors", 5, True).alias("digest_authors"),
                    TX.cap_authors("authors", 3).alias("card_authors"))


@register("unescape_html", views=("papers",), sql="select paper_id, concat('©', title) as title from papers")
def q_unescape_html(spark, sf):
    p = X.papers(spark, sf)
    return p.select("paper_id", unescape_html(F.concat(F.lit("&copy;"), TX.xml_escape("title"))).alias("title"))


RESOLVE_SQL = """
with b as (select page_id, case when ends_with(url, '/') or contains(split_part(url, '/', -1), '.') then url else concat(url, '/') end as base
           from pages),
p as (select page_id, regexp_extract(base, '^([a-z]+://[^/?#]*)', 1) as origin, regexp_extract(base, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path from b),
d as (select page_id, origin, case when path = '' then '/' else regexp_replace(path, '[^/]*$', '') end as dir from p)
select page_id, 0 as k, 'img/teaser.png' as ref, concat(origin, dir, 'img/teaser.png') as resolved from d
union all select page_id, 1, '../fig/a.jpg', concat(origin, regexp_replace(dir, '[^/]+/$', ''), 'fig/a.jpg') from d
union all select page_id, 2, '/static/b.webp', concat(origin, '/static/b.webp') from d"""


@register("resolve_url", sql=RESOLVE_SQL)
def q_resolve_url(spark, sf):
    """FN-15 over every page URL and three reference shapes (checked against
    ``urllib.parse.urljoin`` in the tests)."""
    pg = X.table(spark, sf, "pages").select("page_id", "url")
    refs = F.array(F.lit("img/teaser.png"), F.lit("../fig/a.jpg"), F.lit("/static/b.webp"))
    ex = pg.select("page_id", "url", F.posexplode(refs).alias("k", "ref"))
    return ex.select("page_id", "k", "ref", resolve_url(page_base(F.col("url")), F.col("ref")).alias("resolved"))


MD_HEADER_SQL = """select date_added as run_date, cast(0 as bigint) as pos,
  concat('# arXiv cs.CV Papers - ', date_added, chr(10), chr(10), '**Total papers: ', cast(count(*) as varchar), '**',
         chr(10), chr(10), '---', chr(10)) as block from records group by date_added"""
MD_BLOCK_SQL = f"""select date_added as run_date, pos,
  concat('## ', cast(pos as varchar), '. ', title, chr(10), chr(10),
    '**arXiv ID:** [', paper_id, '](', abs_url, ')', chr(10), chr(10),
    '**Authors:** ', case when len(authors) > 5 then concat(array_to_string(authors[1:5], ', '), ' et al. (',
        cast(len(authors) as varchar), ' authors)') else array_to_string(authors, ', ') end, chr(10), chr(10),
    '**Categories:** ', array_to_string(categories, ', '), chr(10), chr(10),
    '### Abstract', chr(10), chr(10), abstract, chr(10), chr(10),
    {lit('📄 [PDF](')}, pdf_url, ') | ', {lit('🔗 [arXiv](')}, abs_url, ')', chr(10), chr(10), '---', chr(10)) as block
from (select *, cast(row_number() over (partition by date_added order by paper_id) as bigint) as pos from records)"""


@register("papers_markdown", views=("records",), h=MD_HEADER_SQL, b=MD_BLOCK_SQL,
          sql="select * from h union all select * from b")
def q_papers_markdown(spark, sf):
    r = X.paper_records(spark, sf).withColumnRenamed("date_added", "run_date")
    return papers_markdown(r, "cs.CV", order=["paper_id"])
