"""DuckDB twins of the fixture views, for the oracle SQL of each query.

Only the driver tables are registered in DuckDB, so every oracle statement is
prefixed with the CTEs of the views it reads (dependencies included).
"""

from __future__ import annotations

PAPER_ID_SQL = ("concat(lpad(cast(24 + {d} // 100000 as varchar), 2, '0'), lpad(cast(1 + {d} % 12 as varchar), 2, '0'), '.', "
                "lpad(cast({d} % 100000 as varchar), 5, '0'))")

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "papers": ((), f"""
select {PAPER_ID_SQL.format(d='d.doc_id')} as paper_id,
  d.doc_id,
  concat('T', cast(d.doc_id as varchar), ' ', regexp_extract(d.text, '^[^.,]*', 0)) as title,
  d.text as abstract,
  case when p.page_id is null then null
       when d.doc_id % 3 = 0 then concat('Project page: ', p.url, '.')
       when d.doc_id % 3 = 1 then concat('Code at https://github.com/org', cast(d.doc_id % 7 as varchar), '/repo', cast(d.doc_id as varchar), ').')
       else concat('Project: ', p.url, ', https://gitlab.com/g/r', cast(d.doc_id as varchar), '; also https://arxiv.org/abs/2401.00001') end as comment,
  list_transform(range(1, 2 + d.doc_id % 7), lambda i: concat('Last', cast((d.doc_id + i) % 97 as varchar), ', First', cast(i as varchar))) as authors,
  [d.source, d.lang] as categories,
  cast(date '2024-01-01' + cast(d.doc_id % 30 as int) as varchar) as date_added,
  case when l.quality = 1 and l.toxic = 0 then 'high' when l.quality = 1 then 'moderate' end as relevance_tier
from documents d left join pages p on p.page_id = d.doc_id left join labels l on l.doc_id = d.doc_id"""),
    "records": (("papers",), """
select paper_id, doc_id, title, authors, abstract, comment, categories,
  concat(date_added, 'T00:00:00Z') as published, cast(null as varchar) as updated,
  concat('https://arxiv.org/pdf/', paper_id) as pdf_url,
  concat('https://arxiv.org/abs/', paper_id) as abs_url, date_added, relevance_tier
from papers"""),
    "interactions": ((), """
select event_id as seq, ts, user_id as doc_id,
  case event_type when 'click' then 'favourite' when 'view' then 'dismiss' when 'purchase' then 'note' end as action,
  case when event_type = 'purchase' then concat('note-', cast(event_id as varchar)) end as note
from events where event_type in ('click', 'view', 'purchase')"""),
    "judgements": (("papers",), """
select 'm1' as model, paper_id, relevance_tier from papers where relevance_tier is not null
union all select 'm2', paper_id, case when doc_id % 4 = 0 then 'moderate' else 'high' end from papers where doc_id % 5 < 2
union all select 'm3', paper_id, 'high' from papers where length(abstract) % 3 = 0"""),
    "page_html": ((), """
select page_id, url, concat(
  case when page_id % 2 = 0 then concat('<meta property="og:image" content="https://cdn.example.org/og', cast(page_id as varchar), '.png">') else '' end, html,
  case when page_id % 3 = 0 then concat('<img class="a" src="https://img.example.org/teaser', cast(page_id as varchar), '.jpg">') else '' end,
  case when page_id % 5 = 0 then '<img src="https://img.example.org/logo.png">' else '' end,
  case when page_id % 4 = 0 then concat('<a href="https://github.com/features/x">f</a><a href="https://github.com/lab', cast(page_id % 9 as varchar), '/code', cast(page_id as varchar), '/blob/main">b</a><a href="https://github.com/lab', cast(page_id % 9 as varchar), '/code', cast(page_id as varchar), '">Code</a>') else '' end) as html
from pages"""),
    "criteria": ((), """
select * from (values ('high','t-ering','ering'),('high','t-ththe','ththe'),('moderate','t-ung','ung'),
                      ('moderate','t-tion','tion'),('exclude','t-eaux','eaux')) v(tier, topic, term)"""),
    "incoming": (("papers",), """
select paper_id, doc_id, concat('U ', title) as title, cast(null as varchar) as comment, 'high' as relevance_tier, doc_id as pos from papers where doc_id % 3 = 0
union all select paper_id, doc_id, concat('V ', title), comment, 'moderate', doc_id + 1000000 from papers where doc_id % 9 = 0
union all select concat('9', substr(paper_id, 2)), doc_id, title, comment, 'high', doc_id + 2000000 from papers where doc_id % 10 = 0"""),
    "folded": (("interactions",), """
select doc_id, count(*) filter (where action = 'favourite') as n_favourite,
  count(*) filter (where action = 'dismiss') as n_dismiss,
  arg_max(note, seq) filter (where action = 'note') as last_note
from interactions group by doc_id"""),
    "catalog": (("papers", "folded"), """
select p.paper_id, p.doc_id, p.title, p.authors, p.abstract, p.comment, p.categories,
  p.relevance_tier, cast(p.date_added as date) as date_added,
  coalesce(f.n_favourite, 0) % 2 = 1 as is_favourite,
  coalesce(f.n_dismiss, 0) % 2 = 1 as is_dismissed,
  f.last_note as favourite_note, cast(null as varchar) as thumbnail,
  cast(null as varchar) as code_url, cast(null as varchar) as project_url
from papers p left join folded f on f.doc_id = p.doc_id"""),
    "web_pages": (("papers", "page_html"), """
select url, html from page_html
union all select concat('https://github.com/org', cast(doc_id % 7 as varchar), '/repo', cast(doc_id as varchar)),
  concat('<a href="https://lab', cast(doc_id as varchar), '.github.io/proj/">site</a>') from documents where doc_id % 6 = 1
union all select concat('https://lab', cast(doc_id as varchar), '.github.io/proj/'),
  concat('<img src="https://lab', cast(doc_id as varchar), '.github.io/proj/pic.png">') from documents where doc_id % 12 = 1
union all select concat('https://arxiv.org/html/', paper_id, 'v1'),
  concat('<img src="https://arxiv.org/icon.png"><img src="https://arxiv.org/html/', paper_id, 'v1/x1.png"><img src="https://arxiv.org/html/x2', cast(doc_id as varchar), '.png">') from papers where doc_id % 5 = 2"""),
    "images": (("web_pages",), None),
}


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(views, body: str, **ctes: str) -> str:
    """``WITH <fixture views>, <extra ctes> <body>``."""
    parts = [f"{n} as ({_view_sql(n)}\n)" for n in _order(views)]
    parts += [f"{k} as ({v}\n)" for k, v in ctes.items()]
    if not parts:
        return body
    return "with " + ",\n".join(parts) + "\n" + body


def _view_sql(name: str) -> str:
    if name == "images":
        from .text_sql import figure_candidates_sql, image_candidates_sql
        return (f"select distinct img as url, cast((length(img) * 131) % 1000 as bigint) as n_bytes from ("
                f"select unnest({image_candidates_sql('html')}) as img from web_pages where not starts_with(url, 'https://arxiv.org/html/') "
                f"union all select unnest({figure_candidates_sql('html')}) from web_pages where starts_with(url, 'https://arxiv.org/html/'))")
    return VIEWS[name][1]
