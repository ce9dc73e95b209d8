"""Registered queries: the two-stage triage and its pieces."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions.text import month_prefix
from ..operators import triage as TR
from ..session import cut_lineage
from ..sources import fixtures as X
from .registry import register

RUN_DATE = "2024-03-15"

# DuckDB: per-paper term hits over a text column of a view.
HITS_SQL = """select p.paper_id, c.tier, c.topic from {src} p join criteria c
  on contains(lower(coalesce(p.{col}, '')), lower(c.term))"""
STRICT_SQL = """select paper_id,
  case when bool_or(tier = 'exclude') then null when bool_or(tier = 'high') then 'high'
       when bool_or(tier = 'moderate') then 'moderate' end as relevance_tier,
  nullif(string_agg(distinct case when tier <> 'exclude' then topic end, ', ' order by case when tier <> 'exclude' then topic end), '') as relevance_summary
from hits group by paper_id"""
GENEROUS_SQL = """select distinct paper_id from hits where tier in ('high', 'moderate', 'low')"""


def _records(spark, sf):
    return X.paper_records(spark, sf)


@register("title_scan_columns", views=("records",), sql="select paper_id, title, published from records")
def q_title_scan(spark, sf):
    return TR.title_scan_columns(_records(spark, sf))


@register("title_lines", views=("records",), sql="""
select paper_id, concat(paper_id, '  ', title, '  (published: ', coalesce(published, '?'), ')') as line from records""")
def q_title_lines(spark, sf):
    return TR.title_lines(_records(spark, sf))


@register("month_prefix", views=("papers",), sql="""
select distinct date_added, strftime(cast(date_added as date), '%y%m') as prefix from papers""")
def q_month_prefix(spark, sf):
    return X.papers(spark, sf).select("date_added", month_prefix("date_added").alias("prefix")).distinct()


@register("exclude_revisions", views=("records",), sql="""
select paper_id from records where starts_with(paper_id, '2403')""")
def q_exclude_revisions(spark, sf):
    return TR.exclude_revisions(_records(spark, sf), RUN_DATE).select("paper_id")


@register("judge_by_terms", views=("papers", "criteria"), hits=HITS_SQL.format(src="papers", col="title"),
          sql=f"select * from ({STRICT_SQL}) where relevance_tier is not null")
def q_judge_by_terms(spark, sf):
    j = TR.judge_by_terms(X.papers(spark, sf).select("paper_id", "title"), X.criteria(spark), "title", "strict")
    return j.filter(F.col("relevance_tier").isNotNull()).select("paper_id", "relevance_tier", "relevance_summary")


TERM_COUNTS = (1, 256, 257, 5000)
WORDS_SQL = """select w, row_number() over (order by md5(w), w) as k
from (select distinct unnest(regexp_extract_all(text, '[a-z]{4,8}')) as w from documents)"""


def _word_criteria(spark, sf):
    """(k, tier, topic, term): words of the documents in an arbitrary fixed order, as many as the largest count needs."""
    words = X.table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([a-z]{4,8})"), 1)).alias("term")).distinct()
    first = words.select(F.md5("term").alias("h"), "term").orderBy("h", "term").limit(max(TERM_COUNTS))
    numbered = first.groupBy().agg(F.array_sort(F.collect_list(F.struct("h", "term"))).alias("l")).select(F.posexplode("l").alias("k", "s"))
    k = F.col("k") + 1
    tier = F.when(k % 500 == 3, "exclude").when(k % 10 < 4, "high").when(k % 10 < 8, "moderate").otherwise("low")
    return numbered.select(k.alias("k"), tier.alias("tier"), F.concat(F.lit("t"), (k % 7).cast("string")).alias("topic"), F.col("s.term").alias("term"))


@register("judge_by_terms_counts", views=("papers",), words=WORDS_SQL,
          terms="""select n as n_terms, case when k % 500 = 3 then 'exclude' when k % 10 < 4 then 'high' when k % 10 < 8 then 'moderate' else 'low' end as tier,
  concat('t', cast(k % 7 as varchar)) as topic, w as term from words, (values (1), (256), (257), (5000)) c(n) where k <= n""",
          hits="""select p.paper_id, c.n_terms, c.tier, c.topic from papers p join terms c on contains(lower(p.abstract), c.term)""",
          sql="select * from (" + STRICT_SQL.replace("select paper_id,", "select n_terms, paper_id,").replace("group by paper_id", "group by n_terms, paper_id")
              + ") where relevance_tier is not null")
def q_judge_by_terms_counts(spark, sf):
    """The term judge with 1, 256, 257 and 5,000 terms: one method whatever their number."""
    criteria = cut_lineage(_word_criteria(spark, sf))  # else the documents are read for their words by each count
    papers, out = X.papers(spark, sf).select("paper_id", "abstract"), None
    for n in TERM_COUNTS:
        j = TR.judge_by_terms(papers, criteria.filter(F.col("k") <= n), "abstract", "strict").filter(F.col("relevance_tier").isNotNull())
        j = j.select(F.lit(n).alias("n_terms"), "paper_id", "relevance_tier", "relevance_summary")
        out = j if out is None else out.unionByName(j)
    return out


@register("stage1_candidates", views=("papers", "criteria"), hits=HITS_SQL.format(src="papers", col="title"),
          sql=GENEROUS_SQL)
def q_stage1(spark, sf):
    return TR.stage1_candidates(_records(spark, sf), X.criteria(spark))


STAGE2_CTES = dict(
    hits1=HITS_SQL.format(src="papers", col="title"),
    cand="select distinct paper_id from hits1 where tier in ('high', 'moderate', 'low')",
    hits="""select p.paper_id, c.tier, c.topic from papers p join cand using (paper_id) join criteria c
  on contains(lower(coalesce(p.abstract, '')), lower(c.term))""",
    judged=STRICT_SQL,
)


@register("stage2_filter", views=("papers", "criteria"), **STAGE2_CTES, sql="""
select j.paper_id, p.title, j.relevance_tier, j.relevance_summary from judged j join papers p using (paper_id)
where j.relevance_tier is not null""")
def q_stage2(spark, sf):
    recs = _records(spark, sf)
    ids = TR.stage1_candidates(recs, X.criteria(spark))
    return TR.stage2_filter(recs, ids, X.criteria(spark)).select(
        "paper_id", "title", "relevance_tier", "relevance_summary")


@register("triage", views=("papers", "criteria"), **STAGE2_CTES, sql="""
select paper_id, relevance_tier from judged where relevance_tier is not null""")
def q_triage(spark, sf):
    return TR.triage(_records(spark, sf), X.criteria(spark)).select("paper_id", "relevance_tier")


@register("tier_report", views=("papers", "criteria"), **STAGE2_CTES, sql="""
select j.paper_id, concat('[', upper(j.relevance_tier), '] ', j.paper_id, ' — ', p.title) as line
from judged j join papers p using (paper_id) where j.relevance_tier is not null""")
def q_tier_report(spark, sf):
    recs = _records(spark, sf)
    return TR.tier_report(TR.triage(recs, X.criteria(spark)))


@register("select_candidates", views=("judgements", "papers"), sql="""
select paper_id, title from papers where paper_id in (select paper_id from judgements where model = 'm2')""")
def q_select_candidates(spark, sf):
    ids = X.judgements(spark, sf).filter(F.col("model") == "m2")
    return TR.select_candidates(X.papers(spark, sf), ids).select("paper_id", "title")


@register("unknown_candidates", views=("incoming", "papers"), sql="""
select distinct paper_id from incoming where paper_id not in (select paper_id from papers)""")
def q_unknown_candidates(spark, sf):
    return TR.unknown_candidates(X.incoming(spark, sf), X.papers(spark, sf))


@register("judged_to_papers", views=("judgements", "papers"), sql="""
select j.paper_id, p.title, j.relevance_tier from judgements j join papers p using (paper_id) where j.model = 'm3'""")
def q_judged_to_papers(spark, sf):
    j = X.judgements(spark, sf).filter(F.col("model") == "m3").withColumn("relevance_summary", F.lit(None))
    return TR.judged_to_papers(j, X.papers(spark, sf)).select("paper_id", "title", "relevance_tier")


@register("valid_judgements", views=("papers", "criteria"), hits=HITS_SQL.format(src="papers", col="title"),
          judged=STRICT_SQL, sql="""
select p.paper_id, coalesce(j.relevance_tier in ('high', 'moderate'), false) as valid
from papers p left join judged j using (paper_id)""")
def q_valid_judgements(spark, sf):
    j = TR.judge_by_terms(X.papers(spark, sf).select("paper_id", "title"), X.criteria(spark), "title", "strict")
    ok, bad = TR.valid_judgements(j)
    return (ok.select("paper_id", F.lit(True).alias("valid"))
            .unionByName(bad.select("paper_id", F.lit(False).alias("valid"))))


@register("balanced_batches", views=("papers",), sql="""
select paper_id, pos, cast(floor((pos - 1) / ceil(n / greatest(1, ceil(n / 200.0)))) as bigint) as batch_id
from (select paper_id, cast(row_number() over (order by paper_id) as bigint) as pos, count(*) over () as n from papers)""")
def q_balanced_batches(spark, sf):
    return TR.balanced_batches(X.papers(spark, sf).select("paper_id"), 200, ["paper_id"]).select(
        "paper_id", "pos", "batch_id")


@register("balanced_batches_by_date", views=("papers",), sql="""
select date_added, paper_id, pos, cast(floor((pos - 1) / ceil(n / greatest(1, ceil(n / 12.0)))) as bigint) as batch_id
from (select date_added, paper_id, cast(row_number() over (partition by date_added order by paper_id) as bigint) as pos,
      count(*) over (partition by date_added) as n from papers)""")
def q_balanced_batches_by_date(spark, sf):
    return TR.balanced_batches(X.papers(spark, sf).select("date_added", "paper_id"), 12, ["paper_id"],
                               by=["date_added"]).select("date_added", "paper_id", "pos", "batch_id")


@register("fixed_batches", views=("papers",), sql="""
select batch_id, string_agg(paper_id, ',' order by pos) as id_list, count(*) as n
from (select paper_id, pos, cast(floor((pos - 1) / 50) as bigint) as batch_id
      from (select paper_id, row_number() over (order by paper_id) as pos from papers)) group by batch_id""")
def q_fixed_batches(spark, sf):
    return TR.fixed_batches(X.papers(spark, sf).select("paper_id"), 50, ["paper_id"])


def _criteria_text(spark):
    c = X.criteria(spark)
    return c.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "tier", "topic", "term"))), "\n")
                 .alias("text"))


CRIT_TEXT_SQL = "select string_agg(concat_ws(': ', tier, topic, term), chr(10) order by concat_ws(': ', tier, topic, term)) as text from criteria"


def sql_lit(text: str) -> str:
    """A Python string as a DuckDB string expression (newlines via chr(10))."""
    parts = ["'" + p.replace("'", "''") + "'" for p in text.split("\n")]
    return " || chr(10) || ".join(parts)


@register("prompt_stage1", views=("records", "criteria"), crit=CRIT_TEXT_SQL,
          b="""select paper_id, title, published, cast(row_number() over (order by paper_id) as bigint) as pos,
  count(*) over () as n from records""",
          sql=f"""
select batch_id, concat({sql_lit(TR.STAGE1_PROMPT_HEAD)}, (select text from crit), {sql_lit(TR.STAGE1_PROMPT_PAPERS)},
  string_agg(concat(paper_id, '  ', title, '  (published: ', coalesce(published, '?'), ')'), chr(10) order by pos),
  {sql_lit(TR.STAGE1_PROMPT_TAIL.replace("{prefix}", "2403"))}) as prompt
from (select *, cast(floor((pos - 1) / ceil(n / greatest(1, ceil(n / 200.0)))) as bigint) as batch_id from b)
group by batch_id""")
def q_prompt_stage1(spark, sf):
    recs = _records(spark, sf).select("paper_id", "title", "published")
    batches = TR.balanced_batches(recs, 200, ["paper_id"])
    return TR.prompt_stage1(batches, _criteria_text(spark), RUN_DATE)


@register("prompt_stage2_sizes", views=("papers", "criteria"), **STAGE2_CTES, sql="""
select cast(floor((pos - 1) / ceil(n / greatest(1, ceil(n / 12.0)))) as bigint) as batch_id, count(*) as n_papers
from (select paper_id, row_number() over (order by paper_id) as pos, count(*) over () as n from cand) group by 1""")
def q_prompt_stage2(spark, sf):
    recs = _records(spark, sf)
    ids = TR.stage1_candidates(recs, X.criteria(spark))
    batches = TR.balanced_batches(TR.select_candidates(recs, ids), 12, ["paper_id"])
    prompts = TR.prompt_stage2(batches, _criteria_text(spark))
    # the JSON array in each prompt holds exactly the batch's papers
    n = F.size(F.from_json(F.regexp_extract("prompt", r"(?s)-\n(\[.*\])\n\nSelect", 1), "array<struct<paper_id:string>>"))
    return prompts.select("batch_id", n.cast("long").alias("n_papers"))


def term_scorer(terms: list[tuple[str, str, str]]):
    """A pandas scorer for :func:`judge` (strict term rules on the abstract)."""
    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for pid, text in zip(pdf["paper_id"], pdf["abstract"].fillna("")):
            low = text.lower()
            tiers = {t for (t, _topic, term) in terms if term.lower() in low}
            if "exclude" in tiers:
                continue
            tier = "high" if "high" in tiers else "moderate" if "moderate" in tiers else None
            if tier:
                rows.append((pid, tier, None))
        return pd.DataFrame(rows, columns=["paper_id", "relevance_tier", "relevance_summary"])
    return score


@register("scorer_judge", views=("papers", "criteria"), **STAGE2_CTES, sql="""
select paper_id, relevance_tier, 'ok' as status from judged where relevance_tier is not null""")
def q_scorer_judge(spark, sf):
    recs = _records(spark, sf)
    ids = TR.stage1_candidates(recs, X.criteria(spark))
    batches = TR.balanced_batches(TR.select_candidates(recs, ids).select("paper_id", "abstract"), 12, ["paper_id"])
    out = TR.judge(batches.drop("pos"), term_scorer(X.CRITERIA_ROWS))
    return out.select("paper_id", "relevance_tier", "status")


@register("batch_report", views=("papers", "criteria"), **STAGE2_CTES,
          b="""select paper_id, cast(floor((row_number() over (order by paper_id) - 1)
     / ceil(count(*) over () / greatest(1, ceil(count(*) over () / 12.0)))) as bigint) as batch_id from cand""",
          sql="""
select b.batch_id, 'ok' as status, count(j.paper_id) as n_papers, cast(null as varchar) as error
from b left join (select paper_id from judged where relevance_tier is not null) j using (paper_id) group by b.batch_id""")
def q_batch_report(spark, sf):
    recs = _records(spark, sf)
    ids = TR.stage1_candidates(recs, X.criteria(spark))
    batches = TR.balanced_batches(TR.select_candidates(recs, ids).select("paper_id", "abstract"), 12, ["paper_id"])
    return TR.batch_report(TR.judge(batches.drop("pos"), term_scorer(X.CRITERIA_ROWS)))


def _raw_envelopes(spark, sf):
    """One stage-1 envelope per request list of 50 ids, in five shapes."""
    fb = TR.fixed_batches(X.papers(spark, sf).select("paper_id"), 50, ["paper_id"])
    ids = F.split("id_list", ",")
    v = F.col("batch_id") % 5
    stdout = (F.when(v == 1, F.lit("  "))
               .when(v == 2, F.lit('{"structured_output": [1, 2'))
               .when(v == 3, F.lit('{"other": 1}'))
               .when(v == 4, F.to_json(F.struct(F.to_json(F.struct(ids.alias("candidate_ids"))).alias("result"))))
               .otherwise(TR.stage1_envelope_json(ids)))
    return fb.select("batch_id", F.when(v == 0, F.when(F.col("batch_id") % 10 == 0, 1).otherwise(0))
                     .otherwise(0).alias("exit_code"), stdout.alias("stdout"), "n")


@register("parse_envelopes", views=("papers",), sql="""
select batch_id,
  case when batch_id % 10 = 0 then 'nonzero_exit' when batch_id % 5 = 1 then 'empty'
       when batch_id % 5 = 2 then 'bad_json' when batch_id % 5 = 3 then 'missing_result' else 'ok' end as status,
  case when batch_id % 5 in (0, 4) and batch_id % 10 <> 0 then count(*) end as n_ids
from (select cast(floor((row_number() over (order by paper_id) - 1) / 50) as bigint) as batch_id from papers) b
group by batch_id""")
def q_parse_envelopes(spark, sf):
    env = TR.parse_envelopes(_raw_envelopes(spark, sf))
    cands = TR.envelope_candidates(env).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_ids"))
    return env.join(cands, "batch_id", "left").select("batch_id", "status", "n_ids")


@register("prompt_stage2", views=("papers", "records", "criteria"), **STAGE2_CTES, crit=CRIT_TEXT_SQL,
          b="""select r.paper_id, r.title, r.authors, r.abstract, r.comment, r.categories, r.published, r.pdf_url, r.abs_url,
  row_number() over (order by r.paper_id) as pos, count(*) over () as n
from records r join cand using (paper_id)""",
          sql=f"""
select batch_id, concat({sql_lit(TR.STAGE1_PROMPT_HEAD)}, (select text from crit), {sql_lit(TR.STAGE2_PROMPT_PAPERS)},
  to_json(list({{'paper_id': paper_id, 'title': title, 'authors': authors, 'abstract': abstract, 'comment': comment,
    'categories': categories, 'published': published, 'pdf_url': pdf_url, 'abs_url': abs_url}} order by pos)),
  {sql_lit(TR.STAGE2_PROMPT_TAIL)}) as prompt
from (select *, cast(floor((pos - 1) / ceil(n / greatest(1, ceil(n / 12.0)))) as bigint) as batch_id from b)
group by batch_id""")
def q_prompt_stage2_full(spark, sf):
    recs = _records(spark, sf)
    ids = TR.stage1_candidates(recs, X.criteria(spark))
    batches = TR.balanced_batches(TR.select_candidates(recs, ids), 12, ["paper_id"])
    return TR.prompt_stage2(batches, _criteria_text(spark))


STAGE2_ENVELOPES_SQL = """
select paper_id, doc_id % 7 <> 1 and doc_id % 11 <> 2 and (doc_id % 3 <> 0 or relevance_tier is not null) as valid,
  array_to_string(list_filter([case when doc_id % 11 = 2 then 'title' end, case when doc_id % 7 = 1 then 'abstract' end,
    case when doc_id % 3 = 0 and relevance_tier is null then 'relevance_tier' end], lambda x: x is not null), ',') as missing
from records where doc_id // 12 % 5 <> 4"""


@register("stage2_envelopes", views=("records",), sql=STAGE2_ENVELOPES_SQL)
def q_stage2_envelopes(spark, sf):
    """SRC-08 + FL-08: stage-2 envelopes of twelve papers each, every fifth cut short; papers without a required field are rejected."""
    doc = F.col("doc_id")
    tier = F.when(doc % 3 == 0, F.col("relevance_tier")).otherwise("high")
    rec = F.struct(F.col("paper_id").alias("arxiv_id"), F.when(doc % 11 != 2, F.col("title")).alias("title"), "authors",
                   F.when(doc % 7 != 1, F.col("abstract")).alias("abstract"), "published", "pdf_url", "abs_url", tier.alias("relevance_tier"),
                   F.lit("s").alias("relevance_summary"))
    per = _records(spark, sf).groupBy(F.floor(doc / 12).cast("long").alias("batch_id")).agg(F.collect_list(rec).alias("p"))
    stdout = TR.stage2_envelope_json(F.col("p"))
    raw = per.select("batch_id", F.lit(0).alias("exit_code"),
                     F.when(F.col("batch_id") % 5 == 4, F.substring(stdout, F.lit(1), F.length(stdout) - 5)).otherwise(stdout).alias("stdout"))
    ok, bad = TR.valid_judgements(TR.envelope_papers(TR.parse_envelopes(raw, stage=2)))
    both = ok.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))
    return both.select("paper_id", "valid", F.array_join("missing_fields", ",").alias("missing"))
