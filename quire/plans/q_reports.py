"""Registered queries: model comparison, bookkeeping and quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as R
from ..operators import triage as TR
from ..sources import fixtures as X
from .registry import register
from .text_sql import is_code_sql, text_urls_sql


def _judgements(spark, sf):
    return X.judgements(spark, sf)


@register("model_summary", views=("judgements",), sql="""
select model, count(*) + count(*) filter (where model = 'm1') as n_candidates, count(*) as n_final
from judgements group by model""")
def q_model_summary(spark, sf):
    j = _judgements(spark, sf)
    cand = j.unionByName(j.filter(F.col("model") == "m1"))  # m1 repeats its candidates
    return R.model_summary(cand, j)


@register("union_of_picks", views=("judgements",), sql="select count(distinct paper_id) as n_union from judgements")
def q_union_of_picks(spark, sf):
    return R.union_of_picks(_judgements(spark, sf))


@register("distinct_union_picks", views=("judgements",), sql="select distinct paper_id from judgements")
def q_distinct_union_picks(spark, sf):
    return R.distinct_union_picks(_judgements(spark, sf))


@register("sorted_picks", views=("judgements",), sql="""
select paper_id, cast(row_number() over (order by paper_id) as bigint) as pos from (select distinct paper_id from judgements)""")
def q_sorted_picks(spark, sf):
    return R.sorted_picks(R.distinct_union_picks(_judgements(spark, sf)))


LETTER = "case when max(case when model = '{m}' then 1 end) is null then '' else upper(left(coalesce(min(case when model = '{m}' then relevance_tier end), '?'), 1)) end as {m}"


@register("agreement_matrix", views=("judgements", "papers"), sql=f"""
select j.paper_id, left(coalesce(p.title, '?'), 58) as title, {LETTER.format(m='m1')}, {LETTER.format(m='m2')},
  {LETTER.format(m='m3')}, 'ERR' as m4
from judgements j left join (select paper_id, title from papers) p using (paper_id) group by j.paper_id, p.title""")
def q_agreement_matrix(spark, sf):
    m = R.agreement_matrix(_judgements(spark, sf), ["m1", "m2", "m3", "m4"], failed=["m4"])
    return R.title_lookup(m, X.papers(spark, sf))


@register("agreement_matrix_repeats", views=("judgements", "papers"),
          rep="""select model, paper_id, relevance_tier, 1 as pos from judgements
union all select j.model, j.paper_id, case when j.relevance_tier = 'high' then 'moderate' else 'high' end, 2 from judgements j join papers using (paper_id) where doc_id % 2 = 0""",
          sql="select paper_id" + "".join(
              f", coalesce(upper(left(arg_min(relevance_tier, pos) filter (where model = '{m}'), 1)), '') as {m}" for m in ("m1", "m2", "m3"))
          + " from rep group by paper_id")
def q_agreement_matrix_repeats(spark, sf):
    """AG-07 where a model picks a paper twice: the first tier counts, not the smallest."""
    j = _judgements(spark, sf)
    other = F.when(F.col("relevance_tier") == "high", "moderate").otherwise("high")
    even = X.papers(spark, sf).filter(F.col("doc_id") % 2 == 0).select("paper_id")
    second = j.join(even, "paper_id").select("model", "paper_id", other.alias("relevance_tier"), F.lit(2).alias("pos"))
    return R.agreement_matrix(j.withColumn("pos", F.lit(1)).unionByName(second), ["m1", "m2", "m3"], pos="pos")


@register("title_lookup", views=("incoming", "papers"), sql="""
select i.paper_id, left(coalesce(p.title, '?'), 58) as title from (select distinct paper_id from incoming) i
left join papers p using (paper_id)""")
def q_title_lookup(spark, sf):
    return R.title_lookup(X.incoming(spark, sf).select("paper_id").distinct(), X.papers(spark, sf))


@register("short_model_name", views=("judgements",), sql="""
select distinct concat('judge-', model, '-v1') as model, model as short from judgements""")
def q_short_model_name(spark, sf):
    names = _judgements(spark, sf).select(F.concat(F.lit("judge-"), "model", F.lit("-v1")).alias("model")).distinct()
    return R.model_short_names(names)


CMP_CTES = dict(
    hits="""select p.paper_id, c.tier, c.topic, c.m from papers p join (
  select *, 'full' as m from criteria union all select *, 'high' from criteria where tier in ('high', 'exclude')) c
  on contains(lower(coalesce(p.abstract, '')), lower(c.term))""",
    j="""select m as model, paper_id, case when bool_or(tier = 'exclude') then null when bool_or(tier = 'high') then 'high'
  when bool_or(tier = 'moderate') then 'moderate' end as relevance_tier from hits group by m, paper_id""",
)


def _cmp_runs(spark):
    crit = X.criteria(spark)

    def run_with(c):
        def run(papers):
            j = TR.judge_by_terms(papers.select("paper_id", "abstract"), c, "abstract", "strict")
            return j.filter(F.col("relevance_tier").isNotNull())
        return run

    def broken(_papers):
        raise RuntimeError("judge unavailable")

    return {"full": run_with(crit), "high": run_with(crit.filter(F.col("tier").isin("high", "exclude"))),
            "broken": broken}


@register("compare_models", views=("papers", "criteria"), **CMP_CTES, sql="""
select paper_id, case when max(case when model = 'full' then 1 end) is null then ''
    else upper(left(min(case when model = 'full' then relevance_tier end), 1)) end as full,
  case when max(case when model = 'high' then 1 end) is null then ''
    else upper(left(min(case when model = 'high' then relevance_tier end), 1)) end as high,
  'ERR' as broken
from j where relevance_tier is not null group by paper_id""")
def q_compare_models(spark, sf):
    papers = X.papers(spark, sf)
    runs, ok, failed = _cmp_runs(spark), {}, []
    for name, run in runs.items():
        try:
            ok[name] = run(papers)
        except Exception:  # noqa: BLE001 - a failed model becomes an ERR column
            failed.append(name)
    union = R.compare_models(papers, {k: (lambda _p, d=v: d) for k, v in ok.items()})
    return R.agreement_matrix(union, list(runs), failed=failed)


def _failing_runs():
    """Three models run batch by batch in the tasks: one fails in every third batch, one always, one never."""
    def batches(papers):
        return TR.balanced_batches(papers.select("paper_id", "doc_id", "relevance_tier"), 50, ["paper_id"]).withColumnRenamed("relevance_tier", "own").drop("pos")

    def scorer(fails):
        def score(pdf):
            if fails == "always" or fails == "third" and (pdf["doc_id"] % 41 == 0).any():
                raise RuntimeError("judge unavailable")
            return pdf[pdf["own"].notna()].rename(columns={"own": "relevance_tier"})[["paper_id", "relevance_tier"]]
        return score

    return {name: (lambda papers, f=fails: TR.judge(batches(papers), scorer(f))) for name, fails in (("some", "third"), ("none", "always"), ("all", "never"))}


FAILING_CTES = dict(
    b="""select *, cast(floor((row_number() over (order by paper_id) - 1) / ceil(count(*) over () / greatest(1, ceil(count(*) over () / 50.0)))) as bigint) as batch_id
from papers""",
    f="select batch_id, bool_or(doc_id % 41 = 0) as failed from b group by batch_id",
)


@register("compare_models_failures", views=("papers",), **FAILING_CTES, sql="""
select paper_id, case when failed then '' else upper(left(relevance_tier, 1)) end as some, 'ERR' as none, upper(left(relevance_tier, 1)) as "all"
from b join f using (batch_id) where relevance_tier is not null""")
def q_compare_models_failures(spark, sf):
    """CP-06 + CP-09: batches and models that fail while the job runs. A failed batch has no picks; a model of failed batches only is ERR."""
    runs = _failing_runs()
    return R.agreement_matrix(R.compare_models(X.papers(spark, sf), runs), list(runs))


@register("batch_report_failures", views=("papers",), **FAILING_CTES, sql="""
select batch_id, case when failed then 'FAILED' else 'ok' end as status, case when failed then 0 else n end as n_papers,
  case when failed then 'RuntimeError: judge unavailable' end as error
from f join (select batch_id, count(relevance_tier) as n from b group by batch_id) using (batch_id)""")
def q_batch_report_failures(spark, sf):
    """CP-06 + AG-08 with failing batches."""
    return TR.batch_report(_failing_runs()["some"](X.papers(spark, sf)))


MANIFEST_SQL = """select cast(date_added as date) as snapshot_date, concat('snapshots/date=', date_added) as path,
  count(*) as n_rows, cast(case when (doc_min % 4) = 0 then 5 else sum(length(title)) end as bigint) as n_bytes
from (select *, min(doc_id) over (partition by date_added) as doc_min from papers) group by date_added, doc_min"""


def _manifest(spark, sf):
    p = X.papers(spark, sf)
    g = p.groupBy("date_added").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("title")).alias("_b"),
                                    F.min("doc_id").alias("_m"))
    return g.select(F.col("date_added").cast("date").alias("snapshot_date"),
                    F.concat(F.lit("snapshots/date="), "date_added").alias("path"), "n_rows",
                    F.when(F.col("_m") % 4 == 0, F.lit(5)).otherwise(F.col("_b")).cast("long").alias("n_bytes"))


@register("expired_snapshots", views=("papers",), m=MANIFEST_SQL, sql="""
select snapshot_date, path, date_diff('day', snapshot_date, date '2024-02-15') > 30 as expired from m""")
def q_expired_snapshots(spark, sf):
    return R.expired_snapshots(_manifest(spark, sf), "2024-02-15").select("snapshot_date", "path", "expired")


@register("snapshot_manifest_row", views=("papers",), sql="""
select date '2024-02-01' as snapshot_date, 'snapshots/date=2024-02-01' as path, count(*) as n_rows,
  cast(sum(strlen(coalesce(abstract, '')) + strlen(coalesce(title, ''))) as bigint) as n_bytes,
  sum(strlen(coalesce(abstract, '')) + strlen(coalesce(title, ''))) < 1000 as warn_small from papers""")
def q_snapshot_manifest_row(spark, sf):
    return R.snapshot_manifest_row(X.papers(spark, sf), "2024-02-01", "snapshots/date=2024-02-01")


@register("not_yet_ingested", views=("papers",), m=MANIFEST_SQL, sql="""
select d as date_added from (select cast(unnest(generate_series(date '2023-12-28', date '2024-02-03', interval 1 day)) as date) as d)
where d not in (select snapshot_date from m where n_bytes > 10)""")
def q_not_yet_ingested(spark, sf):
    req = spark.range(1).select(F.explode(F.sequence(F.lit("2023-12-28").cast("date"),
                                                     F.lit("2024-02-03").cast("date"))).alias("date_added"))
    man = _manifest(spark, sf).withColumnRenamed("snapshot_date", "date_added")
    return R.not_yet_ingested(req, man)


@register("stale_weekdays", views=("papers",), sql="""
select d as date_added from (select cast(unnest(generate_series(date '2023-12-25', date '2024-02-10', interval 1 day)) as date) as d)
where isodow(d) <= 5 and d not in (select cast(date_added as date) from papers)""")
def q_stale_weekdays(spark, sf):
    cat = X.papers(spark, sf).select(F.col("date_added").cast("date").alias("date_added"))
    return R.stale_weekdays(cat, "2023-12-25", "2024-02-10")


@register("run_dates", views=("papers",), sql="""
select requested_date, coalesce(requested_date, date '2024-03-01') as fetch_date,
  coalesce(requested_date, date '2024-03-02') as ingest_date
from (select distinct cast(date_added as date) as requested_date from papers union all select null)""")
def q_run_dates(spark, sf):
    req = (X.papers(spark, sf).select(F.col("date_added").cast("date").alias("requested_date")).distinct()
           .unionByName(spark.range(1).select(F.lit(None).cast("date").alias("requested_date"))))
    return R.run_dates(req, F.lit("2024-03-01").cast("date"), "2024-03-02")


_CODE_LIST = f"list_filter({text_urls_sql('comment', 'abstract')}, lambda u: {is_code_sql('u')})"


@register("quality_signals", views=("papers",), sql=f"""
select p.paper_id, len({_CODE_LIST}) > 0 as has_code,
  regexp_matches(concat_ws(' ', coalesce(comment, ''), coalesce(abstract, '')), '{R.PROMISES_CODE}') as promises_code,
  nullif(regexp_extract(concat_ws(' ', coalesce(comment, ''), coalesce(abstract, '')), '\\b({'|'.join(R.VENUES)})\\b', 1), '') as venue,
  exists (select 1 from (select distinct unnest(authors) as a from papers where doc_id % 50 = 0) k
          where list_contains(p.authors, k.a)) as known_author
from papers p""")
def q_quality_signals(spark, sf):
    """CP-12; the known authors are those of every 50th paper (a fixture rule)."""
    p = X.papers(spark, sf)
    known = p.filter(F.col("doc_id") % 50 == 0).select(F.explode("authors").alias("author"))
    return R.quality_signals(p, known)
