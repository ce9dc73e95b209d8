"""Parsers on odd documents, envelopes, failing models, lists of an upsert, files with a hot date."""

import glob

from pyspark.sql import functions as F

from quire.operators import reports as R
from quire.operators import triage as TR
from quire.sinks import files as FS
from quire.sources import feeds as S


def test_page_pairs_in_one_pass(spark):
    html = ('<meta name="citation_title" content="A &amp; B"><meta  name="citation_author" content="Doe, J">'
            '<meta name="citation_author" content="Roe, R"><meta name="citation_title" content="second">'
            '<td class="tablecell comments mathjax">5 <b>pages</b> <span class="primary-subject">Vision (cs.CV)</span>; Other (cs.LG); (stat.ML)</td>'
            '<meta name="citation_abstract" content="line\none">')
    df = spark.createDataFrame([("1", html), ("2", None), ("3", ""), ("4", "<p>")], "paper_id string, html string")
    rows = S.parse_abs_pages(df).collect()
    assert [(r.paper_id, r.title, r.authors, r.abstract, r.comment, r.categories) for r in rows] == [
        ("1", "A & B", ["J Doe", "R Roe"], "line one", "5 pages Vision (cs.CV); Other (cs.LG); (stat.ML)", ["cs.CV", "cs.LG", "stat.ML"])]
    plan = S.parse_abs_pages(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("citation_(?:title") == 1


def test_malformed_documents(spark):
    docs = [("ok", "<feed><entry><id>1</id></entry></feed>", None), ("cut", "<feed><entry><id>1</id>", "malformed atom"), ("text", "service down", "malformed atom"),
            ("html", "<html><body/></html>", "malformed atom"), ("null", None, "empty"), ("blank", " \n", "empty")]
    df = spark.createDataFrame([d[:2] for d in docs], "k string, t string")
    assert {r.k: r.error for r in S.malformed(df, "t", "k", "atom").collect()} == {k: e for k, _, e in docs if e}
    rss = spark.createDataFrame([("a", "<?xml version='1.0'?><rss><channel/></rss>"), ("b", "<rss><channel>")], "k string, t string")
    assert [r.k for r in S.malformed(rss, "t", "k", "rss").collect()] == ["b"]
    js = spark.createDataFrame([("a", '[{"x": 1}, {"x": 2}]'), ("b", '[{"x": 1}'), ("c", "{}"), ("d", "")], "k string, t string")
    assert {r.k: r.error for r in S.malformed(js, "t", "k", "json").collect()} == {"b": "malformed json", "d": "empty"}


def test_read_criteria_is_one_document_a_file(spark, tmp):
    with open(f"{tmp}/criteria.md", "w") as f:
        f.write("# C\n\n## Primary Topics\n\n### one\n- a, b\n\n## Exclude\n- c\n")
    rows = S.criteria_rows(S.read_criteria(spark, f"{tmp}/criteria.md")).collect()
    assert [(r.tier, r.topic, r.term) for r in sorted(rows, key=lambda r: r.term)] == [("high", "one", "a"), ("high", "one", "b"), ("exclude", None, "c")]


def test_papers_written_and_read(spark, tmp):
    papers = spark.createDataFrame([(str(i), f"t{i}", ["a"]) for i in range(20)], "arxiv_id string, title string, authors array<string>").repartition(3)
    FS.write_papers(papers, f"{tmp}/p")
    assert sorted(r.paper_id for r in S.read_papers(spark, f"{tmp}/p", lines=True).collect()) == sorted(str(i) for i in range(20))
    with open(f"{tmp}/array.json", "w") as f:
        f.write('[\n{"arxiv_id": "1", "title": "a"},\n{"arxiv_id": "2"}\n]')
    assert sorted(r.paper_id for r in S.read_papers(spark, f"{tmp}/array.json").collect()) == ["1", "2"]


def test_a_judgement_without_required_fields_is_rejected(spark):
    full = ('{"arxiv_id":"1","title":"t","authors":[],"abstract":"a","published":"p","pdf_url":"u","abs_url":"v",'
            '"relevance_tier":"high","relevance_summary":"s"}')
    body = '{"structured_output":{"papers":[%s,%s,%s]}}' % (full, full.replace('"abstract":"a",', ""), full.replace('"high"', '"low"'))
    raw = spark.createDataFrame([(0, 0, body), (1, 0, body[:-4])], "batch_id int, exit_code int, stdout string")
    ok, bad = TR.valid_judgements(TR.envelope_papers(TR.parse_envelopes(raw, 2)))
    assert [(r.paper_id, r.pos) for r in ok.collect()] == [("1", 0)]
    assert sorted((r.pos, r.missing_fields) for r in bad.collect()) == [(1, ["abstract"]), (2, [])]


def test_models_that_fail_while_running(spark):
    rows = [("a", "1", "high", "ok"), ("a", None, None, "failed"), ("b", None, None, "failed"), ("c", None, None, "ok")]
    j = spark.createDataFrame(rows, "model string, paper_id string, relevance_tier string, status string")
    assert [tuple(r) for r in R.agreement_matrix(j, ["a", "b", "c", "d"], failed=["d"]).collect()] == [("1", "H", "ERR", "", "ERR")]


def test_a_hot_date_is_written_by_several_tasks(spark, tmp):
    blocks = spark.range(4000).select(F.lit("2024-01-01").alias("run_date"), F.col("id").alias("pos"), F.concat(F.lit("b"), F.col("id").cast("string")).alias("block"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        FS.write_markdown(blocks, f"{tmp}/md")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    names = sorted(glob.glob(f"{tmp}/md/run_date=2024-01-01/part-*.txt"))
    lines = [line.strip() for n in names for line in open(n)]
    assert len(names) > 1 and lines == [f"b{i}" for i in range(4000)]
