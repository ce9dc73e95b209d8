"""Edge rows: null groups, term counts, repeated ids, batches per date, batches without a pick, repeated pages."""

import pandas as pd
import pytest

from quire.operators import catalog as CA
from quire.operators import enrich as EN
from quire.operators import triage as TR
from quire.operators.ordering import ordered_positions
from quire.sources import feeds as S


def test_null_groups_keep_their_rows(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3), ("a", 4)], "g string, paper_id int")
    got = sorted((str(r.g), r.paper_id, r.pos) for r in ordered_positions(df, ["g"], ["paper_id"]).collect())
    assert got == [("None", 2, 1), ("None", 3, 2), ("a", 1, 1), ("a", 4, 2)]
    assert TR.balanced_batches(df, 1, ["paper_id"], ["g"]).count() == 4


def test_empty_and_null_terms_match_nothing(spark):
    papers = spark.createDataFrame([("p1", "has foo"), ("p1", "nothing"), (None, "foo null"), ("p2", None)], "paper_id string, title string")
    criteria = spark.createDataFrame([("foo", "high", "t"), ("", "high", "u"), (None, "high", "v")], "term string, tier string, topic string")
    rows = sorted(map(str, TR.judge_by_terms(papers, criteria).collect()))
    assert len(rows) == 4 and sum("high" in r for r in rows) == 2


def test_copies_of_an_id_never_multiply(spark):
    papers = spark.createDataFrame([("a", "x"), ("a", "x")], "paper_id string, title string")
    judged = spark.createDataFrame([("a", "moderate", "s"), ("a", "high", "s")], "paper_id string, relevance_tier string, relevance_summary string")
    assert [r.relevance_tier for r in TR.judged_to_papers(judged, papers).collect()] == ["high", "high"]


def test_batches_per_date_and_without_a_pick(spark):
    rows = [(d, p) for d in ("d1", "d2") for p in ("a", "b", "c")]
    df = spark.createDataFrame(rows, "run_date string, paper_id string")
    batches = TR.balanced_batches(df, 2, ["paper_id"], ["run_date"]).drop("pos")

    def none(pdf: pd.DataFrame) -> pd.DataFrame:
        assert len(pdf) <= 2
        if "c" in set(pdf.paper_id):
            raise ValueError("x" * 900)
        return pdf.assign(relevance_tier="high", relevance_summary="").iloc[:0]

    judged = TR.judge(batches, none, by=["run_date"])
    report = {(r.run_date, r.batch_id): (r.status, r.n_papers, len(r.error or "")) for r in TR.batch_report(judged, by=["run_date"]).collect()}
    assert report == {(d, b): (("ok", 0, 0) if b == 0 else ("FAILED", 0, 912)) for d in ("d1", "d2") for b in (0, 1)}


def test_no_null_ids_in_the_catalog(spark):
    cat = spark.createDataFrame([], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CA.CATALOG.fields))
    inc = spark.createDataFrame([(None, "n"), ("p", "a"), ("p", "b")], "paper_id string, title string")
    assert [(r.paper_id, r.title) for r in CA.upsert_catalog(cat, inc, "2024-01-01").collect()] == [("p", "b")]


def test_channel_date_only(spark):
    xml = "<rss><channel><item><pubDate>Tue, 02 Jan 2024</pubDate></item></channel></rss>"
    both = xml.replace("<item>", "<pubDate>Mon, 01 Jan 2024</pubDate><item>")
    df = spark.createDataFrame([("a", xml), ("b", both)], "feed string, xml string")
    assert {r.feed: str(r.announced) for r in S.feed_announcement_date(df).collect()} == {"a": "None", "b": "2024-01-01"}


def test_one_page_per_url(spark):
    pages = spark.createDataFrame([("u", "<p>1</p>"), ("u", "<p>2</p>")], "url string, html string")
    wanted = spark.createDataFrame([("u", "project"), ("w", "repo")], "url string, kind string")
    assert sorted((r.url, r.fetched) for r in EN.page_facts(pages, wanted).collect()) == [("u", True), ("w", False)]


def test_many_sections_have_positions(spark):
    html = "<h3>Mon, 15 Dec 2025</h3>" + "<h3>x</h3>arXiv:2512.00001" * 2100 + "arXiv:2512.00002"
    df = spark.createDataFrame([("p", html)], "page string, html string")
    got = [r.paper_id for r in S.listing_ids_by_date(df).orderBy("pos").collect()]
    assert got == ["2512.00001", "2512.00002"]


def test_a_cluster_must_name_the_checkpoint_folder():
    from types import SimpleNamespace

    from quire.session import ensure_checkpoint_dir
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://x:7077")
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: d)))
