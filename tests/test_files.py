"""File-form sources and sinks, and bounded document rendering."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from quire.sinks import catalog_store as CS
from quire.sinks import files as FS
from quire.sources import feeds as S
from quire.sources import fixtures as X


def test_chunked_feeds_keep_positions(spark, sf, monkeypatch):
    full_ids = sorted(map(tuple, E.queries()["feed_item_ids"](spark, sf).collect()))
    full_listing = sorted(map(tuple, E.queries()["listing_ids_by_date"](spark, sf).collect()))
    monkeypatch.setattr(S, "RSS_MAX_ITEMS", 2)
    monkeypatch.setattr(S, "LISTING_MAX_ENTRIES", 3)
    assert sorted(map(tuple, E.queries()["feed_item_ids"](spark, sf).collect())) == full_ids
    assert sorted(map(tuple, E.queries()["listing_ids_by_date"](spark, sf).collect())) == full_listing


def test_read_papers_json_arrays(spark, tmp):
    with open(f"{tmp}/a.json", "w") as f:
        json.dump([{"arxiv_id": "2401.00001", "title": "t", "authors": ["A"], "categories": ["cs.CV"]},
                   {"arxiv_id": "2401.00002", "title": "u", "authors": [], "comment": None}], f)
    with open(f"{tmp}/empty.json", "w") as f:
        json.dump([], f)
    df = S.read_papers(spark, tmp)
    assert sorted(r.paper_id for r in df.collect()) == ["2401.00001", "2401.00002"]


def test_read_atom_files(spark, tmp):
    feed = ('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">'
            '<entry><id>http://arxiv.org/abs/2401.00001v1</id><title>A</title><summary>s</summary>'
            '<author><name>X</name></author><arxiv:primary_category term="cs.CV"/></entry>'
            '<entry><id>http://arxiv.org/abs/2401.00002v1</id><title>B</title></entry></feed>')
    with open(f"{tmp}/f.xml", "w") as f:
        f.write(feed)
    rows = sorted((r.paper_id, r.title, tuple(r.authors)) for r in S.read_atom_files(spark, f"{tmp}/f.xml").collect())
    assert rows == [("2401.00001", "A", ("X",)), ("2401.00002", "B", ())]


def test_judgement_and_paper_writers(spark, sf, tmp):
    recs = X.paper_records(spark, sf).select("paper_id", "title", "relevance_tier")
    FS.write_raw_judgements(recs, f"{tmp}/raw", "2024-01-01", "m1")
    FS.write_raw_judgements(recs.limit(5), f"{tmp}/raw", "2024-01-01", "m2")
    got = spark.read.json(f"{tmp}/raw").groupBy("model").count().orderBy("model").collect()
    assert [(r.model, r["count"]) for r in got] == [("m1", recs.count()), ("m2", 5)]
    FS.write_filtered(recs.filter(F.col("relevance_tier").isNotNull()), f"{tmp}/filtered", "2024-01-01")
    assert spark.read.parquet(f"{tmp}/filtered").filter("relevance_tier is null").count() == 0
    FS.write_papers(recs.limit(0), f"{tmp}/papers")       # an empty day still leaves a readable output
    assert spark.read.schema("paper_id string").json(f"{tmp}/papers").count() == 0


def test_candidate_files_both_shapes(spark, tmp):
    with open(f"{tmp}/a.json", "w") as f:
        json.dump({"candidate_ids": ["2401.00001", "2401.00002"]}, f)
    with open(f"{tmp}/b.json", "w") as f:
        json.dump(["2401.00003"], f)
    got = sorted(r.paper_id for r in S.read_candidate_ids(spark, tmp).collect())
    assert got == ["2401.00001", "2401.00002", "2401.00003"]


def test_rss_dedupe_option(spark):
    rss = ("<rss><channel><item><link>http://arxiv.org/abs/2603.00001</link></item>"
           "<item><link>http://arxiv.org/abs/2603.00002</link></item>"
           "<item><link>http://arxiv.org/abs/2603.00001v2</link></item></channel></rss>")
    df = spark.createDataFrame([("f", rss)], "feed string, xml string")
    assert S.feed_item_ids(df).count() == 3
    assert sorted((r.pos, r.paper_id) for r in S.feed_item_ids(df, dedupe=True).collect()) == [
        (0, "2603.00001"), (1, "2603.00002")]


def test_snapshot_store_skips_missing_catalog(spark, tmp):
    assert CS.snapshot(spark, f"{tmp}/nothing", "2024-01-01") is None
    assert CS.read_catalog(spark, f"{tmp}/nothing").count() == 0 and CS.head(spark, f"{tmp}/nothing") == 0


def test_fallback_when_primary_is_down(spark):
    from quire.operators import fetch as FE
    ids = spark.createDataFrame([("1",), ("2",)], "paper_id string")
    primary = spark.createDataFrame([], "paper_id string, title string")
    secondary = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "paper_id string, title string")
    got = sorted((r.paper_id, r.source) for r in FE.papers_with_fallback(ids, primary, secondary).collect())
    assert got == [("1", "scrape"), ("2", "scrape")]
    rep = FE.fetch_report(ids, FE.papers_with_fallback(ids, primary, secondary)).first()
    assert (rep.n_ids, rep.n_primary, rep.n_fallback, rep.n_missing) == (2, 0, 2, 0)


def test_read_atom_files_empty_comment(spark, tmp):
    feed = ('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">'
            '<entry><id>2401.00001</id><title>A</title><arxiv:comment/></entry>'
            '<entry><id>2401.00002</id><title>B</title></entry></feed>')
    with open(f"{tmp}/f.xml", "w") as f:
        f.write(feed)
    got = sorted((r.paper_id, r.comment) for r in S.read_atom_files(spark, f"{tmp}/f.xml").collect())
    assert got == [("2401.00001", ""), ("2401.00002", None)]


def test_paper_ids_never_repeat(spark, monkeypatch):
    from pyspark.errors import PySparkException
    doc = F.col("doc_id")
    docs = spark.range(0, 7920).select(F.explode(F.array(*[F.col("id") * 100_000 + i for i in (0, 10, 99_990)])).alias("doc_id"))
    ids = docs.select(X.paper_id_of(doc).alias("paper_id"), "doc_id", F.lit("t").alias("title"), F.lit("c").alias("comment"))
    monkeypatch.setattr(X, "papers", lambda spark, sf_dir: ids)
    new = X.incoming(spark, "").filter("pos = doc_id + 2000000").select("paper_id")
    both = ids.select("paper_id").union(new)
    assert both.count() == both.distinct().count() == 2 * 3 * 7920
    assert both.filter(~F.col("paper_id").rlike(r"^\d{4}\.\d{5}$")).count() == 0
    some = spark.createDataFrame([(7_600_000,), (7_900_000,), (None,)], "doc_id long").select(X.paper_id_of(doc).alias("p")).collect()
    assert len({r.p for r in some}) == 3 and some[2].p is None
    for of in (X.paper_id_of, X.new_paper_id_of):
        with pytest.raises(PySparkException, match="792000000"):
            spark.createDataFrame([(792_000_000,)], "doc_id long").select(of(doc)).collect()


def test_listing_of_a_date_with_over_1000_parts(spark, monkeypatch):
    docs = spark.range(1005).select(F.format_string("2401.%05d", "id").alias("paper_id"), F.lit("2024-01-01").alias("date_added"))
    monkeypatch.setattr(X, "paper_records", lambda spark, sf_dir: docs)
    monkeypatch.setattr(S, "LISTING_MAX_ENTRIES", 1)
    got = sorted((r.paper_id, r.page, r.pos_in_date) for r in E.queries()["listing_ids_by_date"](spark, "").collect())
    assert got == [(f"2401.{i:05d}", 0, i + 1) for i in range(1005)]
