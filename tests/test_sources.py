"""Parsers on edge rows and render -> parse round trips."""

import datetime as dt

from pyspark.sql import functions as F

from quire.operators.ordering import ordered_positions
from quire.sources import feeds as S
from quire.sources import fixtures as X

FEED = ('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">'
        '<entry><id>http://arxiv.org/abs/2401.00001v2</id><title>  A title\n x </title><summary>s</summary>'
        '<author><name>Solo</name></author><arxiv:primary_category term="cs.CV"/>'
        '<category term="cs.LG"/><category term="cs.CV"/><link title="pdf" href="p1"/></entry>'
        '<entry><id>http://arxiv.org/abs/hep-th/9901001</id><title>old</title></entry>'
        '<entry><id>2401.00002</id><title>t</title><author><name> </name></author>'
        '<arxiv:comment>Code: x</arxiv:comment></entry>'
        '<entry><id>2401.00003</id><title>e</title><arxiv:comment></arxiv:comment></entry>'
        '<entry><id>2401.00004</id><title>f</title><arxiv:comment/></entry></feed>')


def test_atom_edge_rows(spark):
    df = spark.createDataFrame([(FEED,)], "xml string")
    rows = S.parse_entries(df).orderBy("feed_pos").collect()
    assert [r.paper_id for r in rows] == ["2401.00001", "2401.00002", "2401.00003", "2401.00004"]
    a, b, c, d = rows                                                       # old-style id dropped
    assert c.comment == "" and d.comment == ""                              # present but empty
    assert a.title == "A title x" and a.authors == ["Solo"] and a.categories == ["cs.CV", "cs.LG"]
    assert a.pdf_url == "p1" and a.comment is None and a.abs_url == "https://arxiv.org/abs/2401.00001"
    assert b.authors == [] and b.comment == "Code: x" and b.abstract == "" and b.pdf_url is None


def test_rss_and_feed_date(spark):
    rss = ("<rss><channel><pubDate>Mon, 9 Mar 2026 00:00:00 -0400</pubDate>"
           "<item><link>http://arxiv.org/abs/2603.00001</link></item><item><link>nothing</link></item>"
           "<item><link>http://arxiv.org/abs/2603.00001v3</link></item></channel></rss>")
    df = spark.createDataFrame([("f", rss)], "feed string, xml string")
    assert [(r.pos, r.paper_id) for r in S.feed_item_ids(df).collect()] == [(0, "2603.00001"), (2, "2603.00001")]
    assert S.feed_announcement_date(df).first().announced == dt.date(2026, 3, 9)


def test_listing_sections(spark):
    html = ("<p>arXiv:2512.00009 before any header</p><h3>Mon, 15 Dec 2025 (showing 2)</h3>"
            "arXiv:2512.00001 arXiv:2512.00002 arXiv:2512.00001<h3>more of the same day</h3>arXiv:2512.00003"
            "<h3>Tue, 16 Dec 2025</h3>arXiv:2512.00004")
    df = spark.createDataFrame([("p", html)], "page string, html string")
    got = [(str(r.announced), r.paper_id) for r in S.listing_ids_by_date(df).orderBy("pos").collect()]
    assert got == [("2025-12-15", "2512.00001"), ("2025-12-15", "2512.00002"), ("2025-12-15", "2512.00003"),
                   ("2025-12-16", "2512.00004")]


def test_ingest_payload(spark):
    bodies = spark.createDataFrame([(1, '[{"arxiv_id": "1", "title": "t"}]'), (2, '{"papers": []}'), (3, "[]")],
                                   "request int, body string")
    rows = sorted((r.request, r.paper_id, r.error) for r in S.parse_ingest_payload(bodies).collect())
    assert rows == [(1, "1", None), (2, None, "Expected a JSON array")]


def test_atom_round_trip_whole_fixture(spark, sf):
    recs = X.paper_records(spark, sf)
    b = ordered_positions(recs, [], ["paper_id"], "pos").withColumn("batch_id", F.floor((F.col("pos") - 1) / 50))
    back = S.parse_entries(S.render_atom_feeds(b)).select("paper_id", "title", "authors")
    exp = recs.select("paper_id", S.collapse_ws("title").alias("title"), "authors")
    assert back.exceptAll(exp).count() == 0 and exp.exceptAll(back).count() == 0


def test_criteria_document(spark):
    doc = ("# Criteria\n\n## Primary Topics (High Relevance)\n\n### 360 Imaging\n- 360 cameras, panoramic\n"
           "- fisheye\n\n## Lower Priority (Tangential)\n\n- Occupancy prediction\n\n## Exclude\n\n- Medical imaging\n")
    df = spark.createDataFrame([("d", doc)], "doc string, text string")
    rows = [(r.tier, r.topic, r.term) for r in S.criteria_rows(df).orderBy("line_no", "term").collect()]
    assert rows == [("high", "360 Imaging", "360 cameras"), ("high", "360 Imaging", "panoramic"),
                    ("high", "360 Imaging", "fisheye"), ("low", None, "Occupancy prediction"),
                    ("exclude", None, "Medical imaging")]


def test_ingest_payload_date_default(spark):
    bodies = spark.createDataFrame([(1, '[{"arxiv_id": "1"}]', "2024-03-01"), (2, '[{"arxiv_id": "2"}]', None)],
                                   "request int, body string, date string")
    rows = sorted((r.paper_id, str(r.date_added)) for r in
                  S.parse_ingest_payload(bodies, date_col="date", run_date="2024-03-05").collect())
    assert rows == [("1", "2024-03-01"), ("2", "2024-03-05")]
    bad = spark.createDataFrame([(3, '[{"arxiv_id": "3", "abstract": "a", "authors": ["x"]}]', "2026-02-30"),
                                 (4, '[{"arxiv_id": "4", "abstract": "a", "authors": ["x"]}]', "2026-02-03")],
                                "request int, body string, date string")
    got = S.parse_ingest_payload(bad, date_col="date", run_date="2024-03-05")
    assert sorted((r.request, r.paper_id, r.abstract, r.error) for r in got.collect()) == [
        (3, None, None, "Invalid date"), (4, "4", "a", None)]
