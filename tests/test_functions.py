"""Scalar functions against the Python semantics they reproduce."""

import re
from urllib.parse import urljoin

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import text as TX
from quire.functions import urls as U

WS = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())


def _one(spark, col, values, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(col).collect()]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab .,") + list(WS[:12]) + ["\xa0", " ", "\x1c"]),
                        max_size=20), min_size=1, max_size=5))
def test_collapse_ws_matches_python_split(spark, texts):
    got = _one(spark, TX.collapse_ws("v"), texts)
    assert got == [" ".join(t.split()) for t in texts]


def test_whitespace_class_is_python_isspace(spark):
    chars = "".join(chr(c) for c in range(0x3100) if not 0xD800 <= c <= 0xDFFF)
    got = _one(spark, F.array_join(F.regexp_extract_all("v", F.lit(TX.WS_RUN), 0), ""), [chars])[0]
    assert got == WS


def test_resolve_url_matches_urljoin(spark):
    bases = ["https://a.org/p/", "https://a.org/p/q.html", "https://a.org/p/q/", "https://a.org",
             "http://h.example.com/fr/825?page=2&ref=x", "https://m.x.net/en/25#top", "https://arxiv.org/html/2603.06374v1"]
    refs = ["img/x.png", "../x.png", "../../../y.jpg", "/root/x.png", "//cdn.b.org/x.png", "?b=2", "#f",
            "./x/./y/../z.png", ".", "..", "", "https://other.org/i.png"]
    pairs = [(b, r) for b in bases for r in refs]
    df = spark.createDataFrame(pairs, "b string, r string")
    got = [tuple(x) for x in df.select("b", "r", U.resolve_url("b", "r")).collect()]
    for b, r, u in got:
        assert u == urljoin(b, r), (b, r)


def test_extract_and_classify_urls(spark):
    text = ("Code: https://github.com/a/b). Project https://a.github.io/p/, data https://arxiv.org/abs/1. "
            "again https://github.com/a/b and https://huggingface.co/x;")
    urls = _one(spark, U.extract_urls("v"), [text])[0]
    py = [u.rstrip(".,;:)") for u in re.findall(r"https?://\S+", text)]
    assert urls == py
    df = spark.createDataFrame([(text, None)], "c string, a string")
    project, code = U.classify_urls(F.col("c"), F.col("a"))
    p, c = df.select(project, code).first()
    assert p == ["https://a.github.io/p/"]
    assert c == ["https://github.com/a/b", "https://huggingface.co/x"]


def test_code_url_from_page_rules(spark):
    html = ('<a href="https://github.com/features/x">f</a><a href="https://GitHub.com/Up/Case">u</a>'
            '<a href="https://github.com/lab/code/blob/main">b</a><a href="https://github.com/short">s</a>'
            "<a href='https://gitlab.com/g/r'>g</a><a href=\"https://github.com/lab/code\">Code</a>")
    assert _one(spark, U.code_url_from_page("v"), [html])[0] == "https://gitlab.com/g/r"


def test_image_and_figure_candidates(spark):
    html = ('<img class="x" src="icon.png"><meta content="og.png" property="og:image">'
            '<img src="fig/teaser.jpg"><img src="a.webp"><img src="fig/teaser.jpg">')
    df = spark.createDataFrame([(html, "https://p.org/proj")], "h string, u string")
    imgs = df.select(U.image_candidates("h", F.col("u"))).first()[0]
    assert imgs == ["https://p.org/proj/og.png", "https://p.org/proj/fig/teaser.jpg",
                    "https://p.org/proj/icon.png", "https://p.org/proj/a.webp"]
    figs = df.select(U.figure_candidates("h", F.lit("https://arxiv.org/html/2401.00001v1"))).first()[0]
    assert figs == ["https://arxiv.org/html/fig/teaser.jpg", "https://arxiv.org/html/a.webp"]


def test_card_links_order_and_dedupe(spark):
    df = spark.createDataFrame([("https://p.io", "https://github.com/a/b",
                                 "see https://github.com/a/b and https://gitlab.com/c/d.",
                                 "Project page https://p.io, https://q.io; https://arxiv.org/abs/1")],
                               "p string, c string, a string, m string")
    links = df.select(U.card_links(F.col("p"), F.col("c"), F.col("a"), F.col("m"))).first()[0]
    assert [(x.label, x.url) for x in links] == [
        ("project", "https://p.io"), ("code", "https://github.com/a/b"),
        ("code", "https://gitlab.com/c/d"), ("project", "https://q.io")]


def test_dates_and_ids(spark):
    assert _one(spark, TX.valid_date("v"), ["2026-1-5", "2026-02-30", "x"]) == [
        __import__("datetime").date(2026, 1, 5), None, None]
    assert _one(spark, TX.parse_day_month_year("v"), ["Tue, 10 Mar 2026 00:00:00 -0400", "Mon, 9 Mar 2026"]) == [
        __import__("datetime").date(2026, 3, 10), __import__("datetime").date(2026, 3, 9)]
    assert _one(spark, TX.extract_id("v"), ["http://arxiv.org/abs/2512.11015v2", "hep-th/9901001"]) == ["2512.11015", None]
    assert _one(spark, TX.flip_author("v"), ["Doe, Jane, Jr", "Plato"]) == ["Jane, Jr Doe", "Plato"]
    assert _one(spark, TX.month_prefix("v"), ["2026-03-10"]) == ["2603"]
    assert _one(spark, TX.thumb_path(F.lit("1"), F.col("v")), ["a.PNG?x.gif", "b.webp", "c"]) == [
        "thumbs/1.png", "thumbs/1.webp", "thumbs/1.jpg"]


def test_unescape_html(spark):
    import html
    vals = ["a &amp; b", "&eacute;t&#233; &lt;x&gt;", "plain", None]
    assert _one(spark, __import__("quire.functions.html", fromlist=["x"]).unescape_html("v"), vals) == [
        html.unescape(v) if v else v for v in vals]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["&", "amp;", "lt;", "gt;", "quot;", "#39;", "apos;", "eacute;",
                                          "#233;", "#x41;", "copy", "a", " ", ";", "<"]), max_size=12),
                min_size=1, max_size=6))
def test_unescape_matches_python(spark, parts):
    import html
    from quire.functions.html import unescape_html
    vals = ["".join(p) for p in parts]
    assert _one(spark, unescape_html("v"), vals) == [html.unescape(v) for v in vals]
