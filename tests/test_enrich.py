"""Enrichment walk on literal pages: every hop and fallback."""

import time

from pyspark.sql import functions as F

from quire.operators import enrich as EN


def test_enrichment_walk(spark):
    papers = spark.createDataFrame([
        # text has a project page with a small image then a good one, and no code link
        ("2401.00001", "Project page: https://p1.org/site", None),
        # only a GitHub repo in the text; its page names a github.io project page
        ("2401.00002", "Code: https://github.com/lab/repo2", None),
        # project page without images -> figure fallback from the rendered paper page
        ("2401.00003", "Project: https://p3.org/", None),
        # project page missing entirely -> project URL still set, figure fallback has no page either
        ("2401.00004", "Project: https://missing.org/x", None),
    ], "paper_id string, comment string, abstract string")
    pages = spark.createDataFrame([
        ("https://p1.org/site", '<img src="tiny.png"><img src="fig/teaser.jpg">'
                                '<a href="https://github.com/lab/code1">Code</a>'),
        ("https://github.com/lab/repo2", '<a href="https://lab.github.io/repo2/">site</a>'),
        ("https://lab.github.io/repo2/", '<meta property="og:image" content="https://cdn.x/og2.png">'),
        ("https://p3.org/", "<p>no images</p>"),
        ("https://arxiv.org/html/2401.00003v1", '<img src="x1.png"><img src="icon.png">'),
    ], "url string, html string")
    images = spark.createDataFrame([
        ("https://p1.org/site/tiny.png", 499), ("https://p1.org/site/fig/teaser.jpg", 500),
        ("https://cdn.x/og2.png", 900), ("https://arxiv.org/html/x1.png", 800),
    ], "url string, n_bytes long")
    for mat in (False, True):
        got = {r.paper_id: (r.project_url, r.code_url, r.thumbnail, r.image_url)
               for r in EN.enrich_links(papers, pages, images, materialize=mat).collect()}
        assert got == {
            "2401.00001": ("https://p1.org/site", "https://github.com/lab/code1", "thumbs/2401.00001.jpg",
                           "https://p1.org/site/fig/teaser.jpg"),
            "2401.00002": ("https://lab.github.io/repo2/", "https://github.com/lab/repo2",
                           "thumbs/2401.00002.png", "https://cdn.x/og2.png"),
            "2401.00003": ("https://p3.org/", None, "thumbs/2401.00003.png", "https://arxiv.org/html/x1.png"),
            "2401.00004": ("https://missing.org/x", None, None, None),
        }


def _requests(spark, rows):
    return spark.createDataFrame(rows, "url string, kind string")


def test_html_is_never_shuffled(spark):
    """No exchange holds HTML even when nothing may be broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = spark.range(2000).select(F.concat(F.lit("https://p.org/"), F.col("id").cast("string")).alias("url"),
                                         F.concat(F.lit("<img src='a.png'>"), F.col("id").cast("string")).alias("html"))
        requests = pages.select("url", F.lit("project").alias("kind")).unionByName(_requests(spark, [("https://gone.org", "project"), (None, "repo")]))
        facts = EN.page_facts(pages, requests)
        rows = facts.collect()
        plan = facts._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(rows) == 2001 and sum(r.fetched for r in rows) == 2000
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and not any("html" in line for line in exchanges)
    assert "BroadcastExchange" not in plan


def test_filter_admits_every_request_and_few_others(spark):
    urls = spark.range(5000).select(F.concat(F.lit("https://x.org/"), F.col("id").cast("string")).alias("url"), F.lit("repo").alias("kind"))
    test = EN.url_filter(urls)
    assert urls.filter(~test(F.col("url"), "repo")).count() == 0
    assert urls.filter(test(F.col("url"), "figure")).count() < 200
    full = EN.url_filter(urls, bits=1024)  # full: admits what nobody asked for, facts stay right
    assert urls.filter(~full(F.col("url"), "repo")).count() == 0
    pages = urls.select("url", F.lit('<a href="https://a.github.io/b">x</a>').alias("html"))
    got = EN.page_facts(pages, urls.limit(3).unionByName(_requests(spark, [("https://x.org/4999", "project")])), bits=1024).collect()
    assert sorted((r.repo_project, r.page_code) for r in got if r.repo_project) == [("https://a.github.io/b", None)] * 3
    assert [r.images for r in got if not r.repo_project] == [[]]


def test_plans_do_not_print_the_filter(spark):
    """The description of a plan has one size, whatever the number of requests."""
    def described(n):
        urls = spark.range(n).select(F.concat(F.lit("https://x.org/"), F.col("id").cast("string")).alias("url"), F.lit("project").alias("kind"))
        pages = urls.select("url", F.lit('<img src="a.png">').alias("html"))
        facts = EN.page_facts(pages, urls)
        assert facts.filter(F.size("images") == 1).count() == n
        return len(facts._jdf.queryExecution().toString())

    assert described(20_000) < described(20) + 2000 < 100_000


def test_latest_fetch_counts(spark):
    pages = spark.createDataFrame([("u", '<img src="old.png">', 1), ("u", '<img src="new.png">', 2)], "url string, html string, t int")
    got = EN.page_facts(pages, _requests(spark, [("u", "project")]), fetched_at="t").first()
    assert len(got.images) == 1 and "new.png" in got.images[0]
    assert EN.page_facts(pages, _requests(spark, [])).collect() == []


def test_card_links_take_linear_time(spark):
    from quire.functions.urls import card_links

    def seconds(n):
        text = "project " + " ".join(f"https://github.com/a/r{i % (n // 2)}" for i in range(n))
        df = spark.createDataFrame([(None, "https://github.com/a/r3", text, text)] * 4, "p string, c string, a string, b string")
        start = time.perf_counter()
        sizes = [r[0] for r in df.select(F.size(card_links("p", "c", "a", "b"))).collect()]
        assert sizes == [n // 2] * 4
        return time.perf_counter() - start

    seconds(500)
    small, large = min(seconds(2000) for _ in range(2)), seconds(16_000)
    assert large < 24 * small + 2


def test_plans_stay_small_in_the_driver(spark, sf):
    """A resolved URL names its parts once, pages come from two scans, and the walk's last step joins what it found once."""
    from quire.functions.urls import figure_candidates, image_candidates
    from quire.sources import fixtures as X

    pages = spark.createDataFrame([], "url string, html string")
    found = pages.select(image_candidates("html", F.col("url")), figure_candidates("html", F.col("url")))
    assert found._jdf.queryExecution().analyzed().toString().count("regexp_extract(") < 30
    web = X.web_pages(spark, sf)
    assert web._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    papers = spark.createDataFrame([("2401.00001", "Project page: https://p1.org/site", None)], "paper_id string, comment string, abstract string")
    images = spark.createDataFrame([], "url string, n_bytes long")
    walk = EN.enrich_links(papers, web, images)
    assert walk._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 4
    assert [r.project_url for r in walk.collect()] == ["https://p1.org/site"]


def test_one_page_in_two_roles(spark):
    """A page that one paper asks for as its project page and others as a repository or a rendered page."""
    papers = spark.createDataFrame([
        ("2401.00001", "see https://x.org/github.com/site.github.io/p", None),
        ("2401.00002", "https://github.com/lab/r", None),
        ("2401.00003", "page https://arxiv.example/html/none and https://p3.org/", None),
    ], "paper_id string, comment string, abstract string")
    pages = spark.createDataFrame([
        ("https://github.com/lab/r", '<a href="https://lab.github.io/a/">s</a><img src="own.png"><a href="https://github.com/lab/other">o</a>'),
        ("https://lab.github.io/a/", '<img src="one.png"><img src="two.png"><a href="https://github.com/lab/far">f</a>'),
        ("https://p3.org/", '<img src="small.png"><img src="../big.png">'),
        ("https://arxiv.org/html/2401.00002v1", '<img src="fig.png">'),
        ("https://arxiv.org/html/2401.00003v1", '<img src="fig.png">'),
    ], "url string, html string")
    images = spark.createDataFrame([("https://lab.github.io/a/two.png", 700), ("https://lab.github.io/a/two.png", 800), ("https://github.com/lab/own.png", 900),
                                    ("https://p3.org/small.png", 10), ("https://arxiv.org/html/fig.png", 900), (None, 900)], "url string, n_bytes long")
    for mat in (False, True):
        got = {r.paper_id: (r.project_url, r.code_url, r.image_url, r.success) for r in EN.enrich_links(papers, pages, images, materialize=mat).collect()}
        assert got["2401.00002"] == ("https://lab.github.io/a/", "https://github.com/lab/r", "https://lab.github.io/a/two.png", True)
        assert got["2401.00003"] == ("https://arxiv.example/html/none", None, "https://arxiv.org/html/fig.png", True)
        assert got["2401.00001"][2:] == (None, False) and len(got) == 3
