"""Derived fixture views built from the driver tables.

The driver tables (documents, pages, labels, events) stand in for landed paper
data. Every view here is a pure DataFrame transformation of them, so its size
grows with the tables and Catalyst can prune/push through it. The DuckDB twin of
each view lives in :mod:`quire.plans.oracle`.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("documents", "pages", "labels", "events", "conversations", "benchmark")


# Text-heavy driver tables and their row key (the column later joins use).
# Their per-row work (regexes over whole texts and pages) must run in many
# tasks; the narrow tables are only joined or aggregated.
TABLE_KEYS = {"documents": "doc_id", "pages": "page_id"}
SPREAD = os.environ.get("QUIRE_SPREAD", "1") == "1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. When the scan yields fewer tasks than the session can
    run at once (small files, one row group), it is hash-spread by its key
    so per-row work is parallel; large inputs already have the tasks and are
    read as they are."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    want = spark.sparkContext.defaultParallelism
    if SPREAD and name in TABLE_KEYS and df.rdd.getNumPartitions() < want:
        df = df.repartition(want, TABLE_KEYS[name])
    return df


LEADS = 90 * 88  # values of doc_id / 100,000 that paper ids have room for


def _lead(doc_id: Column) -> Column:
    """doc_id / 100,000, or an error where ids would repeat."""
    k = F.floor(doc_id / 100_000)
    return F.when(k >= LEADS, F.raise_error(F.lit(f"paper ids have room for {LEADS * 100_000} documents"))).otherwise(k)


def _id(yy: Column, mm: Column, number: Column) -> Column:
    return F.concat(F.lpad(yy.cast("string"), 2, "0"), F.lpad(mm.cast("string"), 2, "0"), F.lit("."),
                    F.lpad(number.cast("string"), 5, "0"))


def paper_id_of(doc_id: Column) -> Column:
    """Synthetic paper id ``YYMM.NNNNN``: NNNNN the last five digits of doc_id, YY = 24 and one more
    for each 100,000, around within 00 to 89, MM = 1 + doc_id % 12 the first time around and one of 13 to 99
    for each further time (unique up to 792 million documents, an error beyond)."""
    k = _lead(doc_id)
    return _id((F.lit(24) + k) % 90, F.when(k < 90, F.lit(1) + doc_id % 12).otherwise(F.lit(12) + F.floor(k / 90)),
               doc_id % 100_000)


def new_paper_id_of(doc_id: Column) -> Column:
    """Id of the new papers of ``incoming``, for multiples of 10: YY from 90 to 99, which no paper has.
    Beyond 3 million MM from 13 and the last digit, 0 in doc_id, tell the rest."""
    k = _lead(doc_id)
    rest = F.floor(k / 10) - 3
    first = rest < 0
    return _id(F.lit(90) + (F.lit(24) + k) % 10, F.when(first, F.lit(1) + doc_id % 12).otherwise(F.lit(13) + rest % 87),
               doc_id % 100_000 + F.when(first, F.lit(0)).otherwise(F.floor(rest / 87)))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One paper per document (PAPER-like columns + doc_id, date_added, tier)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    # narrow lookup sides: the planner broadcasts them by their estimated size
    p = table(spark, sf_dir, "pages").select(F.col("page_id"), F.col("url"))
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = (d.join(p, d.doc_id == p.page_id, "left")
          .join(lab, "doc_id", "left"))
    doc = F.col("doc_id")
    m3 = doc % 3
    comment = (
        F.when(F.col("page_id").isNull(), F.lit(None).cast("string"))
        .when(m3 == 0, F.concat(F.lit("Project page: "), F.col("url"), F.lit(".")))
        .when(m3 == 1, F.concat(F.lit("Code at https://github.com/org"), (doc % 7).cast("string"),
                                F.lit("/repo"), doc.cast("string"), F.lit(").")))
        .otherwise(F.concat(F.lit("Project: "), F.col("url"), F.lit(", https://gitlab.com/g/r"),
                            doc.cast("string"), F.lit("; also https://arxiv.org/abs/2401.00001")))
    )
    authors = F.transform(
        F.sequence(F.lit(1).cast("long"), F.lit(1) + doc % 7),
        lambda i: F.concat(F.lit("Last"), ((doc + i) % 97).cast("string"),
                           F.lit(", First"), i.cast("string")),
    )
    tier = (F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit("high"))
             .when(F.col("quality") == 1, F.lit("moderate")))
    return j.select(
        paper_id_of(doc).alias("paper_id"),
        doc.alias("doc_id"),
        F.concat(F.lit("T"), doc.cast("string"), F.lit(" "),
                 F.regexp_extract("text", r"^[^.,]*", 0)).alias("title"),
        F.col("text").alias("abstract"),
        comment.alias("comment"),
        authors.alias("authors"),
        F.array(F.col("source"), F.col("lang")).alias("categories"),
        F.date_add(F.lit("2024-01-01").cast("date"), (doc % 30).cast("int")).cast("string").alias("date_added"),
        tier.alias("relevance_tier"),
    )


def paper_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``papers`` in the PAPER record shape (published / urls filled)."""
    p = papers(spark, sf_dir)
    return p.select(
        "paper_id", "doc_id", "title", "authors", "abstract", "comment", "categories",
        F.concat(F.col("date_added"), F.lit("T00:00:00Z")).alias("published"),
        F.lit(None).cast("string").alias("updated"),
        F.concat(F.lit("https://arxiv.org/pdf/"), F.col("paper_id")).alias("pdf_url"),
        F.concat(F.lit("https://arxiv.org/abs/"), F.col("paper_id")).alias("abs_url"),
        "date_added", "relevance_tier",
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User actions from ``events``: click=favourite, view=dismiss, purchase=note."""
    e = table(spark, sf_dir, "events")
    return (e.filter(F.col("event_type").isin("click", "view", "purchase"))
             .select(F.col("event_id").alias("seq"), F.col("ts"),
                     F.col("user_id").alias("doc_id"),
                     F.when(F.col("event_type") == "click", "favourite")
                      .when(F.col("event_type") == "view", "dismiss")
                      .when(F.col("event_type") == "purchase", "note").alias("action"),
                     F.when(F.col("event_type") == "purchase",
                            F.concat(F.lit("note-"), F.col("event_id").cast("string"))).alias("note")))


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three judges' picks (long form: model, paper_id, relevance_tier)."""
    p = papers(spark, sf_dir).select("paper_id", "doc_id", "relevance_tier", "abstract")
    m1 = p.filter(F.col("relevance_tier").isNotNull()).select(
        F.lit("m1").alias("model"), "paper_id", "relevance_tier")
    m2 = p.filter(F.col("doc_id") % 5 < 2).select(
        F.lit("m2").alias("model"), "paper_id",
        F.when(F.col("doc_id") % 4 == 0, "moderate").otherwise("high").alias("relevance_tier"))
    m3 = p.filter(F.length("abstract") % 3 == 0).select(
        F.lit("m3").alias("model"), "paper_id", F.lit("high").alias("relevance_tier"))
    return m1.unionByName(m2).unionByName(m3)


def page_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with og:image, teaser/logo images and code links added."""
    pg = table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    s = pid.cast("string")
    html = F.concat(
        F.when(pid % 2 == 0, F.concat(
            F.lit('<meta property="og:image" content="https://cdn.example.org/og'), s,
            F.lit('.png">'))).otherwise(F.lit("")),
        F.col("html"),
        F.when(pid % 3 == 0, F.concat(
            F.lit('<img class="a" src="https://img.example.org/teaser'), s,
            F.lit('.jpg">'))).otherwise(F.lit("")),
        F.when(pid % 5 == 0, F.lit('<img src="https://img.example.org/logo.png">')).otherwise(F.lit("")),
        F.when(pid % 4 == 0, F.concat(
            F.lit('<a href="https://github.com/features/x">f</a><a href="https://github.com/lab'),
            (pid % 9).cast("string"), F.lit("/code"), s,
            F.lit('/blob/main">b</a><a href="https://github.com/lab'),
            (pid % 9).cast("string"), F.lit("/code"), s, F.lit('">Code</a>'))).otherwise(F.lit("")),
    )
    return pg.select("page_id", "url", html.alias("html"))


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, html): ``page_html`` and, for some papers, the page of the repository their comment names, the
    ``github.io`` page that it names, and the rendered paper page."""
    doc = F.col("doc_id")
    d = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select(doc, paper_id_of(doc).alias("paper_id"))
    s = doc.cast("string")
    site = F.concat(F.lit("https://lab"), s, F.lit(".github.io/proj/"))
    page = lambda url, html: F.struct(url.alias("url"), html.alias("html"))
    repo = page(F.concat(F.lit("https://github.com/org"), (doc % 7).cast("string"), F.lit("/repo"), s),
                F.concat(F.lit('<a href="'), site, F.lit('">site</a>')))
    named = page(site, F.concat(F.lit('<img src="'), site, F.lit('pic.png">')))
    rendered = page(
        F.concat(F.lit("https://arxiv.org/html/"), "paper_id", F.lit("v1")),
        F.concat(F.lit('<img src="https://arxiv.org/icon.png"><img src="https://arxiv.org/html/'), "paper_id", F.lit('v1/x1.png"><img src="https://arxiv.org/html/x2'), s,
                 F.lit('.png">')))
    # one scan for the three: what is done with pages is planned once for each part of this union
    found = F.array(F.when(doc % 6 == 1, repo), F.when(doc % 12 == 1, named), F.when(doc % 5 == 2, rendered))
    more = d.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("p")).select("p.url", "p.html")
    return page_html(spark, sf_dir).select("url", "html").unionByName(more)


CRITERIA_ROWS = [
    ("high", "t-ering", "ering"),
    ("high", "t-ththe", "ththe"),
    ("moderate", "t-ung", "ung"),
    ("moderate", "t-tion", "tion"),
    ("exclude", "t-eaux", "eaux"),
]


def criteria(spark: SparkSession) -> DataFrame:
    """The test criteria table (tier, topic, term)."""
    return spark.createDataFrame(CRITERIA_ROWS, "tier string, topic string, term string")


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert batch: matched rows, in-batch duplicates, null comments, new ids."""
    p = papers(spark, sf_dir).select("paper_id", "doc_id", "title", "comment")
    a = p.filter(F.col("doc_id") % 3 == 0).select(
        "paper_id", "doc_id", F.concat(F.lit("U "), F.col("title")).alias("title"),
        F.lit(None).cast("string").alias("comment"), F.lit("high").alias("relevance_tier"),
        F.col("doc_id").alias("pos"))
    b = p.filter(F.col("doc_id") % 9 == 0).select(
        "paper_id", "doc_id", F.concat(F.lit("V "), F.col("title")).alias("title"),
        "comment", F.lit("moderate").alias("relevance_tier"),
        (F.col("doc_id") + 1000000).alias("pos"))
    c = p.filter(F.col("doc_id") % 10 == 0).select(
        new_paper_id_of(F.col("doc_id")).alias("paper_id"), "doc_id",
        "title", "comment", F.lit("high").alias("relevance_tier"),
        (F.col("doc_id") + 2000000).alias("pos"))
    return a.unionByName(b).unionByName(c)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``papers`` as a catalog with the folded ``interactions`` applied."""
    from ..operators.catalog import apply_interactions, catalog_from_papers, fold_interactions

    cat = catalog_from_papers(papers(spark, sf_dir))
    folded = fold_interactions(interactions(spark, sf_dir)
                               .withColumn("paper_id", paper_id_of(F.col("doc_id"))))
    return apply_interactions(cat, folded)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched-image metadata (url, n_bytes) for every candidate image of the
    pages; sizes follow a fixed rule so some fall under the minimum."""
    from ..functions.urls import figure_candidates, image_candidates

    pages, url = web_pages(spark, sf_dir), F.col("url")
    found = F.when(url.startswith("https://arxiv.org/html/"), figure_candidates("html", url)).otherwise(image_candidates("html", url))
    urls = pages.select(F.explode(found).alias("url")).distinct()
    return urls.select("url", ((F.length("url") * 131) % 1000).cast("long").alias("n_bytes"))
