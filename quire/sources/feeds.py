"""Landed-feed parsers (SRC-01..09) and the renderers used to produce test inputs.

Parsers take string columns (one document per row) so they run the same on
``spark.read.text(..., wholetext=True)`` files, on XML/HTML already in a table
and on streams. File readers for the common layouts are at the bottom.
Nothing here is inferred: every XML/JSON parse uses an explicit schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.html import unescape_html
from ..functions.text import (collapse_ws, extract_id, flip_author, parse_day_month_year,
                              pdf_link, primary_first, py_strip, strip_tags, valid_date, xml_escape)
from ..operators.ordering import carry_header_forward
from ..schemas import PAPER, SECTION_TIERS

# Explicit schema of one Atom ``<entry>`` (namespaces ignored, attributes "_x").
ATOM_ENTRY = ("struct<id:string,title:string,summary:string,published:string,updated:string,"
              "author:array<struct<name:string>>,comment:struct<_VALUE:string>,primary_category:struct<_term:string>,"
              "category:array<struct<_term:string>>,link:array<struct<_title:string,_href:string>>>")
ATOM_FEED = f"entry array<{ATOM_ENTRY}>"

RSS_DOC = "channel struct<pubDate:string,item:array<struct<link:string>>>"
XML_OPTS = {"ignoreNamespace": "true"}


# ---------------------------------------------------------------------------
# SRC-04 Atom entries
# ---------------------------------------------------------------------------
def entry_to_paper(e: Column) -> list[Column]:
    """Columns of a PAPER record from a parsed Atom entry struct.

    ``comment`` is read as an element struct: a missing element is a null
    struct (-> null), a present but empty one has a null value (-> ``''``).
    """
    pid = extract_id(e["id"])
    comment = F.when(e["comment"].isNotNull(), collapse_ws(F.coalesce(e["comment"]["_VALUE"], F.lit(""))))
    authors = F.filter(F.transform(F.coalesce(e["author"], F.array()), lambda a: F.trim(a["name"])),
                       lambda a: a.isNotNull() & (a != ""))
    cats = primary_first(e["primary_category"]["_term"],
                         F.transform(F.coalesce(e["category"], F.array()), lambda c: c["_term"]))
    return [
        pid.alias("paper_id"),
        collapse_ws(F.coalesce(e["title"], F.lit(""))).alias("title"),
        authors.alias("authors"),
        collapse_ws(F.coalesce(e["summary"], F.lit(""))).alias("abstract"),
        comment.alias("comment"),
        cats.alias("categories"),
        e["published"].alias("published"),
        e["updated"].alias("updated"),
        pdf_link(e["link"], "_title", "_href").alias("pdf_url"),
        F.concat(F.lit("https://arxiv.org/abs/"), pid).alias("abs_url"),
    ]


def parse_entries(feeds: DataFrame, xml_col: str = "xml", keep=()) -> DataFrame:
    """SRC-04: Atom feed documents -> PAPER rows (+ ``feed_pos``), in feed order.

    Entries whose id holds no paper id are dropped.
    """
    parsed = feeds.select(*keep, F.from_xml(xml_col, ATOM_FEED, XML_OPTS).alias("_f"))
    rows = parsed.select(*keep, F.posexplode("_f.entry").alias("feed_pos", "_e"))
    out = rows.select(*keep, "feed_pos", *entry_to_paper(F.col("_e")))
    return out.filter(F.col("paper_id").isNotNull())


def malformed(docs: DataFrame, text_col: str, key: str, form: str) -> DataFrame:
    """(key, error): the documents that are no well-formed ``atom``, ``rss`` or ``json`` (an array of papers or
    one paper). The parsers give no rows for them, so without this they would look empty. A null or blank document is ``empty``."""
    blank = ~F.coalesce(F.col(text_col), F.lit("")).rlike(r"\S")
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    if form == "json":
        bad = F.get_json_object(text_col, "$").isNull()
    else:
        root = r"(?s)^\s*(?:<\?xml.*?\?>\s*)?(?:<!--.*?-->\s*)*<(?:\w+:)?" + {"atom": "feed", "rss": "rss"}[form] + r"\b"
        bad = F.from_xml(text_col, "_corrupt string", {**XML_OPTS, **opts})["_corrupt"].isNotNull() | ~F.col(text_col).rlike(root)
    return docs.select(key, F.when(blank, "empty").when(bad, F.lit(f"malformed {form}")).alias("error")).filter("error is not null")


# ---------------------------------------------------------------------------
# SRC-01 / SRC-02 RSS
# ---------------------------------------------------------------------------
def feed_item_ids(feeds: DataFrame, xml_col: str = "xml", key: str = "feed",
                  dedupe: bool = False) -> DataFrame:
    """SRC-01: (feed, pos, paper_id) for every ``<item><link>`` with an id.

    Not de-duplicated by default (as the feed reader it reproduces); with
    ``dedupe`` an id is kept once per feed, at its first position.
    """
    parsed = feeds.select(key, F.from_xml(xml_col, RSS_DOC).alias("_r"))
    items = parsed.select(key, F.posexplode("_r.channel.item").alias("pos", "_i"))
    ids = (items.select(key, "pos", extract_id(F.col("_i.link")).alias("paper_id"))
                .filter(F.col("paper_id").isNotNull()))
    if dedupe:
        ids = ids.groupBy(key, "paper_id").agg(F.min("pos").alias("pos")).select(key, "pos", "paper_id")
    return ids


def feed_announcement_date(feeds: DataFrame, xml_col: str = "xml", key: str = "feed") -> DataFrame:
    """SRC-02: (feed, announced) from the channel ``pubDate`` (local date as
    written; null if unparseable - the caller falls back to the run date)."""
    channel = F.regexp_replace(F.col(xml_col), r"(?s)<item\b.*?</item>", "")
    pub = F.regexp_extract(channel, r"(?s)<channel>.*?<pubDate>([^<]*)</pubDate>", 1)
    return feeds.select(key, parse_day_month_year(pub).alias("announced"))


# ---------------------------------------------------------------------------
# SRC-03 listing pages
# ---------------------------------------------------------------------------
WEEKDAY_DATE = r"(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),\s+(\d{1,2}\s+\w+\s+\d{4})"


def listing_ids_by_date(pages: DataFrame, html_col: str = "html", key: str = "page",
                        dates: list[str] | None = None) -> DataFrame:
    """SRC-03 + WN-04 + WN-03: (page, announced, pos, paper_id) for every
    ``arXiv:<id>`` under a ``<h3>`` date header.

    A header without a weekday+date continues the previous date (carried
    forward per page); ids before the first dated header are dropped; inside
    one (page, date) an id is kept once, at its first position.
    """
    secs = pages.select(key, F.posexplode(F.split(F.col(html_col), r"(?=<h3[^>]*>)")).alias("sec", "_s"))
    header = F.regexp_extract("_s", r"^<h3[^>]*>([^<]+)</h3>", 1)
    secs = secs.select(key, "sec", "_s", parse_day_month_year(
        F.nullif(F.regexp_extract(header, WEEKDAY_DATE, 1), F.lit(""))).alias("_d"))
    secs = carry_header_forward(secs, key, "sec", "_d", "announced").filter(F.col("announced").isNotNull())
    body = F.regexp_replace("_s", r"^<h3[^>]*>[^<]+</h3>", "")
    ids = secs.select(key, "announced", "sec",
                      F.posexplode(F.regexp_extract_all(body, F.lit(r"arXiv:(\d{4}\.\d{4,5})"), 1))
                      .alias("k", "paper_id"))
    if dates:
        ids = ids.filter(F.col("announced").isin([F.lit(d).cast("date") for d in dates]))
    first = ids.groupBy(key, "announced", "paper_id").agg(F.min(F.struct("sec", "k")).alias("_p"))
    return first.select(key, "announced", "paper_id",
                        (F.col("_p.sec").cast("long") * F.lit(1 << 32) + F.col("_p.k")).alias("pos"))


# ---------------------------------------------------------------------------
# SRC-05 abstract pages
# ---------------------------------------------------------------------------
# The tags and cells of an abstract page that hold its facts.
ABS_FACTS = (r'(?s)(?=(<meta\s+name="citation_(?:title|abstract|date|pdf_url)"\s+content=".*?"'
             r'|<meta\s+name="citation_author"\s+content="(?-s:.*?)"'
             r'|class="tablecell comments[^"]*">.*?</td>|class="primary-subject">.*?</span>.*?</td>))')


def page_pairs(html: Column) -> Column:
    """``array<struct<name,content>>`` of an abstract page's meta tags and cells, in page order: one pass of
    one pattern over the page (looking ahead, so that a cell that was not closed hides nothing)."""
    def pair(tag):
        meta = F.regexp_extract(tag, r'^<meta\s+name="citation_(\w+)"', 1)
        name = F.when(meta != "", meta).when(tag.startswith('class="tablecell'), "comments").otherwise("subject")
        content = F.regexp_extract(tag, r'(?s)^[^>]*?content="(.*)"$', 1)
        return F.struct(name.alias("name"), F.when(meta != "", content).otherwise(F.regexp_extract(tag, r'(?s)^[^>]*>(.*)</td>$', 1)).alias("content"))
    return F.transform(F.regexp_extract_all(html, F.lit(ABS_FACTS), 1), pair)


def parse_abs_pages(pages: DataFrame, html_col: str = "html", id_col: str = "paper_id") -> DataFrame:
    """SRC-05: scraped abstract pages -> PAPER rows (fallback source).

    Title and abstract are required; authors are flipped to ``First Last``;
    the comment cell loses its tags; categories come from ``(...)`` in the
    primary subject and then in the rest of the cell, not de-duplicated.
    One pattern runs once over a page (:func:`page_pairs`, stage 1); entities are decoded on the
    extracted values only (stage 2); HTML never leaves stage 1.
    """
    pairs = pages.select(F.col(id_col).alias("paper_id"), page_pairs(F.col(html_col)).alias("_pairs"))
    of = lambda name: F.transform(F.filter("_pairs", lambda p: p["name"] == name), lambda p: p["content"])
    first = lambda name: F.get(of(name), 0)
    split = pairs.select("paper_id", first("title").alias("_t"), first("abstract").alias("_a"), first("date").alias("_d"), first("pdf_url").alias("_p"),
                         of("author").alias("_au"), first("comments").alias("_cm"), F.split(first("subject"), "</span>", 2).alias("_s"))
    raw = split.select(
        "paper_id", "_t", "_a", "_d", "_p", "_au", F.when(F.col("_cm").isNotNull(), collapse_ws(strip_tags("_cm"))).alias("comment"),
        F.when(F.col("_s").isNotNull(), F.concat(
            F.filter(F.array(F.regexp_extract(F.col("_s")[0], r"\(([^)]+)\)", 1)), lambda p: p != ""),
            F.regexp_extract_all(F.col("_s")[1], F.lit(r"\(([^)]+)\)"), 1))).otherwise(
            F.array().cast("array<string>")).alias("categories"))
    # all author values of a page are decoded in one call (joined by \x01)
    dec = raw.select(
        "paper_id", "comment", "categories", F.size("_au").alias("_n_au"),
        collapse_ws(unescape_html("_t")).alias("title"), collapse_ws(unescape_html("_a")).alias("abstract"),
        py_strip(unescape_html("_d")).alias("published"), py_strip(unescape_html("_p")).alias("_p"),
        unescape_html(F.array_join("_au", "\x01")).alias("_au"))
    pid = F.col("paper_id")
    out = dec.filter((F.col("title") != "") & (F.col("abstract") != "")).select(
        "paper_id", "title",
        F.when(F.col("_n_au") == 0, F.array().cast("array<string>")).otherwise(
            F.transform(F.split("_au", "\x01"), lambda a: flip_author(py_strip(a)))).alias("authors"),
        "abstract", "comment", "categories", "published",
        F.lit(None).cast("string").alias("updated"),
        F.coalesce(F.nullif("_p", F.lit("")), F.concat(F.lit("https://arxiv.org/pdf/"), pid)).alias("pdf_url"),
        F.concat(F.lit("https://arxiv.org/abs/"), pid).alias("abs_url"))
    return out


def with_urls(papers: DataFrame) -> DataFrame:
    """PR-02: ``abs_url`` from the id; ``pdf_url`` falls back to the built URL."""
    pid = F.col("paper_id")
    return (papers.withColumn("pdf_url", F.coalesce(F.nullif(F.col("pdf_url"), F.lit("")),
                                                    F.concat(F.lit("https://arxiv.org/pdf/"), pid)))
                  .withColumn("abs_url", F.concat(F.lit("https://arxiv.org/abs/"), pid)))


# ---------------------------------------------------------------------------
# SRC-06 / SRC-09 JSON
# ---------------------------------------------------------------------------
PAPER_JSON = "array<struct<arxiv_id:string,title:string,authors:array<string>,abstract:string," \
             "comment:string,categories:array<string>,published:string,updated:string,pdf_url:string," \
             "abs_url:string,relevance_tier:string,relevance_summary:string>>"


def parse_ingest_payload(bodies: DataFrame, body_col: str = "body", key: str = "request",
                         date_col: str | None = None, run_date=None) -> DataFrame:
    """SRC-09: one row per paper of a JSON-array body with all its fields; a
    body that is not a JSON array yields one row with ``error = 'Expected a JSON array'``.

    With ``run_date``, a ``date_added`` column is added: the request's own
    date (``date_col``) when it has one, else the run date. A request whose
    date is given but impossible yields one row with ``error = 'Invalid date'``.
    """
    b = F.col(body_col)
    error = F.when(F.json_array_length(b).isNull(), F.lit("Expected a JSON array"))
    dates = []
    if run_date is not None:
        given = F.nullif(F.col(date_col).cast("string"), F.lit("")) if date_col else F.lit(None).cast("string")
        own = valid_date(given)
        error = F.coalesce(error, F.when(given.isNotNull() & own.isNull(), F.lit("Invalid date")))
        dates = [F.coalesce(own, F.lit(run_date).cast("date")).alias("date_added")]
    parsed = bodies.select(key, *dates, error.alias("error"), F.from_json(b, PAPER_JSON).alias("_a"))
    # a rejected request keeps one row without a paper
    one = F.when(F.col("error").isNull(), F.col("_a")).otherwise(F.array(F.lit(None).cast(PAPER_JSON[6:-1])))
    rows = parsed.withColumn("_a", one).select(key, *[d for d in parsed.columns if d == "date_added"], "error", F.posexplode("_a").alias("pos", "p"))
    return rows.select(key, *[d for d in rows.columns if d == "date_added"],
                       F.when(F.col("error").isNull(), F.col("pos")).alias("pos"), F.col("p.arxiv_id").alias("paper_id"),
                       *[f"p.{c}" for c in ("title", "authors", "abstract", "comment", "categories", "published", "updated", "pdf_url",
                                            "abs_url", "relevance_tier", "relevance_summary")], "error")


PAPER_FILE = T.StructType([T.StructField("arxiv_id", T.StringType())] + PAPER.fields[1:])


def read_papers(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """SRC-06: JSON-array paper files (an empty array is "no papers"), or with ``lines`` the JSON
    lines that :func:`quire.sinks.files.write_papers` writes, which many tasks can read."""
    df = spark.read.schema(PAPER_FILE).option("multiLine", str(not lines).lower()).json(path)
    return df.withColumnRenamed("arxiv_id", "paper_id")


CANDIDATES_FILE = T.StructType([T.StructField("candidate_ids", T.ArrayType(T.StringType()))])


def read_candidate_ids(spark: SparkSession, path: str) -> DataFrame:
    """Candidate id files in either shape: ``{"candidate_ids": [...]}`` (what a
    stage-1 run writes) or a plain JSON array of ids -> (file, pos, paper_id)."""
    docs = read_feed_files(spark, path).withColumnRenamed("xml", "json")
    as_obj = F.from_json("json", CANDIDATES_FILE)["candidate_ids"]
    as_arr = F.from_json("json", "array<string>")
    ids = F.coalesce(as_obj, as_arr, F.array().cast("array<string>"))
    return docs.select(F.col("feed").alias("file"), F.posexplode(ids).alias("pos", "paper_id"))


def read_feed_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole documents as (path, xml) rows - the input of the string parsers."""
    return (spark.read.text(path, wholetext=True)
            .select(F.input_file_name().alias("feed"), F.col("value").alias("xml")))


def read_atom_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-04 file form: ``rowTag=entry`` splits large feeds across tasks."""
    from pyspark.sql.types import _parse_datatype_string
    entry = _parse_datatype_string(ATOM_ENTRY)
    df = (spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", "true")
          .schema(entry).load(path))
    return df.select(F.struct(*df.columns).alias("_e")).select(*entry_to_paper(F.col("_e"))) \
        .filter(F.col("paper_id").isNotNull())


# ---------------------------------------------------------------------------
# SRC-07 criteria document
# ---------------------------------------------------------------------------
def criteria_rows(docs: DataFrame, text_col: str = "text", key: str = "doc") -> DataFrame:
    """SRC-07: criteria markdown -> (doc, line_no, section, topic, tier, term).

    ``##`` starts a section (tier from its leading words), ``###`` a topic,
    ``- a, b`` lists terms. Sections without a known tier keep tier null.
    """
    lines = docs.select(key, F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "_l"))
    sec = F.when(F.col("_l").startswith("## "), F.trim(F.substring("_l", F.lit(4), F.length("_l"))))
    top = F.when(F.col("_l").startswith("### "), F.trim(F.substring("_l", F.lit(5), F.length("_l"))))
    lines = lines.withColumn("_sec", sec).withColumn("_top", F.when(sec.isNotNull(), F.lit("")).otherwise(top))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = (lines.withColumn("section", F.last("_sec", ignorenulls=True).over(w))
                  .withColumn("topic", F.nullif(F.last("_top", ignorenulls=True).over(w), F.lit(""))))
    tier = F.lit(None).cast("string")
    for name, t in reversed(list(SECTION_TIERS.items())):
        tier = F.when(F.col("section").startswith(name), F.lit(t)).otherwise(tier)
    items = lines.filter(F.col("_l").startswith("- ")).select(
        key, "line_no", "section", "topic", tier.alias("tier"),
        F.explode(F.split(F.substring("_l", F.lit(3), F.length("_l")), ",")).alias("term"))
    return items.withColumn("term", F.trim("term")).filter(F.col("term") != "")


def read_criteria(spark: SparkSession, path: str) -> DataFrame:
    """SRC-07: the criteria document as one (doc, text) row, verbatim."""
    return (spark.read.text(path, wholetext=True)
            .select(F.input_file_name().alias("doc"), F.col("value").alias("text")))


# ---------------------------------------------------------------------------
# Renderers (test inputs; the inverse of the parsers above)
# ---------------------------------------------------------------------------
def render_entry(p) -> Column:
    """One Atom ``<entry>`` for a PAPER-shaped row."""
    authors = F.array_join(F.transform(p["authors"], lambda a: F.concat(
        F.lit("<author><name>"), xml_escape(a), F.lit("</name></author>"))), "")
    cats = F.array_join(F.transform(p["categories"], lambda c: F.concat(
        F.lit('<category term="'), xml_escape(c), F.lit('"/>'))), "")
    return F.concat(
        F.lit("<entry><id>http://arxiv.org/abs/"), p["paper_id"], F.lit("v1</id>"),
        F.lit("<published>"), p["published"], F.lit("</published>"),
        F.lit("<title>"), xml_escape(p["title"]), F.lit("</title>"),
        F.lit("<summary>"), xml_escape(p["abstract"]), F.lit("</summary>"), authors,
        F.coalesce(F.concat(F.lit("<arxiv:comment>"), xml_escape(p["comment"]), F.lit("</arxiv:comment>")),
                   F.lit("")),
        F.lit('<link href="https://arxiv.org/abs/'), p["paper_id"], F.lit('v1" rel="alternate"/>'),
        F.lit('<link title="pdf" href="'), p["pdf_url"], F.lit('" rel="related"/>'),
        F.lit('<arxiv:primary_category term="'), xml_escape(F.element_at(p["categories"], 1)), F.lit('"/>'),
        cats, F.lit("</entry>"))


def render_atom_feeds(batched: DataFrame) -> DataFrame:
    """(batch_id, xml): one Atom feed per request batch (entries in ``pos`` order)."""
    rec = F.struct(*[F.col(c) for c in ("paper_id", "title", "abstract", "authors", "comment",
                                         "categories", "published", "pdf_url")])
    per = batched.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("pos", rec.alias("r")))).alias("_l"))
    return per.select("batch_id", F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">'),
        F.array_join(F.transform("_l", lambda x: render_entry(x["r"])), ""), F.lit("</feed>")).alias("xml"))


def pub_date_text(d) -> Column:
    return F.concat(F.date_format(d, "EEE, d MMM yyyy"), F.lit(" 00:00:00 -0400"))


RSS_MAX_ITEMS = 1000
LISTING_MAX_ENTRIES = 2000


def render_rss(batched: DataFrame, key: str = "feed") -> DataFrame:
    """(feed, part, xml): RSS documents of at most ``RSS_MAX_ITEMS`` items per
    feed (``pos`` 1-based), so no document grows with the size of a day."""
    b = batched.withColumn("part", F.floor((F.col("pos") - 1) / RSS_MAX_ITEMS).cast("long"))
    per = b.groupBy(key, "part").agg(F.array_sort(F.collect_list(F.struct("pos", "paper_id"))).alias("_l"),
                                     F.min("announced").alias("_d"))
    items = F.array_join(F.transform("_l", lambda x: F.concat(
        F.lit("<item><link>https://arxiv.org/abs/"), x["paper_id"], F.lit("</link></item>"))), "")
    return per.select(key, "part", F.concat(F.lit("<rss><channel><pubDate>"), pub_date_text(F.col("_d")),
                                            F.lit("</pubDate>"), items, F.lit("</channel></rss>")).alias("xml"))


def render_abs_page(p) -> Column:
    """An abstract page with the citation meta tags, comment cell and subjects."""
    authors = F.array_join(F.transform(p["authors"], lambda a: F.concat(
        F.lit('<meta name="citation_author" content="'), xml_escape(a), F.lit('" />\n'))), "")
    cats = p["categories"]
    rest = F.array_join(F.transform(F.slice(cats, F.lit(2), F.size(cats)), lambda c: F.concat(F.lit("Other ("), c, F.lit(")"))), "; ")
    return F.concat(
        F.lit('<html><head><meta name="citation_title" content="'), xml_escape(p["title"]), F.lit('" />\n'),
        authors, F.lit('<meta name="citation_date" content="'), p["published"], F.lit('" />\n'),
        F.lit('<meta name="citation_pdf_url" content="'), p["pdf_url"], F.lit('" />\n'),
        F.lit('<meta name="citation_abstract" content="'), xml_escape(p["abstract"]), F.lit('" />\n'),
        F.lit("</head><body><table>"),
        F.coalesce(F.concat(F.lit('<tr><td class="tablecell comments mathjax">'), xml_escape(p["comment"]),
                            F.lit("</td></tr>")), F.lit("")),
        F.lit('<tr><td class="tablecell subjects"><span class="primary-subject">Main ('),
        F.element_at(cats, 1), F.lit(")</span>; "), rest, F.lit("</td></tr></table></body></html>"))


def render_listing(batched: DataFrame, key: str = "page") -> DataFrame:
    """(page, html): listing pages with one ``<h3>`` date header per date.

    A date section holds at most ``LISTING_MAX_ENTRIES`` entries; a bigger
    day continues on the next page (``page`` becomes a struct of ``page`` and ``part``),
    so a page never grows with the size of a day.
    """
    b = batched.withColumn("_part", F.floor((F.col("pos") - 1) / LISTING_MAX_ENTRIES).cast("long"))
    b = b.withColumn(key, F.struct(F.col(key), F.col("_part").alias("part")))
    per_date = b.groupBy(key, "announced").agg(
        F.array_sort(F.collect_list(F.struct("pos", "paper_id"))).alias("_l"))
    sec = F.concat(F.lit("<h3>"), F.date_format("announced", "EEE, d MMM yyyy"), F.lit(" (showing "),
                   F.size("_l").cast("string"), F.lit(" entries)</h3><dl>"),
                   F.array_join(F.transform("_l", lambda x: F.concat(
                       F.lit('<dt><a href="/abs/'), x["paper_id"], F.lit('">arXiv:'), x["paper_id"],
                       F.lit("</a></dt>"))), ""), F.lit("</dl>"))
    per_page = per_date.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("announced", sec.alias("s")))).alias("_p"))
    return per_page.select(key, F.concat(F.lit("<html><body><p>arXiv:0000.00000 preface</p>"),
                                         F.array_join(F.transform("_p", lambda x: x["s"]), ""),
                                         F.lit("</body></html>")).alias("html"))


def render_criteria(criteria: DataFrame, by: str | None = None) -> DataFrame:
    """(doc, text): criteria rows as a markdown document (sections / topics / terms), or one per value of ``by``."""
    names = {v: k for k, v in SECTION_TIERS.items()}
    sec_name = F.lit(None).cast("string")
    for t, n in names.items():
        sec_name = F.when(F.col("tier") == t, F.lit(n)).otherwise(sec_name)
    doc = F.lit("criteria.md") if by is None else F.col(by)
    per_topic = criteria.groupBy(doc.alias("doc"), "tier", "topic").agg(F.array_join(F.array_sort(F.collect_list("term")), ", ")
                                                                        .alias("terms"))
    block = F.concat(F.lit("## "), sec_name, F.lit("\n\n### "), F.col("topic"), F.lit("\n- "), F.col("terms"))
    return per_topic.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list(F.struct("tier", "topic", block.alias("b")))
                                                                  ).getField("b"), "\n\n").alias("text")) \
        .select("doc", F.concat(F.lit("# Criteria\n\n"), F.col("text")).alias("text"))
