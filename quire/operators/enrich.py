"""Link and thumbnail enrichment (CP-07/08, JN-09, WN-07, FL-12, AG-10).

Per paper the reference walks: text URLs -> project pages -> images, keeping
the first success. Here the walk is a fan-out of joins:

    papers --classify--> (paper, ppos, project_url) --join pages--> page facts
                                                     --explode--> (paper, ppos, ipos, img) --join images-->
    first success = min_by over (ppos, ipos)

Each distinct page is parsed once (HTML never joins paper rows), and only
narrow (key, url) rows cross the shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import thumb_path
from ..functions.urls import (classify_urls, code_url_from_page, figure_candidates, image_candidates,
                              project_page_from_repo)
from ..schemas import MIN_IMAGE_BYTES
from ..session import cut_lineage

BLOOM_BITS = 1 << 23  # at most, of the filter over requested URLs (1 MB)


def _marks(url, kind) -> Column:
    """The two bits of a request in the word of its URL."""
    h = F.xxhash64(url, kind)
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n.bitwiseAND(F.lit(63)).cast("int"))
    return bit(h).bitwiseOR(bit(F.shiftrightunsigned(h, 6)))


def filter_words(requests: DataFrame, bits: int = BLOOM_BITS) -> Callable[[Column], Column]:
    """A Bloom filter over the requested (url, kind): gives the word that has the marks of a URL's requests.

    Spark sets the bits and keeps them as one row, at most ``bits`` / 64 words however many URLs are
    requested; few ones are folded to a shorter filter. The row is read by a scalar subquery:
    as a literal it would be printed whole in each description of a plan, of which the driver keeps many. Each place that reads it adds a copy
    to the code of a task, so all marks of a URL are in one word. When it is full it admits pages that nobody asked for.
    """
    place = lambda url, n: F.xxhash64(url).bitwiseAND(F.lit(n - 1))
    asked = requests.filter(F.col("url").isNotNull())
    words = cut_lineage(asked.groupBy(place("url", bits // 64).alias("w")).agg(F.bit_or(_marks("url", "kind")).alias("v")))
    ones, size = words.agg(F.sum(F.bit_count("v"))).first()[0] or 0, bits // 64
    while size > 16 and size * 64 > 16 * ones:
        size //= 2
    blank = requests.sparkSession.range(size).select("id", F.lit(0).cast("long").alias("v"))
    folded = words.select(F.col("w").bitwiseAND(F.lit(size - 1)).alias("id"), "v")
    dense = blank.union(folded).groupBy("id").agg(F.bit_or("v").alias("v"))
    held = cut_lineage(dense.agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("l")).select(F.col("l.v").alias("v"))).scalar()
    return lambda url: F.get(held, place(url, size).cast("int"))


def may_be_asked(word: Column, url: Column, kind: str) -> Column:
    """Whether a word of :func:`filter_words` has the marks of (url, kind); always so for a request."""
    marks = _marks(url, F.lit(kind))
    return word.bitwiseAND(marks) == marks


def url_filter(requests: DataFrame, bits: int = BLOOM_BITS) -> Callable[[Column, str], Column]:
    """:func:`filter_words` as a test on a page's URL and a kind."""
    word = filter_words(requests, bits)
    return lambda url, kind: may_be_asked(word(url), url, kind)


def page_facts(pages: DataFrame, requests: DataFrame, fetched_at: str | None = None, bits: int = BLOOM_BITS) -> DataFrame:
    """JN-09 + FN-16..19: parse each requested page where it is read.

    ``requests(url, kind)`` with kind in {project, repo, figure}. The scan of
    ``pages`` keeps the pages that a Bloom filter of the requests admits and turns them
    into facts at once, only those that the kinds need (CASE WHEN skips the other
    regexes). Only (url, facts) cross a shuffle, never HTML, however many URLs are requested. Returns
    (url, fetched, page_code, repo_project, images[], figures[]); a requested
    URL without a page gets ``fetched = false``. Of several fetches of a URL the latest by ``fetched_at``
    counts; without such a column, or at the same time, the one with the largest hash.
    """
    requests = requests.filter(F.col("url").isNotNull())
    wanted = requests.groupBy("url").agg(*[F.max(F.col("kind") == k).alias(f"_{k}") for k in ("project", "repo", "figure")])
    url = F.col("url")
    project, repo, figure = (may_be_asked(F.col("_word"), url, k) for k in ("project", "repo", "figure"))
    admitted = pages.withColumn("_word", filter_words(requests, bits)(url)).filter(project | repo | figure)
    facts = admitted.select(
        "url", F.struct(F.col(fetched_at) if fetched_at else F.lit(0), F.xxhash64("html")).alias("_at"),
        F.when(project, code_url_from_page("html")).alias("page_code"),
        F.when(repo, project_page_from_repo("html")).alias("repo_project"),
        F.when(project, image_candidates("html", url)).alias("images"),
        F.when(figure, figure_candidates("html", url)).alias("figures"))
    names = ["page_code", "repo_project", "images", "figures"]
    facts = facts.groupBy("url").agg(F.max_by(F.struct(*names), "_at").alias("_f")).select("url", "_f.*")
    kinds = {"page_code": "_project", "repo_project": "_repo", "images": "_project", "figures": "_figure"}
    return (wanted.join(facts.withColumn("fetched", F.lit(True)), "url", "left")
            .select("url", *[F.when(F.col(kinds[c]), F.col(c)).alias(c) for c in names], F.coalesce("fetched", F.lit(False)).alias("fetched")))


def image_ok(images: DataFrame) -> DataFrame:
    """FL-12: fetched images of at least the minimum size."""
    return images.filter(F.col("n_bytes") >= MIN_IMAGE_BYTES).select("url")


def text_links(papers: DataFrame) -> DataFrame:
    """FN-06 per paper: (paper_id, project[], code[])."""
    project, code = classify_urls(F.col("comment"), F.col("abstract"))
    return papers.select("paper_id", project.alias("project"), code.alias("code"))


def _findings(visits: DataFrame, facts: DataFrame, good: DataFrame) -> DataFrame:
    """(paper_id, _site, _page_code, _img): what comes first on the pages that a paper asks for.

    ``visits(paper_id, ppos, kind, url)`` give the pages in order, ``good(url)`` the acceptable images. One
    row per candidate image, or one where a page has none, crosses the shuffles.
    """
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    seen = visits.join(facts, "url").select(
        "paper_id", "ppos", of("project", "page_code").alias("page_code"), of("repo", "repo_project").alias("site"),
        F.posexplode_outer(F.coalesce(of("project", "images"), of("figure", "figures"))).alias("ipos", "img"))
    code = F.when(F.coalesce("ipos", F.lit(0)) == 0, F.col("page_code"))
    seen = (seen.withColumn("page_code", code)
            .join(good.select(F.col("url").alias("img"), F.lit(True).alias("_good")), "img", "left"))
    return seen.groupBy("paper_id").agg(
        F.min("site").alias("_site"),
        F.min_by("page_code", F.when(F.col("page_code").isNotNull(), F.col("ppos"))).alias("_page_code"),
        F.min_by("img", F.when(F.col("_good"), F.struct("ppos", "ipos"))).alias("_img"))


def enrich_links(papers: DataFrame, pages: DataFrame, images: DataFrame,
                 materialize: bool = True) -> DataFrame:
    """CP-07: (paper_id, project_url, code_url, thumbnail, image_url, success).

    * code URL: the first code link of the text, else the first one found on
      the project pages in order;
    * project URL: the first project link (set even if its page is missing);
      when the text has code links but no project link, the first GitHub
      repository page may point at a ``*.github.io`` project page;
    * thumbnail: the first acceptable image over the project pages in order,
      else the first acceptable figure of the paper's rendered HTML page.

    Pages are read in two passes: the text's project and repo pages first;
    then the ``github.io`` pages named by repo pages and, only for papers
    still without an acceptable image, their rendered paper page.

    ``links`` (per-paper URL lists) and ``first`` (what the first pass found) are
    read several times; with ``materialize`` they are written once to the shared
    checkpoint directory (reliable checkpoint, survives executor loss) so that
    papers and pages are not derived again.
    """
    cut = cut_lineage if materialize else (lambda df: df)
    links = text_links(papers)
    gh_repo = F.get(F.filter("code", lambda u: u.contains("github.com")), 0)
    links = cut(links.withColumn("_repo", F.when(F.size("project") == 0, gh_repo)))
    good = image_ok(images)
    # the text's project pages, or the repository that may name one
    proj = links.select("paper_id", F.posexplode("project").alias("ppos", "url"), F.lit("project").alias("kind"))
    repo = links.filter(F.col("_repo").isNotNull()).select("paper_id", F.lit(0).alias("ppos"), F.col("_repo").alias("url"), F.lit("repo").alias("kind"))
    visits = proj.unionByName(repo)
    found = _findings(visits, page_facts(pages, visits.select("url", "kind")), good)
    first = cut(links.join(found, "paper_id", "left").select(
        "paper_id", F.get("project", 0).alias("_project"), F.get("code", 0).alias("_code"), F.size("project").alias("_n"),
        "_site", "_page_code", "_img"))
    # second hop: (a) project pages named by repo pages, after the text ones;
    # (b) then the rendered paper page, only for papers whose project pages
    # gave no acceptable image
    page = lambda kind, n, url: F.struct(F.lit(kind).alias("kind"), n.alias("ppos"), url.alias("url"))
    rendered = F.concat(F.lit("https://arxiv.org/html/"), F.col("paper_id"), F.lit("v1"))
    hops = F.array(F.when(F.col("_site").isNotNull(), page("project", F.col("_n"), F.col("_site"))),
                   F.when(F.col("_img").isNull(), page("figure", F.col("_n") + 1, rendered)))
    visits = first.select("paper_id", F.explode(F.filter(hops, lambda h: h.isNotNull())).alias("h")).select("paper_id", "h.*")
    found = _findings(visits, page_facts(pages, visits.select("url", "kind")), good)
    then = found.select("paper_id", F.col("_page_code").alias("_page_code2"), F.col("_img").alias("_img2"))
    img = F.coalesce("_img", "_img2")
    code = F.coalesce("_code", "_page_code", "_page_code2")
    return first.join(then, "paper_id", "left").select(
        "paper_id",
        F.coalesce("_project", "_site").alias("project_url"),
        code.alias("code_url"),
        F.when(img.isNotNull(), thumb_path(F.col("paper_id"), img)).alias("thumbnail"),
        img.alias("image_url"),
        (img.isNotNull() | code.isNotNull()).alias("success"))


def apply_enrichment(catalog: DataFrame, enriched: DataFrame) -> DataFrame:
    """JN-07/JN-08: code and project URLs are only filled where null (sticky);
    the thumbnail is set whenever one was found."""
    e = enriched.select("paper_id", F.col("project_url").alias("_p"), F.col("code_url").alias("_c"),
                        F.col("thumbnail").alias("_t"))
    j = catalog.join(e, "paper_id", "left")
    return j.select(*[
        F.coalesce("code_url", "_c").alias(c) if c == "code_url"
        else F.coalesce("project_url", "_p").alias(c) if c == "project_url"
        else F.coalesce("_t", "thumbnail").alias(c) if c == "thumbnail"
        else F.col(c) for c in catalog.columns])


def enrich_missing(catalog: DataFrame, pages: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CP-08: enrich the papers without a thumbnail -> (new catalog, report)."""
    todo = catalog.filter(F.col("thumbnail").isNull()).select("paper_id", "comment", "abstract")
    enriched = enrich_links(todo, pages, images)
    return apply_enrichment(catalog, enriched), enrichment_report(enriched)


def enrichment_report(enriched: DataFrame) -> DataFrame:
    """AG-10: papers attempted and papers with a thumbnail or a code URL."""
    return enriched.agg(F.count(F.lit(1)).alias("attempted"), F.count_if("success").alias("succeeded"))
