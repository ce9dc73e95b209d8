"""URL extraction, classification and resolution (Column -> Column).

Everything here is built from regex + higher-order array functions, so it stays
inside whole-stage codegen; nothing is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import (CODE_HOSTS, CODE_PATH_SKIP, FIGURE_SKIP_WORDS, GITHUB_NOISE, IMAGE_EXTENSIONS,
                       IMAGE_KEYWORDS, MAX_FIGURES)
from .text import WS_CLASS, _c


def _empty() -> Column:
    return F.array().cast("array<string>")


# ---------------------------------------------------------------------------
# Fixed patterns (must equal the link rules this engine reproduces).
# ---------------------------------------------------------------------------
URL_RE = rf"https?://[^{WS_CLASS}]+"
CARD_CODE_RE = r"https?://(?:github\.com|gitlab\.com|bitbucket\.org|huggingface\.co)/" + rf"[^{WS_CLASS}]+"
OG_IMAGE_RE = r"""(?i)<meta\s+(?:[^>]*?)property=["']og:image["']\s+content=["']([^"']+)["']"""
OG_IMAGE_RE2 = r"""(?i)<meta\s+(?:[^>]*?)content=["']([^"']+)["']\s+property=["']og:image["']"""
IMG_KEYWORD_RE = rf"""(?i)<img\s+[^>]*src=["']([^"']+(?:{IMAGE_KEYWORDS})[^"']*)["']"""
IMG_EXT_RE = rf"""(?i)<img\s+[^>]*src=["']([^"']+\.(?:{IMAGE_EXTENSIONS}))["']"""
FIG_KEYWORD_RE = rf"""(?i)<img\s+[^>]*src=["']([^"']*(?:{IMAGE_KEYWORDS})[^"']*\.(?:{IMAGE_EXTENSIONS}))["']"""
CODE_HREF_RE = (r"""(?i)href=["']?(https?://(?:github\.com|gitlab\.com|huggingface\.co)/"""
                rf"""[^"'>{WS_CLASS}]+)["']?""")
GITHUB_IO_HREF_RE = rf"""(?i)href=["']?(https?://[^"'>{WS_CLASS}]*\.github\.io/[^"'>{WS_CLASS}]*)["']?"""


def rstrip_chars(u: Column, chars: str) -> Column:
    """Python ``str.rstrip(chars)``."""
    cls = "".join("\\" + ch if ch in "\\]^-[" else ch for ch in chars)
    return F.regexp_replace(u, f"[{cls}]+$", "")


def extract_urls(x) -> Column:
    """FN-03: every ``https?://\\S+`` in the text, right-stripped of ``.,;:)``."""
    found = F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(URL_RE), 0)
    return F.transform(found, lambda u: rstrip_chars(u, ".,;:)"))


def is_self_link(u) -> Column:
    """FL-09: a link back to the paper site (arxiv.org)."""
    return _c(u).contains("arxiv.org")


def is_code_url(u, hosts=CODE_HOSTS) -> Column:
    """FN-04: a code host substring and not a ``.github.io`` page."""
    u = _c(u)
    any_host = reduce(lambda a, b: a | b, [u.contains(h) for h in hosts])
    return ~u.contains(".github.io") & any_host


def is_project_url(u) -> Column:
    """FN-05: neither a self link nor a code URL."""
    return ~is_self_link(u) & ~is_code_url(u)


def text_urls(comment, abstract) -> Column:
    """URLs of comment then abstract, first occurrence kept, self links dropped."""
    both = F.concat(extract_urls(comment), extract_urls(abstract))
    return F.array_distinct(F.filter(both, lambda u: ~is_self_link(u)))


def classify_urls(comment, abstract) -> tuple[Column, Column]:
    """FN-06: (project_urls, code_urls), each ordered and duplicate-free."""
    urls = text_urls(comment, abstract)
    return (F.filter(urls, lambda u: ~is_code_url(u)), F.filter(urls, lambda u: is_code_url(u)))


def project_url_from_comment(comment) -> Column:
    """FN-07: first URL that is neither arxiv.org nor github.com, else first github.com."""
    urls = extract_urls(comment)
    first_other = F.get(F.filter(urls, lambda u: ~u.contains("arxiv.org") & ~u.contains("github.com")), 0)
    first_gh = F.get(F.filter(urls, lambda u: u.contains("github.com")), 0)
    return F.when(F.coalesce(_c(comment), F.lit("")) != "", F.coalesce(first_other, first_gh))


def card_links(project_url, code_url, abstract, comment) -> Column:
    """FN-08: ordered ``array<struct<label,url>>`` shown on a paper card.

    Stored project and code URLs first (not de-duplicated against each other),
    then per text (abstract, then comment) code-host URLs and, when the text
    mentions "project", other non-self URLs; first occurrence of a URL wins.
    """
    def lab(label, arr):
        return F.transform(arr, lambda u: F.struct(F.lit(label).alias("label"), u.alias("url")))

    stored = F.filter(
        F.array(F.struct(F.lit("project").alias("label"), _c(project_url).alias("url")),
                F.struct(F.lit("code").alias("label"), _c(code_url).alias("url"))),
        lambda s: s["url"].isNotNull() & (s["url"] != ""))
    seen, links = F.transform(stored, lambda s: s["url"]), stored
    for text in (_c(abstract), _c(comment)):
        t = F.coalesce(text, F.lit(""))
        code = F.transform(F.regexp_extract_all(t, F.lit(CARD_CODE_RE), 0),
                           lambda u: rstrip_chars(u, ".,;:)"))
        proj = F.when(F.lower(t).contains("project"),
                      F.filter(extract_urls(t), lambda u: ~is_self_link(u))).otherwise(_empty())
        for label, urls in (("code", code), ("project", proj)):
            # set operations hash: the cost follows the number of URLs, and first places stay
            links = F.concat(links, lab(label, F.array_except(urls, seen)))
            seen = F.array_union(seen, urls)
    return links


# ---------------------------------------------------------------------------
# RFC 3986 reference resolution, as expressions.
# ---------------------------------------------------------------------------
_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once and stands once in the plan, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _remove_dot_segments(path: Column) -> Column:
    def joined(segs: Column) -> Column:
        stack = F.aggregate(
            segs, _empty(),
            lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1))
                                  .otherwise(acc))
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s))))
        tail = F.when(F.element_at(segs, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(_empty())
        return F.array_join(F.concat(stack, tail), "/")
    return _let(F.split(path, "/", -1), joined)


def _base_parts(base: Column) -> Column:
    scheme = F.regexp_extract(base, _SCHEME, 1)
    return F.struct(
        base.alias("url"), scheme.alias("scheme"),
        F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1).alias("authority"),
        F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1).alias("path"),
        F.regexp_extract(base, r"^[^?#]*(\?[^#]*)?", 1).alias("query"))


def _resolve(b: Column, ref: Column) -> Column:
    """:func:`resolve_url` with the parts of the base."""
    origin = F.concat(b["scheme"], F.lit("://"), b["authority"])

    def by_path(rpath: Column) -> Column:
        rtail = F.substring(ref, F.length(rpath) + 1, F.length(ref))
        path = (F.when(ref.startswith("/"), rpath)
                 .when((b["authority"] != "") & (b["path"] == ""), F.concat(F.lit("/"), rpath))
                 .otherwise(F.concat(F.regexp_replace(b["path"], r"[^/]*$", ""), rpath)))
        same = F.concat(b["path"], F.when(ref.startswith("?"), F.lit("")).otherwise(b["query"]))
        return F.concat(origin, F.when(rpath == "", same).otherwise(_remove_dot_segments(path)), rtail)

    return (F.when(ref.rlike(_SCHEME), ref)
             .when(ref.startswith("//"), F.concat(b["scheme"], F.lit(":"), ref))
             .when(ref == "", b["url"])
             .when(ref.startswith("#"), F.concat(F.regexp_replace(b["url"], "#.*$", ""), ref))
             .otherwise(_let(F.regexp_extract(ref, r"^([^?#]*)", 1), by_path)))


def resolve_url(base, ref) -> Column:
    """FN-15: resolve ``ref`` against ``base`` like ``urllib.parse.urljoin``.

    Covers absolute refs, ``//host``, ``/path``, ``?query``, ``#frag`` and
    relative paths with ``.``/``..`` segments.
    """
    return _let(_base_parts(_c(base)), lambda b: _resolve(b, _c(ref)))


def page_base(url) -> Column:
    """Page URL used as the base for its images: a trailing ``/`` is added when
    the last path segment has no dot."""
    url = _c(url)
    last = F.element_at(F.split(url, "/", -1), -1)
    return F.when(~url.endswith("/") & ~last.contains("."), F.concat(url, F.lit("/"))).otherwise(url)


def image_candidates(html, page_url) -> Column:
    """FN-16: ordered, duplicate-free image URLs of a project page.

    og:image (either attribute order, first only), then ``<img>`` sources with a
    keyword, then any ``<img>`` with an image extension; relative sources are
    resolved against the page.
    """
    h = F.coalesce(_c(html), F.lit(""))
    og1 = F.nullif(F.regexp_extract(h, OG_IMAGE_RE, 1), F.lit(""))
    og2 = F.nullif(F.regexp_extract(h, OG_IMAGE_RE2, 1), F.lit(""))
    og = F.filter(F.array(F.coalesce(og1, og2)), lambda u: u.isNotNull())
    raw = F.concat(og, F.regexp_extract_all(h, F.lit(IMG_KEYWORD_RE), 1),
                   F.regexp_extract_all(h, F.lit(IMG_EXT_RE), 1))
    return F.array_distinct(_let(_base_parts(page_base(page_url)), lambda b: F.transform(
        raw, lambda u: F.when(u.startswith("http"), u).otherwise(_resolve(b, u)))))


def figure_candidates(html, base) -> Column:
    """FN-17 + FL-11 + SO-06: up to three figure URLs of a rendered paper page.

    Keyword images first, then any image; de-duplicated on the raw source;
    icons, badges and logos skipped; resolved against ``base`` as is.
    """
    h = F.coalesce(_c(html), F.lit(""))
    raw = F.array_distinct(F.concat(F.regexp_extract_all(h, F.lit(FIG_KEYWORD_RE), 1),
                                    F.regexp_extract_all(h, F.lit(IMG_EXT_RE), 1)))
    keep = F.filter(raw, lambda u: ~figure_skip(u))
    return _let(_base_parts(_c(base)), lambda b: F.transform(F.slice(keep, 1, MAX_FIGURES), lambda u: _resolve(b, u)))


def figure_skip(src) -> Column:
    """FL-11: sources that are icons, badges or logos."""
    low = F.lower(_c(src))
    return reduce(lambda a, b: a | b, [low.contains(w) for w in FIGURE_SKIP_WORDS])


def code_link_ok(u) -> Column:
    """FL-10: a repository link (not a file inside one, not a site page)."""
    u = _c(u)
    in_repo_file = reduce(lambda a, b: a | b, [u.contains(x) for x in CODE_PATH_SKIP])
    noise = reduce(lambda a, b: a | b, [u.startswith("https://" + n) for n in GITHUB_NOISE])
    n_parts = F.size(F.split(F.regexp_replace(u, "/+$", ""), "/", -1))
    gh = u.contains("github.com")
    return (~in_repo_file & ~noise
            & ((gh & (n_parts >= 5)) | (~gh & (u.contains("huggingface.co") | u.contains("gitlab.com")))))


def page_code_links(html) -> Column:
    """All code-host hrefs of a page, stripped, in document order."""
    found = F.regexp_extract_all(F.coalesce(_c(html), F.lit("")), F.lit(CODE_HREF_RE), 1)
    return F.transform(found, lambda u: rstrip_chars(u, ".,;:)'\""))


def code_url_from_page(html) -> Column:
    """FN-18: first acceptable repository link of a page (document order)."""
    return F.get(F.filter(page_code_links(html), code_link_ok), 0)


def project_page_from_repo(html) -> Column:
    """FN-19: first ``*.github.io/`` href of a repository page, stripped."""
    m = F.regexp_extract(F.coalesce(_c(html), F.lit("")), GITHUB_IO_HREF_RE, 1)
    return F.nullif(rstrip_chars(m, ".,;:)"), F.lit(""))

