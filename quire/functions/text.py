"""Text, date and array scalar functions (Column -> Column, all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CARD_AUTHOR_CAP, ID_PATTERN

# Whitespace as Python's ``str.split()`` sees it: ASCII space/controls, the
# information separators 0x1C-0x1F, NEL, NBSP and the Unicode space separators.
# Java's isWhitespace covers all of them except NEL, NBSP, U+2007 and U+202F,
# so those four are added; one predicate check per character instead of a
# chain of ranges. (The DuckDB oracles spell the class out, see RE2_WS.)
WS_CLASS = r"\p{javaWhitespace}\x{85}\x{A0}\x{2007}\x{202F}"
WS_RUN = f"[{WS_CLASS}]+"
# The same set written for RE2 (no \p{javaWhitespace} there).
RE2_WS = (r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
          r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse_ws(x) -> Column:
    """FN-01: split on any whitespace and re-join with single spaces."""
    return F.trim(F.regexp_replace(_c(x), WS_RUN, " "))


def py_strip(x) -> Column:
    """Python ``str.strip()``: drop leading/trailing whitespace of any kind."""
    return F.regexp_replace(_c(x), f"^{WS_RUN}|{WS_RUN}$", "")


def extract_id(x) -> Column:
    """FN-02: first ``dddd.dddd(d)`` in the text, version dropped; null if none."""
    return F.nullif(F.regexp_extract(_c(x), ID_PATTERN, 1), F.lit(""))


def strip_tags(x) -> Column:
    """FN-10: drop every ``<...>`` tag."""
    return F.regexp_replace(_c(x), r"<[^>]+>", "")


def flip_author(a) -> Column:
    """FN-11: ``Last, First`` -> ``First Last`` (split at the first ", ")."""
    a = _c(a)
    parts = F.split(a, ", ", 2)
    return F.when(a.contains(", "), F.concat(parts[1], F.lit(" "), parts[0])).otherwise(a)


def primary_first(primary, categories) -> Column:
    """FN-12: primary category first, then the others; distinct, blanks dropped."""
    allc = F.concat(F.array(_c(primary)), F.coalesce(_c(categories), F.array().cast("array<string>")))
    return F.array_distinct(F.filter(allc, lambda t: t.isNotNull() & (t != "")))


def pdf_link(links, title: str = "title", href: str = "href") -> Column:
    """FN-13: href of the first link titled ``pdf``; null if none."""
    return F.get(F.filter(_c(links), lambda lk: lk[title] == "pdf"), 0)[href]


def parse_day_month_year(x) -> Column:
    """FN-14: ``Tue, 10 Mar 2026 00:00:00 -0400`` / ``Mon, 9 Mar 2026`` -> DATE.

    The date is taken as written (time zone ignored); unparseable -> null.
    """
    x = _c(x)
    pat = r"(\d{1,2})\s+(\w+)\s+(\d{4})"
    txt = F.concat_ws(" ", F.regexp_extract(x, pat, 1), F.regexp_extract(x, pat, 2),
                      F.regexp_extract(x, pat, 3))
    return F.when(x.rlike(pat), F.try_to_date(txt, "d MMM yyyy"))


def valid_date(s) -> Column:
    """FL-06: ``YYYY-M-D`` with or without zero padding; impossible dates -> null."""
    s = _c(s)
    return F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(s, "yyyy-M-d"))


def encode_array(a) -> Column:
    """FN-20: array -> JSON text (legacy catalog export)."""
    return F.to_json(_c(a))


def decode_array(x) -> Column:
    """FN-20: JSON text -> array; undecodable text is kept as a one-element array."""
    x = _c(x)
    return F.when(x.isNull() | (x == ""), F.lit(None).cast("array<string>")).otherwise(
        F.coalesce(F.from_json(x, "array<string>"), F.array(x)))


def tier_letter(t) -> Column:
    """FN-21: first letter of the tier upper-cased, ``?`` when missing."""
    return F.upper(F.left(F.coalesce(_c(t), F.lit("?")), F.lit(1)))


def tier_rank(t) -> Column:
    """Display order of a tier: high 0, moderate 1, anything else 2."""
    t = _c(t)
    return F.when(t == "high", 0).when(t == "moderate", 1).otherwise(2)


def count_label(n) -> Column:
    """PR-04: ``1 paper`` / ``n papers``."""
    n = _c(n)
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(" paper")).otherwise(F.lit(" papers")))


def month_prefix(d) -> Column:
    """PR-05: ``2026-03-10`` -> ``2603`` (the ID prefix of new papers)."""
    return F.date_format(_c(d).cast("date"), "yyMM")


def short_model_name(m) -> Column:
    """PR-09: second ``-`` field of a model name."""
    return F.split_part(_c(m), F.lit("-"), F.lit(2))


def thumb_path(paper_id, url) -> Column:
    """PR-08: ``thumbs/<id><ext>``; ext by substring precedence png > gif > webp > jpg."""
    low = F.lower(_c(url))
    ext = (F.when(low.contains(".png"), ".png").when(low.contains(".gif"), ".gif")
            .when(low.contains(".webp"), ".webp").otherwise(".jpg"))
    return F.concat(F.lit("thumbs/"), _c(paper_id), ext)


def cap_authors(authors, k: int = CARD_AUTHOR_CAP, with_total: bool = False) -> Column:
    """SO-07: first k authors joined by ", ".

    ``with_total`` (digest form): ``... et al. (N authors)``; otherwise (card
    form) `` et al.`` when there are more than k.
    """
    a = F.coalesce(_c(authors), F.array().cast("array<string>"))
    head = F.array_join(F.slice(a, 1, k), ", ")
    n = F.size(a)
    if with_total:
        tail = F.concat(F.lit(" et al. ("), n.cast("string"), F.lit(" authors)"))
    else:
        tail = F.lit(" et al.")
    return F.when(n > k, F.concat(head, tail)).otherwise(head)


def xml_escape(x) -> Column:
    """Escape ``& < > "`` for rendering text into XML/HTML fixtures."""
    x = F.regexp_replace(_c(x), "&", "&amp;")
    x = F.regexp_replace(x, "<", "&lt;")
    x = F.regexp_replace(x, ">", "&gt;")
    return F.regexp_replace(x, '"', "&quot;")
