"""DuckDB spellings of the Column functions, for the oracle statements.

The regex constants are the very strings the Spark side uses (Java and RE2
agree on these patterns); only the surrounding list/lambda syntax differs.
"""

from ..functions.text import RE2_WS, WS_CLASS, WS_RUN
from ..functions import urls as U
from ..schemas import CODE_HOSTS, CODE_PATH_SKIP, FIGURE_SKIP_WORDS, GITHUB_NOISE


def re2(pattern: str) -> str:
    """A Java pattern of this package in RE2 spelling."""
    return pattern.replace(WS_CLASS, RE2_WS)


def lit(s: str) -> str:
    """A Python string (regex patterns in RE2 spelling) as a SQL string literal."""
    return "'" + re2(s).replace("'", "''") + "'"


def collapse_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, {lit(WS_RUN)}, ' ', 'g'))"


def escape_sql(x: str) -> str:
    return (f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
            "'\"', '&quot;')")


def rstrip_sql(x: str, chars: str) -> str:
    cls = "".join("\\" + ch if ch in "\\]^-[" else ch for ch in chars)
    return f"regexp_replace({x}, {lit('[' + cls + ']+$')}, '')"


def ordered_distinct_sql(lst: str) -> str:
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


def extract_urls_sql(x: str) -> str:
    return (f"list_transform(regexp_extract_all(coalesce({x}, ''), {lit(U.URL_RE)}), "
            f"lambda u: {rstrip_sql('u', '.,;:)')})")


def is_code_sql(u: str, hosts=CODE_HOSTS) -> str:
    anyh = " or ".join(f"contains({u}, '{h}')" for h in hosts)
    return f"(not contains({u}, '.github.io') and ({anyh}))"


def text_urls_sql(comment: str, abstract: str) -> str:
    both = f"list_concat({extract_urls_sql(comment)}, {extract_urls_sql(abstract)})"
    return ordered_distinct_sql(f"list_filter({both}, lambda u: not contains(u, 'arxiv.org'))")


def code_link_ok_sql(u: str) -> str:
    skip = " or ".join(f"contains({u}, '{s}')" for s in CODE_PATH_SKIP)
    noise = " or ".join(f"starts_with({u}, 'https://{n}')" for n in GITHUB_NOISE)
    parts = f"len(string_split(regexp_replace({u}, '/+$', ''), '/'))"
    gh = f"contains({u}, 'github.com')"
    return (f"(not ({skip}) and not ({noise}) and (({gh} and {parts} >= 5) or "
            f"(not {gh} and (contains({u}, 'huggingface.co') or contains({u}, 'gitlab.com')))))")


def page_code_links_sql(html: str) -> str:
    return (f"list_transform(regexp_extract_all(coalesce({html}, ''), {lit(U.CODE_HREF_RE)}, 1), "
            f"lambda u: {rstrip_sql('u', chr(46) + ',;:)' + chr(39) + chr(34))})")


def code_url_from_page_sql(html: str) -> str:
    return f"list_filter({page_code_links_sql(html)}, lambda u: {code_link_ok_sql('u')})[1]"


def image_candidates_sql(html: str) -> str:
    """Absolute sources only (the fixtures hold no relative image paths)."""
    h = f"coalesce({html}, '')"
    og = (f"coalesce(nullif(regexp_extract({h}, {lit(U.OG_IMAGE_RE)}, 1), ''), "
          f"nullif(regexp_extract({h}, {lit(U.OG_IMAGE_RE2)}, 1), ''))")
    allc = (f"list_concat(case when {og} is null then [] else [{og}] end, "
            f"regexp_extract_all({h}, {lit(U.IMG_KEYWORD_RE)}, 1), regexp_extract_all({h}, {lit(U.IMG_EXT_RE)}, 1))")
    return ordered_distinct_sql(allc)


def figure_skip_sql(u: str) -> str:
    return "(" + " or ".join(f"contains(lower({u}), '{w}')" for w in FIGURE_SKIP_WORDS) + ")"


def figure_candidates_sql(html: str) -> str:
    h = f"coalesce({html}, '')"
    raw = ordered_distinct_sql(f"list_concat(regexp_extract_all({h}, {lit(U.FIG_KEYWORD_RE)}, 1), "
                               f"regexp_extract_all({h}, {lit(U.IMG_EXT_RE)}, 1))")
    return f"list_filter({raw}, lambda u: not {figure_skip_sql('u')})[1:3]"


def thumb_path_sql(pid: str, url: str) -> str:
    low = f"lower({url})"
    return (f"concat('thumbs/', {pid}, case when contains({low}, '.png') then '.png' when contains({low}, '.gif') "
            f"then '.gif' when contains({low}, '.webp') then '.webp' else '.jpg' end)")
