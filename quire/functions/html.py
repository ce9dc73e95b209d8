"""HTML entity decoding (FN-09).

Spark has no built-in for the full HTML5 entity table, so this is the one
Arrow-batched pandas UDF of the package. It is applied to short meta-tag
values, never to whole pages; values without ``&`` pass through unchanged.
"""

from __future__ import annotations

import html as _html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _decode(s: pd.Series) -> pd.Series:
    return s.map(lambda v: _html.unescape(v) if isinstance(v, str) else v)


# Marked non-deterministic only so that Catalyst never duplicates the call
# (e.g. by pushing a filter on its result below the projection).
_unescape = F.pandas_udf(_decode, T.StringType()).asNondeterministic()


# The five XML entities, decoded JVM-side in this order
# (``&amp;`` last, so ``&amp;lt;`` correctly becomes the text ``&lt;``).
BASIC_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
                  ("&amp;", "&"))
OTHER_REFERENCE = r"&(?!(?:amp|lt|gt|quot|#39|apos);)"


def _decode_basic(x: Column) -> Column:
    for ent, ch in BASIC_ENTITIES:
        x = F.replace(x, F.lit(ent), F.lit(ch))
    return x


def unescape_html(x) -> Column:
    """FN-09: decode every HTML5 character reference (``&amp;``, ``&#39;``, ...).

    Values whose only references are the five XML entities are decoded in
    the JVM (exactly what ``html.unescape`` gives for them). Only values with
    any other ``&`` reach the Python UDF; the rest reach it as nulls, so
    almost nothing crosses the Arrow boundary.
    """
    x = F.col(x) if isinstance(x, str) else x
    has_amp = x.contains("&")
    other = has_amp & x.rlike(OTHER_REFERENCE)
    return (F.when(~has_amp, x)
             .when(other, _unescape(F.when(other, x)))
             .otherwise(_decode_basic(x)))
