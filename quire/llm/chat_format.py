r"""Relational chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted, and adjacent turns of
one role merged into a block:

    <turn>ROLE\nTEXT<next>TEXT ...</turn>\n

``<next>`` separates the texts of a merged block, so the original turns can be
read back. Inside texts and roles the control strings ``<turn>``, ``</turn>``
and ``<next>`` are escaped by a backslash after ``<``; strings that look
escaped already get one more, so unescaping is exact. Nothing else changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .registry import register

OPEN, NEXT, CLOSE = "<turn>", "<next>", "</turn>\n"
TO_ESCAPE = r"<(\\*/?(?:turn|next)>)"
ESCAPED = r"<\\(\\*/?(?:turn|next)>)"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, TO_ESCAPE, r"<\\$1")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "<$1")


def escape_role(role: Column) -> Column:
    r"""A role ends at the first line end, so backslash becomes ``\b`` and line end ``\l``."""
    return escape_text(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\l")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape_text(role), F.lit("\\l"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text",
                         loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_col``, formatted, loss_spans, n_blocks.

    ``loss_spans`` lists (start, length) in code points of ``formatted``, one
    per text of ``loss_role`` in order, markup excluded. Null texts and roles
    count as empty. Rows of one turn number are ordered by role, then text; a
    null turn number comes first; repeated rows stay repeated. Rows without a
    conversation id form one conversation of their own. Columns beside the four
    are not read. An empty table gives no rows.
    """
    one = turns.select(F.col(conv_col).alias("conv"),
                       F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"),
                                F.coalesce(text_col, F.lit("")).alias("text")).alias("t"))
    got = one.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    # block starts: the positions (from 1) whose role differs from the one before
    starts = F.filter(F.sequence(F.lit(1), n),
                      lambda i: (i == 1) | (F.get("turns", i - 1)["role"] != F.get("turns", i - 2)["role"]))
    got = got.withColumn("starts", starts)
    got = got.withColumn("blocks", F.transform("starts", lambda s, k: F.struct(
        F.get("turns", s - 1)["role"].alias("role"),
        F.transform(F.slice("turns", s, F.coalesce(F.get("starts", k + 1), n + 1) - s),
                    lambda t: escape_text(t["text"])).alias("texts"))))
    head = lambda b: F.concat(F.lit(OPEN), escape_role(b["role"]), F.lit("\n"))
    # a running offset over all texts: each adds its own length and the markup before it
    spans = F.aggregate(
        "blocks", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, b: F.struct(
            (acc["at"] + _rendered_length(b, head(b))).alias("at"),
            F.when(b["role"] == loss_role, F.concat(acc["spans"], _block_spans(b["texts"], acc["at"] + F.length(head(b)))))
            .otherwise(acc["spans"]).alias("spans")))["spans"]
    return got.select(
        F.col("conv").alias(conv_col),
        F.array_join(F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], NEXT), F.lit(CLOSE))), "").alias("formatted"),
        spans.alias("loss_spans"), F.size("blocks").alias("n_blocks"))


def _rendered_length(block: Column, head: Column) -> Column:
    return F.length(head) + F.length(F.array_join(block["texts"], NEXT)) + len(CLOSE)


def _block_spans(texts: Column, at: Column) -> Column:
    """(start, length) of each text of a block whose first text starts at ``at``."""
    return F.aggregate(
        texts, F.struct(at.cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t) + len(NEXT)).alias("at"),
            F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), F.length(t).cast("long").alias("length")))).alias("spans")))["spans"]


def parse_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation, in order."""
    parts = F.split(formatted, CLOSE, -1)  # the last part is the empty rest
    blocks = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.flatten(F.transform(blocks, lambda b: F.transform(
        F.split(F.substring(b, F.locate("\n", b) + 1, F.length(b)), NEXT, -1),
        lambda t: F.struct(unescape_role(F.substring(b, F.lit(len(OPEN) + 1), F.locate("\n", b) - len(OPEN) - 1)).alias("role"),
                           unescape_text(t).alias("text")))))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, nothing between its spans."""
    return F.array_join(F.transform(spans, lambda s: unescape_text(
        F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")


PROBE = "\\### Assistant: </turn> ok"

OP1_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select * from (values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
), b as (
  select *, lag(role) over (partition by conv_id order by turn, role, text) is not distinct from role as joined,
         length(regexp_replace(text, '<(\\*/?(?:turn|next)>)', '<\\\1', 'g')) as n
  from t
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(n + case when joined then 6 else 7 + length(role) + 8 end) as bigint) as formatted_chars
from b group by conv_id
"""


@register("op1_chat_format", OP1_SQL)
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)],
                                  "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    out = (format_conversations(turns)
           .withColumn("turns", parse_turns(F.col("formatted")))
           .withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans"))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                      F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"))
