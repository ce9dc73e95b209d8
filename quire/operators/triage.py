"""Two-stage relevance triage: batching, the term judge, the pluggable scorer
hook, candidate selection, prompts, judge envelopes and their reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import month_prefix
from ..schemas import STAGE1_OUTPUT, STAGE2_OUTPUT, STAGE2_REQUIRED
from ..session import cut_lineage
from .ordering import group_sizes, ordered_positions

# Bytes of term text in one automaton; larger term tables are dealt to several.
AUTOMATON_BYTES = 1 << 20

# ---------------------------------------------------------------------------
# The prompt texts sent to an external judge.
# ---------------------------------------------------------------------------
STAGE1_PROMPT_HEAD = "Here are the filter criteria:\n\n"
STAGE1_PROMPT_PAPERS = "\n\n--- PAPERS ---\n"
STAGE1_PROMPT_TAIL = (
    "\n\nReturn candidate arxiv_id strings for papers worth reading the abstract of. "
    "Exclude revisions (ID prefix must be {prefix}). "
    "Be generous — include anything that could plausibly be relevant. "
    "Only exclude papers clearly outside the criteria. "
    "A second stage will read abstracts and make the final call.")
STAGE2_PROMPT_PAPERS = "\n\n--- CANDIDATE PAPERS (full details) ---\n"
STAGE2_PROMPT_TAIL = (
    "\n\nSelect the relevant papers. For each, include all fields from the input "
    "plus relevance_tier (high/moderate) and relevance_summary (one line). "
    "Exclude revisions.")


# ---------------------------------------------------------------------------
# Projections / filters
# ---------------------------------------------------------------------------
def title_scan_columns(papers: DataFrame) -> DataFrame:
    """PR-01: the only columns stage 1 reads (the abstract is pruned at the scan)."""
    return papers.select("paper_id", "title", "published")


def title_line(paper_id, title, published) -> Column:
    """SNK-06: ``<id>  <title>  (published: <published or ?>)``."""
    return F.concat(F.col(paper_id) if isinstance(paper_id, str) else paper_id, F.lit("  "),
                    F.col(title) if isinstance(title, str) else title, F.lit("  (published: "),
                    F.coalesce(F.col(published) if isinstance(published, str) else published, F.lit("?")),
                    F.lit(")"))


def title_lines(papers: DataFrame) -> DataFrame:
    """SNK-06: (paper_id, line)."""
    return papers.select("paper_id", title_line("paper_id", "title", "published").alias("line"))


def exclude_revisions(papers: DataFrame, run_date, months: int = 1) -> DataFrame:
    """FL-01: keep papers whose id carries the run month prefix (``yyMM``);
    ``months=2`` also accepts the previous month."""
    d = F.lit(run_date).cast("date")
    ok = F.col("paper_id").startswith(month_prefix(d))
    for k in range(1, months):
        ok = ok | F.col("paper_id").startswith(month_prefix(F.add_months(d, -k)))
    return papers.filter(ok)


# ---------------------------------------------------------------------------
# Batching
# ---------------------------------------------------------------------------
def balanced_batches(df: DataFrame, cap: int, order: list, by: list[str] | None = None) -> DataFrame:
    """WN-05: contiguous batches of near-equal size, order kept.

    ``n = max(1, ceil(N/cap))`` batches of ``size = ceil(N/n)`` rows per group
    (1000/200 -> 5 x 200; 201/200 -> 101 + 100). Adds ``pos`` (1-based) and
    ``batch_id`` (0-based). Empty input gives no batches. Positions come from
    :func:`ordered_positions`, so one huge group still sorts in parallel.
    """
    by = by or []
    pos = ordered_positions(df, by, order, "pos")
    sized = group_sizes(pos, by, "_n")
    n_batches = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(cap)))
    size = F.ceil(F.col("_n") / n_batches)
    return sized.withColumn("batch_id", F.floor((F.col("pos") - 1) / size).cast("long")).drop("_n")


def fixed_batches(ids: DataFrame, size: int, order: list, by: list[str] | None = None) -> DataFrame:
    """WN-09: fixed-size request lists (last one short): (by.., batch_id, id_list, n)."""
    by = by or []
    pos = ordered_positions(ids, by, order, "pos")
    b = pos.withColumn("batch_id", F.floor((F.col("pos") - 1) / size).cast("long"))
    return (b.groupBy(*by, "batch_id")
             .agg(F.array_sort(F.collect_list(F.struct("pos", "paper_id"))).alias("_l"),
                  F.count(F.lit(1)).alias("n"))
             .select(*by, "batch_id", F.array_join(F.transform("_l", lambda x: x["paper_id"]), ",").alias("id_list"),
                     "n"))


# ---------------------------------------------------------------------------
# Term judge (CP-02)
# ---------------------------------------------------------------------------
def _tier_from(tiers: Column, mode: str) -> Column:
    has = lambda t: F.array_contains(tiers, t)
    if mode == "strict":
        return (F.when(has("exclude"), F.lit(None).cast("string"))
                 .when(has("high"), F.lit("high")).when(has("moderate"), F.lit("moderate")))
    # generous: any positive term passes, exclude terms are ignored
    return F.when(has("high") | has("moderate") | has("low"), F.lit("candidate"))


def _summary(topics: Column) -> Column:
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(topics)), ", "), F.lit(""))


def judge_by_terms(papers: DataFrame, criteria: DataFrame, text_col: str = "title",
                   mode: str = "strict", key: str = "paper_id") -> DataFrame:
    """CP-02: deterministic judge from a ``criteria(tier, topic, term)`` table.

    ``strict``: any exclude term drops the paper, else any high term -> high,
    else any moderate term -> moderate (low alone gives no tier).
    ``generous``: any high/moderate/low term makes a candidate.
    Adds ``relevance_tier`` (null = not selected) and ``relevance_summary``
    (matched topics). Matching is case-insensitive substring containment.

    Null and empty terms match nothing; a null text matches nothing either.

    One method for any number of terms: they are dealt by a hash to blocks of
    about ``AUTOMATON_BYTES`` of text, and a task finds all terms of a block in one pass
    over each text with an Aho-Corasick automaton, which workers build once. Texts stay
    where they are: no shuffle and no copy of them, however many terms there are.
    The criteria are read once and written to the checkpoint directory.
    """
    terms = cut_lineage(criteria.filter(F.length("term") > 0).select(F.lower("term").alias("term"), "tier", "topic").distinct())
    size = terms.agg(F.sum(F.octet_length("term") + F.lit(16))).first()[0] or 0
    blocks = -(-size // AUTOMATON_BYTES)
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    dealt = (terms.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k).collect() for k in range(blocks))
    hits = [_found(rows)(text) for rows in dealt if rows]
    found = F.array_distinct(F.flatten(F.array(*hits))) if hits else F.array().cast(HITS)
    return (papers.withColumn("_hits", found)
             .withColumn("relevance_tier", _tier_from(F.transform("_hits", lambda t: t["tier"]), mode))
             .withColumn("relevance_summary", _summary(F.transform(
                 F.filter("_hits", lambda t: t["tier"] != "exclude"), lambda t: t["topic"])))
             .drop("_hits"))


HITS = "array<struct<tier:string,topic:string>>"
_AUTOMATA: dict = {}  # of this worker, by block


def _found(rows: list) -> Callable[[Column], Column]:
    """The distinct (tier, topic) of the terms that occur in a text. Marked
    non-deterministic so that a filter on the result does not search the texts again."""
    verdicts = sorted({(r["tier"] or "", r["topic"] or "", r["tier"] is None, r["topic"] is None) for r in rows})
    number = {v: i for i, v in enumerate(verdicts)}
    block: dict[str, list[int]] = {}
    for r in rows:
        block.setdefault(r["term"], []).append(number[(r["tier"] or "", r["topic"] or "", r["tier"] is None, r["topic"] is None)])
    names = [{"tier": None if no_tier else tier, "topic": None if no_topic else topic} for tier, topic, no_tier, no_topic in verdicts]
    key = uuid.uuid4().hex

    def search(texts: pd.Series) -> pd.Series:
        if key not in _AUTOMATA:
            import ahocorasick
            made = ahocorasick.Automaton()
            for term, at in block.items():
                made.add_word(term, tuple(at))
            made.make_automaton()
            while len(_AUTOMATA) >= 8:
                _AUTOMATA.pop(next(iter(_AUTOMATA)))
            _AUTOMATA[key] = made
        find = _AUTOMATA[key].iter
        return pd.Series([[names[i] for i in sorted({i for at in {at for _, at in find(t)} for i in at})] for t in texts])

    return F.pandas_udf(search, HITS).asNondeterministic()


# ---------------------------------------------------------------------------
# Candidate selection (JN-01/02/11) and the two stages (CP-03/04/05)
# ---------------------------------------------------------------------------
def select_candidates(papers: DataFrame, ids: DataFrame) -> DataFrame:
    """JN-01: papers whose id is a candidate (left-semi: duplicates never multiply)."""
    return papers.join(ids.select("paper_id"), "paper_id", "left_semi")


def unknown_candidates(ids: DataFrame, papers: DataFrame) -> DataFrame:
    """JN-02 / ST-03: distinct candidate ids that match no paper."""
    return ids.select("paper_id").distinct().join(papers.select("paper_id"), "paper_id", "left_anti")


def judged_to_papers(judged: DataFrame, papers: DataFrame) -> DataFrame:
    """JN-11: take only id / tier / summary from a judge and join the content
    back, so a judge can never alter paper content. Of several verdicts on
    one id the first in (tier, summary) order counts, so copies of an id never multiply."""
    verdict = (judged.groupBy("paper_id").agg(F.min(F.struct("relevance_tier", "relevance_summary")).alias("_v"))
               .select("paper_id", "_v.*"))
    return papers.drop("relevance_tier", "relevance_summary").join(verdict, "paper_id")


def stage1_candidates(papers: DataFrame, criteria: DataFrame, run_date=None) -> DataFrame:
    """CP-03: generous title-only pass -> candidate ids (``paper_id``)."""
    cols = title_scan_columns(papers)
    if run_date is not None:
        cols = exclude_revisions(cols, run_date)
    judged = judge_by_terms(cols, criteria, "title", "generous")
    return judged.filter(F.col("relevance_tier").isNotNull()).select("paper_id")


def stage2_filter(papers: DataFrame, ids: DataFrame, criteria: DataFrame) -> DataFrame:
    """CP-04: strict abstract pass over the candidates -> judged papers. Every row has the verdict on its own abstract."""
    judged = judge_by_terms(select_candidates(papers, ids), criteria, "abstract", "strict")
    return judged.filter(F.col("relevance_tier").isNotNull())


def triage(papers: DataFrame, criteria: DataFrame, run_date=None) -> DataFrame:
    """CP-05: stage 1 -> stage 2 (upsert is the caller's sink). The term table
    is read while the plan is built; titles are scanned once, and
    so are the candidates' records: the term judge adds its verdict to the row it read."""
    ids = stage1_candidates(papers, criteria, run_date)
    return stage2_filter(papers, ids, criteria)


# ---------------------------------------------------------------------------
# Pluggable scorer (CP-01) with per-batch failure isolation (CP-06)
# ---------------------------------------------------------------------------
JUDGE_OUT = T.StructType([
    T.StructField("batch_id", T.LongType()),
    T.StructField("paper_id", T.StringType()),
    T.StructField("relevance_tier", T.StringType()),
    T.StructField("relevance_summary", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
])


def judge(batches: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame],
          strict: bool = False, by: list[str] | None = None) -> DataFrame:
    """CP-01 + CP-06: run ``scorer`` once per batch inside the executors.

    ``by`` names the columns that :func:`balanced_batches` numbered apart: a
    batch is then one value of these and of ``batch_id``.

    ``scorer(pdf) -> pdf(paper_id, relevance_tier, relevance_summary)``
    receives one batch (at most the batch cap rows). A batch whose scorer
    raises yields one ``status='failed'`` row with the error, unless
    ``strict`` (then the job fails); a batch without a pick yields one ``ok`` row without an id. Tiers outside {high, moderate} are
    rejected downstream by :func:`valid_judgements`.
    """
    by = by or []

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = scored(pdf)
        for i, c in enumerate(by):
            out.insert(i, c, [pdf[c].iloc[0]] * len(out))
        return out

    def scored(pdf: pd.DataFrame) -> pd.DataFrame:
        bid = int(pdf["batch_id"].iloc[0])
        try:
            out = scorer(pdf.drop(columns=["batch_id"]))
            out = pd.DataFrame({
                "batch_id": bid,
                "paper_id": out["paper_id"].astype("string"),
                "relevance_tier": out.get("relevance_tier", pd.Series([None] * len(out))).astype("string"),
                "relevance_summary": out.get("relevance_summary", pd.Series([None] * len(out))).astype("string"),
                "status": "ok", "error": None})
            if not len(out):
                out = pd.DataFrame([{"batch_id": bid, "paper_id": None, "relevance_tier": None,
                                     "relevance_summary": None, "status": "ok", "error": None}])
            return out
        except Exception as e:  # noqa: BLE001 - isolate the batch
            if strict:
                raise
            return pd.DataFrame([{"batch_id": bid, "paper_id": None, "relevance_tier": None,
                                  "relevance_summary": None, "status": "failed",
                                  "error": f"{type(e).__name__}: {e}"}])
    schema = T.StructType([batches.schema[c] for c in by] + JUDGE_OUT.fields)
    return batches.groupBy(*by, "batch_id").applyInPandas(run, schema)


def batch_report(judged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AG-08: per batch ``ok`` + number of papers, or ``FAILED`` + error."""
    return judged.groupBy(*(by or []), "batch_id").agg(
        F.when(F.max(F.col("status") == "failed"), F.lit("FAILED")).otherwise(F.lit("ok")).alias("status"),
        F.count("paper_id").alias("n_papers"),
        F.max("error").alias("error"))


def valid_judgements(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FL-08: (valid, rejected) - id present, tier in {high, moderate} and, in
    stage-2 output (:func:`envelope_papers`), no required field missing.
    The status row of a batch without a pick is neither."""
    judged = judged.filter(~(F.col("paper_id").isNull() & (F.col("status") == "ok"))) if "status" in judged.columns else judged
    ok = F.col("paper_id").isNotNull() & F.col("relevance_tier").isin("high", "moderate")
    if "missing_fields" in judged.columns:
        ok = ok & (F.size("missing_fields") == 0)
    return judged.filter(ok), judged.filter(~ok | ok.isNull())


def tier_report(filtered: DataFrame) -> DataFrame:
    """AG-09: ``[TIER] id — title`` lines (count = number of rows)."""
    return filtered.select("paper_id", F.format_string(
        "[%s] %s — %s", F.upper(F.coalesce("relevance_tier", F.lit("?"))),
        F.coalesce("paper_id", F.lit("?")), F.coalesce("title", F.lit("?"))).alias("line"))


# ---------------------------------------------------------------------------
# Prompts (PR-06/07) and envelopes (SRC-08)
# ---------------------------------------------------------------------------
def prompt_stage1(batches: DataFrame, criteria_text: DataFrame, run_date, by: list[str] | None = None) -> DataFrame:
    """PR-06: one prompt per batch (of each value of ``by``) - criteria, then the batch's title lines in order."""
    keys = [*(by or []), "batch_id"]
    lines = batches.select(*keys, "pos", title_line("paper_id", "title", "published").alias("line"))
    per = lines.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]),
                     "\n").alias("_lines"))
    tail = F.lit(STAGE1_PROMPT_TAIL.split("{prefix}")[0])
    tail2 = F.lit(STAGE1_PROMPT_TAIL.split("{prefix}")[1])
    crit = criteria_text.select("text").scalar()  # one document, attached as a scalar subquery
    return (per.withColumn("_crit", crit)
            .select(*keys, F.concat(F.lit(STAGE1_PROMPT_HEAD), F.col("_crit"), F.lit(STAGE1_PROMPT_PAPERS),
                                         F.col("_lines"), tail, month_prefix(F.lit(run_date)), tail2).alias("prompt")))


def prompt_stage2(batches: DataFrame, criteria_text: DataFrame, by: list[str] | None = None) -> DataFrame:
    """PR-07: criteria first, then the full records of the batch (of each value of ``by``) as a JSON array."""
    keys = [*(by or []), "batch_id"]
    rec = F.struct("pos", F.struct("paper_id", "title", "authors", "abstract", "comment", "categories",
                                   "published", "pdf_url", "abs_url").alias("r"))
    per = batches.groupBy(*keys).agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(rec)), lambda x: x["r"]),
                  {"ignoreNullFields": "false"}).alias("_json"))
    crit = criteria_text.select("text").scalar()
    return (per.withColumn("_crit", crit)
            .select(*keys, F.concat(F.lit(STAGE1_PROMPT_HEAD), F.col("_crit"), F.lit(STAGE2_PROMPT_PAPERS),
                                         F.col("_json"), F.lit(STAGE2_PROMPT_TAIL)).alias("prompt")))


ENVELOPE = T.StructType([
    T.StructField("structured_output", T.StringType()),
    T.StructField("result", T.StringType()),
])


def parse_envelopes(raw: DataFrame, stage: int = 1) -> DataFrame:
    """SRC-08: (batch_id, status, payload) from (batch_id, exit_code, stdout).

    status: nonzero_exit | empty | bad_json | missing_result | ok. The
    structured output is preferred over the plain result.
    """
    out = raw.withColumn("_env", F.from_json("stdout", ENVELOPE, {"mode": "PERMISSIVE"}))
    valid_json = F.get_json_object(F.col("stdout"), "$").isNotNull()
    payload = F.coalesce(F.col("_env.structured_output"), F.col("_env.result"))
    status = (F.when(F.col("exit_code") != 0, F.lit("nonzero_exit"))
               .when(F.trim(F.coalesce("stdout", F.lit(""))) == "", F.lit("empty"))
               .when(~valid_json, F.lit("bad_json"))
               .when(payload.isNull(), F.lit("missing_result"))
               .otherwise(F.lit("ok")))
    return out.select("batch_id", status.alias("status"),
                      F.when(status == "ok", payload).alias("payload")).drop("_env")


def envelope_candidates(envelopes: DataFrame) -> DataFrame:
    """Stage-1 payloads -> (batch_id, pos, paper_id) candidate rows."""
    ok = envelopes.filter(F.col("status") == "ok")
    parsed = ok.select("batch_id", F.from_json("payload", STAGE1_OUTPUT).alias("o"))
    return parsed.select("batch_id", F.posexplode("o.candidate_ids").alias("pos", "paper_id"))


def envelope_papers(envelopes: DataFrame) -> DataFrame:
    """Stage-2 payloads -> one row per returned paper with ``missing_fields``."""
    ok = envelopes.filter(F.col("status") == "ok")
    parsed = ok.select("batch_id", F.from_json("payload", STAGE2_OUTPUT).alias("o"))
    rows = parsed.select("batch_id", F.posexplode("o.papers").alias("pos", "p")).select("batch_id", "pos", "p.*")
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in STAGE2_REQUIRED]),
                       lambda x: x.isNotNull())
    return rows.withColumn("missing_fields", missing).withColumnRenamed("arxiv_id", "paper_id")


def stage2_envelope_json(papers: Column) -> Column:
    """Render a stage-2 envelope from an array of paper records."""
    return F.to_json(F.struct(F.struct(papers.alias("papers")).alias("structured_output")))


def stage1_envelope_json(ids: Column) -> Column:
    """Render a stage-1 envelope (used by tests and fixtures)."""
    return F.to_json(F.struct(F.struct(ids.alias("candidate_ids")).alias("structured_output")))


