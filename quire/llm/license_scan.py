"""License scans by diagonal voting (DataFrame functions only).

Every rolling word k-gram hash of every text is joined to the template
positions that carry it. A hit at word ``p`` on template position ``t`` votes
for the diagonal ``p - t``. Votes are counted per text, template and diagonal,
neighbouring diagonals (a word inserted or lost) are merged, and a merged span
is verified by the share of the template's k-grams it holds, in order to keep
chance hits out. Base phrases are templates that allow no shift and need every
k-gram, so each of their diagonals is an exact place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import documents, text_or_empty
from .registry import register

# Base phrases with their labels, and notices of well-known licenses.
BASE = [
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
]
NOTICES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE_K, NOTICE_K = 2, 3
MAX_SHIFT = 2        # words inserted or lost between two merged diagonals
MIN_COVERAGE = 0.75  # share of a notice's k-grams that a verified span holds
SENTINEL = 0         # template id of the row that carries a text without hits


def words(text: Column) -> Column:
    """Words of a text, in lower case. ``lower`` also folds letters beyond A-Z,
    which changes neither the number of words nor any match of the templates."""
    return F.filter(F.split(F.lower(text), SEPARATORS, -1), lambda w: w != "")


def _pairs(hashes: Column) -> Column:
    """Rolling hash of neighbours: one element less than ``hashes``."""
    n = F.size(hashes) - 1
    return F.when(n < 1, F.array().cast("array<bigint>")).otherwise(
        F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(2), n), lambda a, b: F.xxhash64(a, b)))


def with_grams(df: DataFrame, words_col: str) -> DataFrame:
    """Adds g2 and g3, the hashes of the 2- and 3-word grams of ``words_col``."""
    return df.withColumn("g2", _pairs(F.col(words_col))).withColumn("g3", _pairs(F.col("g2")))


def template_positions(spark: SparkSession, base=BASE, notices=NOTICES) -> DataFrame:
    """(hash, template, label, exact, t, n_grams): one row per template k-gram.
    The number of rows is that of the words in the fixed lists above."""
    given = [(i + 1, label, phrase, i < len(base)) for i, (label, phrase) in enumerate([*base, *notices])]
    named = spark.createDataFrame(given, "template int, label string, phrase string, exact boolean")
    grams = with_grams(named.withColumn("w", words(F.col("phrase"))), "w")
    grams = grams.withColumn("grams", F.when(F.col("exact"), F.col("g2")).otherwise(F.col("g3")))
    rows = grams.select("template", "label", "exact", F.size("grams").alias("n_grams"), F.posexplode("grams").alias("t", "hash"))
    end = spark.createDataFrame([(SENTINEL, "", False, 1, 0, 0)],
                                "template int, label string, exact boolean, n_grams int, t int, hash bigint")
    return rows.unionByName(end)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, notices=NOTICES,
                 max_shift: int = MAX_SHIFT, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per input row: ``id_col``, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts all places of the base phrases, ``first_word`` and
    ``last_word`` are their smallest and largest start (null without a place).
    ``labels`` adds the labels of verified notices. ``score`` is 1 with a base
    place, else the largest share of a notice found, 0 without one. Null text
    counts as empty and has no words. Rows are scanned one by one, so repeated
    rows and repeated or null ids each give a row; other columns are not read.
    """
    spark = docs.sparkSession
    one = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                      words(text_or_empty(text_col)).alias("w"))
    one = with_grams(one.withColumn("n_words", F.size("w")), "w").drop("w")
    # the sentinel hash 0 stands first, so each text has at least one hit
    hashes = F.concat(F.array(F.lit(0).cast("bigint")), "g2", "g3")
    rolled = one.select("row", "id", "n_words", F.size("g2").alias("n2"), F.posexplode(hashes).alias("p", "hash"))
    hits = rolled.join(F.broadcast(template_positions(spark, base, notices)), "hash")
    # grams of two words stand at 1.., grams of three words after them
    at = F.when(F.col("template") == SENTINEL, 0).when(F.col("exact"), F.col("p") - 1).otherwise(F.col("p") - 1 - F.col("n2"))
    k2 = (F.col("template") != SENTINEL) & (F.col("exact") != (F.col("p") <= F.col("n2")))
    k0 = (F.col("template") == SENTINEL) & (F.col("p") != 0)  # a gram that happens to hash to 0
    hits = hits.filter(~k2 & ~k0).select("row", "id", "n_words", "template", "label", "exact", "n_grams", "t", at.alias("p"))
    votes = (hits.repartition("row")
             .groupBy("row", "id", "n_words", "template", "label", "exact", "n_grams", (F.col("p") - F.col("t")).alias("diagonal"))
             .agg(F.collect_set("t").alias("ts")))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("exact") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > max_shift, F.lit(True))
    merged = (votes.withColumn("apart", apart.cast("int"))
              .withColumn("span", F.sum("apart").over(order))
              .groupBy("row", "id", "n_words", "template", "label", "exact", "n_grams", "span")
              .agg(F.min("diagonal").alias("start"), F.flatten(F.collect_list("ts")).alias("ts")))
    share = F.size(F.array_distinct("ts")) / F.col("n_grams")
    found = merged.withColumn("share", F.when(F.col("template") == SENTINEL, F.lit(0.0)).otherwise(share))
    place = F.col("exact") & (F.col("share") == 1.0)
    notice = ~F.col("exact") & (F.col("share") >= min_coverage)
    labels = lambda rule: F.array_join(F.sort_array(F.collect_set(F.when(rule, F.col("label")))), ",")
    return (found.groupBy("row", "id", "n_words")
            .agg(F.count(F.when(place, 1)).alias("n_base"),
                 F.min(F.when(place, F.col("start"))).cast("long").alias("first_word"),
                 F.max(F.when(place, F.col("start"))).cast("long").alias("last_word"),
                 labels(place).alias("base_labels"), labels(place | notice).alias("labels"),
                 F.max(F.when(place, 1.0).when(F.col("exact"), 0.0).otherwise(F.col("share"))).alias("score"))
            .select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word",
                    "last_word", "base_labels", "labels", "score"))


def oracle_sql(base=BASE, notices=NOTICES) -> str:
    rows = ", ".join(f"({i + 1}, '{label}', '{phrase}', {str(i < len(base)).lower()})"
                     for i, (label, phrase) in enumerate([*base, *notices]))
    return f"""
with tpl as (select * from (values {rows}) v(template, label, phrase, exact)),
tw as (select *, string_split(phrase, ' ') as w from tpl),
tg as (select template, label, exact, len(w) - case when exact then 1 else 2 end as n_grams, i as t,
              array_to_string(w[i + 1:i + case when exact then 2 else 3 end], ' ') as gram
       from (select *, unnest(range(len(w) - case when exact then 1 else 2 end)) as i from tw)),
d as (select row_number() over () as r, doc_id,
             list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w
      from documents),
p as (select r, w, unnest(range(len(w))) as p from d),
g as (select r, p, 2 as k, w[p + 1] || ' ' || w[p + 2] as gram from p where p + 2 <= len(w)
      union all select r, p, 3, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] from p where p + 3 <= len(w)),
hits as (select r, p, t, template, label, exact, n_grams from g join tg on g.gram = tg.gram and g.k = case when tg.exact then 2 else 3 end),
votes as (select r, template, label, exact, n_grams, p - t as diagonal, list(distinct t) as ts from hits group by all),
marks as (select *, case when exact or coalesce(diagonal - lag(diagonal) over (partition by r, template order by diagonal) > {MAX_SHIFT}, true)
                    then 1 else 0 end as apart from votes),
spans as (select *, sum(apart) over (partition by r, template order by diagonal) as span from marks),
merged as (select r, template, label, exact, n_grams, span, min(diagonal) as start,
                  len(list_distinct(flatten(list(ts)))) / n_grams as share from spans
           group by r, template, label, exact, n_grams, span),
f as (select *, exact and share = 1 as place, not exact and share >= {MIN_COVERAGE} as notice from merged),
a as (select r, count(*) filter (where place) as n_base, min(start) filter (where place) as first_word,
             max(start) filter (where place) as last_word,
             string_agg(distinct label, ',' order by label) filter (where place) as base_labels,
             string_agg(distinct label, ',' order by label) filter (where place or notice) as labels,
             max(case when place then 1.0 when exact then 0.0 else share end) as score
      from f group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, cast(first_word as bigint) as first_word,
       cast(last_word as bigint) as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
       cast(coalesce(score, 0) as double) as score
from d left join a using (r)
"""


@register("op9_license_scan", oracle_sql())
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
