"""Fetch-side operators: primary source with a fallback, ordered de-duplication
and the fetch report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_dedupe(df: DataFrame, key: list[str], pos: str, name: str = "pos",
                   count_as: str | None = None) -> DataFrame:
    """WN-03: one row per key at its first position (a partial aggregate)."""
    aggs = [F.min(pos).alias(name)]
    if count_as:
        aggs.append(F.count(F.lit(1)).alias(count_as))
    return df.groupBy(*key).agg(*aggs)


def missing_from_primary(ids: DataFrame, primary: DataFrame) -> DataFrame:
    """JN-03: requested ids the primary source did not return."""
    return ids.join(primary.select("paper_id"), "paper_id", "left_anti")


def union_sources(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """ST-01: append the two sources (disjoint by construction), tagged."""
    return (primary.withColumn("source", F.lit("api"))
            .unionByName(secondary.withColumn("source", F.lit("scrape")), allowMissingColumns=True))


def papers_with_fallback(ids: DataFrame, primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """JN-04: the primary record when there is one, else the fallback record,
    else nothing. An empty primary (outage) simply yields all fallbacks."""
    keys = ids.select("paper_id").distinct()
    prim = primary.join(keys, "paper_id", "left_semi")
    missing = missing_from_primary(keys, prim)
    sec = secondary.join(missing, "paper_id", "left_semi")
    return union_sources(prim, sec)


def fetch_report(ids: DataFrame, fetched: DataFrame) -> DataFrame:
    """AG-11: requested / from primary / from fallback / missing counts."""
    req = ids.select("paper_id").distinct()
    tagged = req.join(fetched.select("paper_id", "source"), "paper_id", "left")
    return tagged.agg(F.count(F.lit(1)).alias("n_ids"),
                      F.count_if(F.col("source") == "api").alias("n_primary"),
                      F.count_if(F.col("source") == "scrape").alias("n_fallback"),
                      F.count_if(F.col("source").isNull()).alias("n_missing"))
