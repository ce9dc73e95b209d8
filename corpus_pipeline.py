"""The corpus pipeline: quality, exact copies, near copies, repeated passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as
Parquet and read again as the next stage's ``docs``. All but the last return the columns of ``documents``.
Counted as part of the ``quire.llm`` subpackage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import exact_dedup, near_dedup, packing, quality, suffix_dedup
from quire.llm.common import documents, written


PASSAGE_BYTES = 200  # passages of fifty words are longer than this in the languages of the corpus; op3 has 400 by contract


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled rows, does not reject."""
    return quality.reject_low(spark, docs, sf_dir)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by sets of five-word shingles, that with the smallest id."""
    return near_dedup.drop_near_copies(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings of ``PASSAGE_BYTES`` that occur elsewhere; n_chars follows the text."""
    return suffix_dedup.cut_repeats(docs, length=PASSAGE_BYTES).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path(packing.VOCABULARY))


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("suffix_dedup", without_repeats),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


# A trained classifier and a tokenizer are not expressible in SQL; tests compare with plain Python.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
