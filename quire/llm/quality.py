"""Quality classifier: supervised subword embeddings.

A text is the average of learned vectors of its hashed words and byte n-grams
(n-grams that stay within a word and its borders); a word equal to the one before it
counts as one shared pseudo word. A softmax layer with a bias gives the
class. Vectors and layer are trained by plain numpy stochastic gradient
descent on a bounded sample of labelled rows. As the average is linear,
scoring folds vectors and layer into one number per bucket (``2**BITS`` floats), which is all
that tasks receive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh, table, text_or_empty
from .registry import register

BITS = 17               # buckets of words and n-grams
GRAMS = (3, 4)          # bytes of an n-gram
DIMENSIONS = 16
STEPS = 10_000          # texts shown to the descent, with repeats
RATE = 4.0
SAMPLE_ROWS = 2_000     # labelled rows that are used for training, at most
SLICE_BYTES = 1 << 20
REPEAT = 0              # bucket of a word equal to the one before it

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse mod 2**64, for i < n."""
    step = np.full(n, _BASE, np.uint64)
    back = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    step[0] = back[0] = 1
    return np.cumprod(step), np.cumprod(back)


_POWERS = _powers(1)


def _bucket(codes: np.ndarray) -> np.ndarray:
    mixed = codes * _MIX
    mixed ^= mixed >> np.uint64(29)
    mixed *= _MIX
    return (mixed >> np.uint64(64 - BITS)).astype(np.int32)


def features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words and for each n-gram size: the buckets of all texts in order, and where each text's begin (and the end)."""
    global _POWERS
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    borders = np.cumsum([0, *(len(t) + 1 for t in texts)])  # the space before each text
    if len(_POWERS[0]) < len(data):
        _POWERS = _powers(2 * len(data))
    power, inverse = _POWERS
    blank = data <= 32
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * power[:len(data)])))
    hashes = (sums[ends] - sums[starts]) * inverse[starts]
    first = np.searchsorted(starts, borders)
    buckets = _bucket(hashes)
    same = np.flatnonzero(hashes[1:] == hashes[:-1]) + 1
    buckets[same[~np.isin(same, first)]] = REPEAT
    out = [(buckets, first)]
    wide = data.astype(np.uint64)
    for n in GRAMS:
        if len(data) < n:
            out.append((np.zeros(0, np.int32), np.zeros(len(borders), np.int64)))
            continue
        m = len(data) - n + 1
        code, inside = np.full(m, n, np.uint64), np.ones(m, bool)
        for j in range(n):
            code = (code << np.uint64(8)) | wide[j:j + m]
            if 0 < j < n - 1:
                inside &= ~blank[j:j + m]
        at = np.flatnonzero(inside)
        out.append((_bucket(code[at]), np.searchsorted(at, borders)))
    return out


def counted(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their shares."""
    parts, out = features(texts), []
    for i in range(len(texts)):
        got, n = np.unique(np.concatenate([b[at[i]:at[i + 1]] for b, at in parts]), return_counts=True)
        out.append((got, (n / max(1, n.sum())).astype(np.float32)))
    return out


@dataclass
class Model:
    weights: np.ndarray  # what one occurrence of a bucket adds to the log odds of class 1
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for buckets, at in features(texts):
            sums = np.concatenate((np.zeros(1), np.cumsum(self.weights[buckets], dtype=np.float64)))
            total += sums[at[1:]] - sums[at[:-1]]
            count += np.diff(at)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -50, 50)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], steps: int = STEPS, rate: float = RATE, seed: int = 0) -> Model:
    """Trains on (buckets, shares) per text. Without rows of both labels: every score is the share of label 1 (half without rows)."""
    ones = sum(labels)
    if not 0 < ones < len(labels):
        share = ones / len(labels) if labels else 0.5
        return Model(np.zeros(1 << BITS, np.float32), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BITS, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    done = 0
    while done < steps:
        for i in rng.permutation(len(rows))[:steps - done]:
            buckets, shares = rows[i]
            now = rate * (1 - done / steps)
            done += 1
            mean = shares @ vectors[buckets]
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            grad = -p / p.sum()
            grad[labels[i]] += 1  # of the log likelihood
            back = layer.T @ grad
            layer += now * np.outer(grad, mean)
            bias += now * 0.05 * grad
            vectors[buckets] += now * np.outer(shares, back)
    odds = layer[1] - layer[0]
    return Model(vectors @ odds, float(bias[1] - bias[0]))


def train(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most ``sample_rows`` labelled rows: those whose ids have the smallest hashes.

    Whole texts are reduced to bucket shares where they lie; only those reach
    the driver, at most ``2**BITS`` numbers a row. An id labelled twice counts with
    its larger label; null labels and ids are left out; of repeated rows of an id as many
    as fit within the bound are used. Other columns are not read.
    """
    order = F.xxhash64("id")
    known = (labelled.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
             .dropna().groupBy("id").agg(F.max("label").alias("label")).orderBy(order, "id").limit(sample_rows))
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    chosen = texts.join(F.broadcast(known), "id")  # at most sample_rows labels

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                some = batch.slice(i, 64)
                got = counted([t.encode() for t in some.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [some.column("id"), some.column("label"), pa.array([b.tobytes() for b, _ in got], pa.binary()),
                     pa.array([s.tobytes() for _, s in got], pa.binary())], names=["id", "label", "buckets", "shares"])

    kind = texts.schema["id"].dataType.simpleString()
    rows = (chosen.mapInArrow(reduce, f"id {kind}, label int, buckets binary, shares binary")
            .orderBy(order, "id", "buckets", "shares").limit(sample_rows).collect())
    return fit([(np.frombuffer(r.buckets, np.int32), np.frombuffer(r.shares, np.float32)) for r in rows],
               [int(r.label > 0) for r in rows])


def score(spark: SparkSession, model: Model, text: Column) -> Column:
    """Probability of label 1 for each text; null counts as empty, and the empty text has the prior's score."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            out, part, size = [], [], 0
            for t in texts:
                part.append(t.encode())
                size += len(t)
                if size >= SLICE_BYTES:
                    out.append(sent.value.scores(part))
                    part, size = [], 0
            if part:
                out.append(sent.value.scores(part))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return run(text_or_empty(text))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are kept out of training: crc32 of the id as text, mod 3, is 1 (a null id is not)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    return train(docs, table(spark, sf_dir, "labels").filter(~held_out()))


def reject_low(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the rows that score below one half, columns unchanged."""
    name = fresh("score", docs)
    return docs.withColumn(name, score(spark, trained(spark, docs, sf_dir), F.col("text"))).filter(F.col(name) >= 0.5).drop(name)


@register("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = docs.select("doc_id", held_out().alias("held_out"), score(spark, trained(spark, docs, sf_dir), F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
