"""Byte-level BPE by prefix dynamic programming.

Every byte prefix of a piece has exactly one valid last token: the token that
ends the encoding of that prefix. A token ``t`` that ends at ``i`` is it when the
last token at ``i - len(t)`` may stand before ``t``, that is when the bytes of
the two merge back into just these two. Only the length of the last token is
stored per prefix, so appending bytes never changes what is stored, and
an edit needs new entries only until the old ones recur.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_or_empty
from .registry import register
from .tokens import Encoder, slices

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PAIRS = 400_000  # neighbours whose verdict a worker remembers
_ONE = (1,)


class Vocabulary:
    """Ranks of byte strings, and which tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.decimal = {rank: str(rank) for rank in ranks.values()}
        self.longest = max(map(len, ranks))
        ends: dict[bytes, set[int]] = {}
        for token in ranks:
            ends.setdefault(token[-2:], {1}).add(len(token))
        #: lengths of the tokens that end in two given bytes, longest first
        self.ends = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """Plain merging, lowest rank first and leftmost of equals; for the few bytes of two tokens."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranked = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not ranked:
                break
            i = min(ranked)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def neighbours(self, left: bytes, right: bytes) -> bool:
        """Whether the encoding of the two tokens' bytes is the two tokens (with an empty left: the one)."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.merged(left + right) == ([left, right] if left else [right])
            self.pairs[left, right] = known
        return known


class PrefixEncoder:
    """The encoding of a growing piece of bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data = vocabulary, data
        self.last = [0]  # length of the last token of each prefix
        self._fill(len(data))

    def _fill(self, upto: int) -> None:
        """Stores the last token of each prefix up to ``upto`` bytes."""
        data, last, v = self.data, self.last, self.vocabulary
        ranks, pairs, ends = v.ranks, v.pairs, v.ends
        for i in range(len(last), upto + 1):
            for n in ends.get(data[i - 2:i], _ONE) if i > 1 else _ONE:
                j = i - n
                if j >= 0 and (token := data[j:i]) in ranks:
                    left = data[j - last[j]:j]
                    ok = pairs.get((left, token))
                    if ok or ok is None and v.neighbours(left, token):
                        last.append(n)
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def append(self, more: bytes) -> None:
        """Adds bytes at the end; nothing stored changes."""
        self.data += more
        self._fill(len(self.data))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Puts ``new`` for the bytes ``start`` to ``stop``; returns how many prefixes were encoded again.
        Entries after the edit are kept once as many in a row as the longest token agree with the old ones."""
        tail, shift = self.last[stop + 1:], start + len(new) - stop
        self.data = self.data[:start] + new + self.data[stop:]
        del self.last[start + 1:]
        self._fill(start + len(new))
        again, agreed = len(new), 0
        while len(self.last) <= len(self.data):
            k = len(self.last) - 1 - shift - stop  # place in the old tail
            if agreed >= self.vocabulary.longest:
                self.last += tail[k:]
                break
            self._fill(len(self.last))
            agreed = agreed + 1 if self.last[-1] == tail[k] else 0
            again += 1
        return again

    def tokens(self) -> list[bytes]:
        out, i = [], len(self.data)
        while i:
            out.append(self.data[i - self.last[i]:i])
            i -= self.last[i]
        return out[::-1]

    def ids(self) -> list[int]:
        """As the usual library: bytes that are one token as a whole are that token."""
        if self.data in self.vocabulary.ranks:
            return [self.vocabulary.ranks[self.data]]
        return [self.vocabulary.ranks[t] for t in self.tokens()]


@lru_cache(maxsize=2)
def load_vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


@lru_cache(maxsize=2)
def text_encoder(path: str, pattern: str) -> Encoder:
    """Encodes each match of ``pattern`` separately."""
    import regex

    vocabulary, split = load_vocabulary(path), regex.compile(pattern)

    def ids(match: str) -> list[int]:
        data = match.encode()
        one = vocabulary.ranks.get(data)
        return [one] if one is not None else PrefixEncoder(vocabulary, data).ids()

    def encode(ps: list[str]) -> list[list[int]]:
        return [[x for m in split.findall(p) for x in ids(m)] for p in ps]

    return Encoder(encode)


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str = public_tokenizers.PATTERN,
                 id_col: str = "doc_id", text_col: str = "text",
                 finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str = "ids binary") -> DataFrame:
    """``id_col`` and ids (little-endian unsigned 32-bit integers) of each row's whole text.
    ``finish`` turns each batch (id, ids) into one of id and ``schema`` in the same task. A null text counts as empty and has no ids. Rows are encoded one by one, so repeated
    rows and null ids stay; other columns are not read; an empty table gives no rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(vocabulary, pattern)
        for batch, texts in slices(batches, "text"):
            flat, at = encoder.encode(texts)
            raw, at = flat.astype("<u4").tobytes(), at.tolist()
            ids = pa.array([raw[4 * a:4 * b] for a, b in zip(at, at[1:])], pa.binary())
            made = pa.RecordBatch.from_arrays([batch.column("id"), ids], names=["id", "ids"])
            yield finish(made) if finish else made

    one = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return one.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, {schema}").withColumnRenamed("id", id_col)


def decode_ids(vocabulary: str, ids: bytes) -> tuple[list[int], bytes]:
    """The ids as integers, and the bytes that they stand for."""
    import numpy as np

    numbers = np.frombuffer(ids, "<u4").tolist()
    return numbers, b"".join(map(load_vocabulary(vocabulary).tokens.__getitem__, numbers))


def decode_texts(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and data (bytes) of rows made by :func:`encode_texts`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [decode_ids(vocabulary, x)[1] for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(data, pa.binary())], names=["id", "data"])

    one = encoded.select(F.col(id_col).alias("id"), "ids")
    return one.mapInArrow(run, f"id {encoded.schema[id_col].dataType.simpleString()}, data binary").withColumnRenamed("id", id_col)


def _digests(vocabulary: str) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        decimal, rows = load_vocabulary(vocabulary).decimal.__getitem__, []
        for ids in batch.column("ids"):
            numbers, data = decode_ids(vocabulary, ids.as_py())
            rows.append((len(numbers), hashlib.sha256(",".join(map(decimal, numbers)).encode()).hexdigest(), hashlib.sha256(data).hexdigest()))
        n, ids, data = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(data, pa.string())],
                                          names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


@register("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    return encode_texts(documents(spark, sf_dir), path, finish=_digests(path), schema="n_tokens long, ids_sha256 string, decoded_sha256 string")
