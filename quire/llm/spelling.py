"""Spelling variants by reduced-alphabet generation.

Letters are hashed to a few symbols, so that many words share a reduced word and a
reduced word has a small one-edit neighbourhood. Two words one edit apart have reduced
words that are equal or one edit apart. Each reduced word generates the part of its neighbourhood
that comes before it in order of (length, symbols), so that each pair of reduced words is
found once, from the later one; variants are joined with the reduced vocabulary,
pairs of classes are expanded to words, and the edit is verified on the words themselves.

Reduced words travel as 64-bit polynomial hashes. A collision only adds a candidate.
Pairs of classes with more than ``MAX_PAIRS`` candidates, and words of ``LONG`` code points or more, whose
neighbourhoods would be long, are matched exactly by the hashes of the words with one code point
left out: linear in their length, and a hash belongs to few words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_or_empty, written
from .registry import register

SYMBOLS = 6          # of the reduced alphabet
LONG = 64            # from this length on, words are matched by the exact way alone
MAX_PAIRS = 4096     # candidates of a pair of classes
MIN_LENGTH = 7
MIN_COUNT = 2
NOISE = 31           # a run is altered if this divides its checksum
RATIO = 10           # a form occurs at least so many times as often

_BASE = 0x9E3779B97F4A7C15          # odd, so that it has an inverse modulo 2**64
_LETTER_HASH = 0xC9BC10CD           # deals the common letters about evenly
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


def symbols_of(points: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """The symbols, from 1, that code points are dealt to by a multiplicative hash."""
    return ((points.astype(np.uint64) * np.uint64(_LETTER_HASH) & np.uint64(0xFFFFFFFF)) >> np.uint64(16)) % np.uint64(symbols) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    steps = np.full(n + 1, _BASE, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _codes(rows: np.ndarray) -> np.ndarray:
    """Polynomial hashes of equally long rows of code numbers (0 is no code)."""
    with np.errstate(over="ignore"):
        return (rows * _powers(rows.shape[1])[:-1]).sum(1, dtype=np.uint64)


def _cuts(rows: np.ndarray) -> np.ndarray:
    """Hashes of each row with the code at each place left out."""
    with np.errstate(over="ignore"):
        terms = rows * _powers(rows.shape[1])[:-1]
        before = np.cumsum(terms, 1, dtype=np.uint64) - terms
        after = terms.sum(1, dtype=np.uint64)[:, None] - before - terms
        return before + after * _INVERSE


def _last_of_run(rows: np.ndarray) -> np.ndarray:
    """Where leaving out a code gives a new string: at the last of equal codes."""
    keep = np.ones(rows.shape, bool)
    keep[:, :-1] = rows[:, :-1] != rows[:, 1:]
    return keep


def earlier_neighbours(rows: np.ndarray, symbols: int = SYMBOLS) -> tuple[np.ndarray, np.ndarray]:
    """Of equally long reduced words (codes from 1): (row, hash) of each different string one deletion away or one
    replacement by a smaller symbol away, and of the word itself. Insertions and replacements by greater symbols are the same pairs
    seen from the other word."""
    own = _codes(rows)
    at, hashes = [np.arange(len(rows))], [own]
    r, i = np.nonzero(_last_of_run(rows))
    at.append(r)
    hashes.append(_cuts(rows)[r, i])
    powers = _powers(rows.shape[1])
    with np.errstate(over="ignore"):
        for smaller in range(1, symbols):
            r, i = np.nonzero(rows > smaller)
            at.append(r)
            hashes.append(own[r] - (rows[r, i] - np.uint64(smaller)) * powers[i])
    return np.concatenate(at), np.concatenate(hashes)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix of code points) of the words of each length."""
    lengths = np.array([len(w) for w in words], np.int64)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for part in np.array_split(at, max(1, len(at) * int(n) // 500_000)):
            codes = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le"), np.uint32)
            yield part, codes.reshape(len(part), n)


def _reduce(symbols: int):
    """Two columns more: the reduced word in digits from 1 and its hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, reduced = np.zeros(batch.num_rows, np.uint64), np.empty(batch.num_rows, object)
            for at, rows in _by_length(batch.column("word").to_pylist()):
                rows = symbols_of(rows, symbols)
                codes[at] = _codes(rows)
                reduced[at] = (rows.astype(np.uint8) + np.uint8(ord("0"))).view(f"S{rows.shape[1]}").ravel().astype(str)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reduced, pa.string()), pa.array(codes.view(np.int64))],
                                             names=[*batch.schema.names, "reduced", "code"])
    return run


def _variants(symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, size = (batch.column(c).to_numpy() for c in ("code", "size"))
            for at, rows in _by_length(batch.column("reduced").to_pylist()):
                rows = rows.astype(np.uint64) - np.uint64(ord("0"))
                r, hashes = earlier_neighbours(rows, symbols)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(code[at[r]]), pa.array(size[at[r]])],
                                                 names=["variant", "code", "size"])
    return run


def _left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, key, node): of each word the hash of what is left without the code point at a place (kind 0: with the
    place, equal if a code point there was replaced; kind 1: without it) and that of the whole word (kind 2)."""
    for batch in batches:
        node = batch.column("node").to_numpy()
        for at, rows in _by_length(batch.column("word").to_pylist()):
            rows = rows.astype(np.uint64)
            cuts, keep = _cuts(rows), np.nonzero(_last_of_run(rows))
            places = np.arange(1, rows.shape[1] + 1, dtype=np.uint64)
            with np.errstate(over="ignore"):
                placed = (cuts ^ (cuts >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + places * np.uint64(0x94D049BB133111EB)
            for kind, keys, nodes in ((0, placed.ravel(), np.repeat(node[at], rows.shape[1])), (1, cuts[keep], node[at][keep[0]]),
                                      (2, _codes(rows), node[at])):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys.view(np.int64)), pa.array(nodes)],
                                                 names=["kind", "key", "node"])


def noisy_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word): each maximal run of letters of at least ``MIN_LENGTH``, A-Z lower-cased; where ``NOISE`` divides the checksum h of ``<id>:<run>`` without
    its code point at h % length. Null ids count as empty."""
    runs = F.regexp_extract_all(text_or_empty(text_col), F.lit("([A-Za-zÀ-ÿ]{%d,})" % MIN_LENGTH), 1)
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    run = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(runs).alias("r")) \
        .select("i", F.translate("r", upper, upper.lower()).alias("r"))
    h = run.select("r", F.crc32(F.concat("i", F.lit(":"), "r").cast("binary")).alias("h"))
    place = (F.col("h") % F.length("r")).cast("int")
    cut = F.concat(F.substring("r", F.lit(1), place), F.substring("r", place + 2, F.length("r")))
    return h.select(F.when(F.col("h") % NOISE == 0, cut).otherwise(F.col("r")).alias("word"))


def vocabulary(words: DataFrame) -> DataFrame:
    """(word, n): the words of at least ``MIN_LENGTH`` code points that occur at least ``MIN_COUNT`` times. Counts are combined before the shuffle."""
    return (words.filter(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= MIN_COUNT))


def _one_edit(a: str | Column, b: str | Column) -> Column:
    return F.levenshtein(F.col(a), F.col(b), 1) == 1


def near_words(words: DataFrame, symbols: int = SYMBOLS, long: int = LONG, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """(a, an, b, bn): each pair of words of the table (node, word, n) that are one insertion, deletion or replacement apart, once."""
    short = words.filter(F.length("word") <= long).select("node", "word", "n")
    coded = written(short.mapInArrow(_reduce(symbols), "node long, word string, n long, reduced string, code long"), "reduced")
    classes = coded.groupBy("reduced", "code").agg(F.count(F.lit(1)).alias("size"))
    variants = classes.mapInArrow(_variants(symbols), "variant long, code long, size long")
    other = classes.groupBy(F.col("code").alias("variant")).agg(F.sum("size").alias("size2"))
    pairs = written(variants.join(other, "variant").select("code", "size", F.col("variant").alias("code2"), "size2")
                    .filter((F.col("code") != F.col("code2")) | (F.col("size2") > 1)), "class-pairs")
    small = F.col("size") * F.col("size2") <= max_pairs
    side = lambda x, c: coded.select(F.col("code").alias(c), F.col("word").alias(x), F.col("n").alias(f"{x}n"))
    met = (pairs.filter(small).select("code", "code2").join(side("a", "code"), "code").join(side("b", "code2"), "code2")
           .filter((F.col("code") != F.col("code2")) | (F.col("a") < F.col("b"))).filter(_one_edit("a", "b")))
    hot = pairs.filter(~small)
    hot = hot.select("code").union(hot.select("code2")).distinct()
    rest = coded.join(hot, "code", "left_semi").select("node", "word", "n").union(
        words.filter(F.length("word") >= long).select("node", "word", "n")).dropDuplicates(["node"])
    rest = written(rest, "rest-words")
    if not rest.isEmpty():
        keys = rest.select("node", "word").mapInArrow(_left_out, "kind byte, key long, node long")
        keyed = lambda k, c: keys.filter(F.col("kind") == k).select("key", F.col("node").alias(c))
        replaced = keyed(0, "x").join(keyed(0, "y"), "key").filter("x < y").select("x", "y")
        longer = keyed(1, "x").join(keyed(2, "y"), "key").select("x", "y")
        named = lambda x, c: rest.select(F.col("node").alias(c), F.col("word").alias(x), F.col("n").alias(f"{x}n"))
        exact = (replaced.union(longer).distinct().join(named("a", "x"), "x").join(named("b", "y"), "y").filter(_one_edit("a", "b")))
        met = met.select("a", "an", "b", "bn").union(exact.select("a", "an", "b", "bn"))
    first = F.col("a") < F.col("b")
    ends = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
    return met.select(ends("a", "b").alias("a"), ends("an", "bn").alias("an"), ends("b", "a").alias("b"), ends("bn", "an").alias("bn")).distinct()


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of the table (word, form), form not null: where following forms ends. Each round doubles the
    steps taken; the counts of a chain grow tenfold by step, so the rounds are few."""
    roots = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(roots.join(step, "root", "left").select("word", "root", "next"), "roots")
        if moved.filter("next is not null").isEmpty():
            return roots
        roots = moved.select("word", F.coalesce("next", "root").alias("root"))


def spelling_variants(words: DataFrame, ratio: int = RATIO, symbols: int = SYMBOLS, long: int = LONG, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """One row per word of the vocabulary (word, n): word, form, root (strings), n, n_near, form_n (longs).

    Words are near if one inserted, deleted or replaced code point turns one into the other. ``form`` is the near word of
    largest n (ties: smallest in code-point order) if its n is at least ``ratio`` times the word's, else null;
    ``root`` is where following forms ends, the word itself if it has none. ``n_near`` counts near words.
    Words may hold any code points. Null and empty words are left out; repeated rows of a word count together. Other columns are not
    read, an empty table gives no rows.
    """
    held = (words.filter("word is not null and word <> ''").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
            .select(F.monotonically_increasing_id().alias("node"), "word", "n"))
    held = written(held, "words")
    near = near_words(held, symbols, long, max_pairs)
    ways = near.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("bn").alias("m")).union(near.select("b", "a", "an"))
    best = ways.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("k"), F.col("near").alias("w"))).alias("top"))
    rows = held.join(best, "word", "left")
    is_form = -F.col("top.k") >= F.lit(ratio) * F.col("n")
    rows = written(rows.select("word", F.when(is_form, F.col("top.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                               F.when(is_form, -F.col("top.k")).alias("form_n")), "forms")
    roots = last_forms(rows.filter("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@register("op11_spelling_variants")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(vocabulary(noisy_runs(documents(spark, sf_dir))))
