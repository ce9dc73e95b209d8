"""Removal of long repeated byte strings by a sparse enhanced suffix array.

1. *Anchors.* In every stretch of ``length`` bytes the least hash of its grams marks
   an anchor, so equal stretches share an anchor at the same place. Only
   suffixes (and reversed prefixes) at anchors are looked at: about two
   of a hundred bytes.
2. *Filter.* Anchors whose gram occurs once go. Occurrences whose whole context
   (what any string of ``length`` bytes over the anchor can reach) is equal are one class;
   a class of two or more is repeated as far as its context goes, and one
   representative stands for it from here on.
3. *Interval tree.* Per gram, the right contexts of the classes are sorted into a
   suffix array with its common prefixes, and a stack scan lists the
   common-prefix intervals. An interval of depth ``d`` whose members differ to the left is
   a maximal repeat group of all its occurrences; the neighbours of a member
   among the sorted left contexts of the interval give its longest left extension ``e``, and
   ``d + e >= length`` makes the member's bytes repeated from ``e`` before to ``d`` after the anchor.
4. *Spans* of all occurrences are gathered per document and cut out.

Large groups: a valid pair of occurrences agrees in at least 3/4 of ``length`` to the right
or more than 1/4 to the left, so a large group falls apart by either; what
is still larger than ``max_group`` is decided by counting the hashes of its strings of
``length`` bytes in an ordinary aggregation, without a group in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rolling
from .common import cut_lineage, documents, fresh, text_or_empty
from .registry import register

LENGTH = 400        # bytes of the shortest string that counts as repeated
SPLIT_GROUP = 256   # classes of one gram that are split by context
MAX_GROUP = 16384   # classes that one suffix array holds at most


# ---- one suffix array -------------------------------------------------------

def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of each common-prefix interval, children before parents.
    ``lcp[i]``: common prefix of entries i - 1 and i; ``lcp[0]`` is not used."""
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        depth, first = lcp[i] if i < len(lcp) else 0, i - 1
        while stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i - 1
        if stack[-1][0] < depth:
            stack.append((depth, first))


def _suffix_array(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Their order, and the common prefix of each with the one before it (0 for the first)."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    return order, [0, *(common(strings[a], strings[b]) for a, b in zip(order, order[1:]))]


def maximal_repeats(lefts: list[bytes], rights: list[bytes], least: int = 1) -> Iterator[tuple[int, list[int], list[int]]]:
    """(depth, members, left extensions) of each common-prefix interval of at least ``least`` bytes.

    ``rights`` are suffixes from the anchor, ``lefts`` the bytes before it, backwards. The
    members are all occurrences; an extension is the longest left string a
    member shares with another one. An interval whose members all have the same byte before
    them is no maximal repeat: then every extension is at least 1.
    """
    order, lcp = _suffix_array(rights)
    rank = {i: k for k, i in enumerate(_suffix_array(lefts)[0])}
    for depth, first, last in intervals(lcp):
        if depth >= least:
            members = sorted(order[first:last + 1], key=rank.__getitem__)
            shared = [0, *(common(lefts[a], lefts[b]) for a, b in zip(members, members[1:])), 0]
            yield depth, members, [max(a, b) for a, b in zip(shared, shared[1:])]


def extents(lefts: list[bytes], rights: list[bytes], length: int, gram: int) -> list[tuple[int, int]]:
    """Per occurrence how far the bytes around its anchor are repeated, to the left and right; (0, 0) if not at all.

    Intervals come deepest first, so the first one that suffices gives an
    occurrence its right end; it is open until its left end is as far as any other occurrence allows.
    """
    out = [(0, 0)] * len(lefts)
    if len(lefts) <= 16:
        pair = len(lefts) == 2
        found = [(common(*rights), [0, 1], [common(*lefts)] * 2)] if pair else maximal_repeats(lefts, rights, gram)
        for depth, members, extensions in found:
            for i, e in zip(members, extensions):
                if e + depth >= length:
                    out[i] = max(out[i][0], e), max(out[i][1], depth)
        return out
    order, lcp = _suffix_array(rights)
    by_left, shared = _suffix_array(lefts)
    rank = np.empty(len(lefts), np.int64)
    rank[by_left] = np.arange(len(lefts))
    farthest = [max(a, b) for a, b in zip(shared, [*shared[1:], 0])]  # by left rank
    deepest = [max(a, b) for a, b in zip(lcp, [*lcp[1:], 0])]         # by place in the suffix array
    ranks = rank[order]
    still = np.array([farthest[k] + d >= length for k, d in zip(ranks.tolist(), deepest)])
    for depth, first, last in intervals(lcp):
        if depth < gram or not (places := np.flatnonzero(still[first:last + 1])).size:
            continue
        inside = np.sort(ranks[first:last + 1])
        for place, k in zip((places + first).tolist(), np.searchsorted(inside, ranks[places + first]).tolist()):
            i = order[place]
            e = max(common(lefts[i], lefts[by_left[inside[j]]]) for j in (k - 1, k + 1) if 0 <= j < len(inside))
            if e + depth >= length:
                out[i] = max(out[i][0], e), max(out[i][1], depth)
                still[place] = out[i][0] < farthest[inside[k]]
    return out


# ---- the distributed operator ----------------------------------------------

def _doc_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text): equal ids with equal texts are one document's copies, which share their result."""
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("h", F.xxhash64("text"))


def _anchor_rows(length: int, gram: int) -> Callable:
    left = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                some = batch.slice(begin, 256)
                keys, contexts, places, rows = [], [], [], []
                for i, text in enumerate(some.column("text")):
                    data = np.frombuffer(text.as_py().encode(), np.uint8)
                    if len(data) < length:
                        continue
                    pos, key, sums = rolling.anchors(data, gram, length - gram + 1)
                    lo, hi = np.maximum(pos - left, 0), np.minimum(pos + length, len(data))
                    shape = ((pos - lo) * (length + 1) + (hi - pos)).astype(np.uint64)
                    keys.append(key)
                    contexts.append(rolling.mix(rolling.spans_hash(sums, lo, hi) ^ rolling.mix(shape)))
                    places.append(pos)
                    rows.append(np.full(len(pos), i))
                if not keys:
                    continue
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(contexts).view(np.int64)),
                     some.column("id").take(at), some.column("h").take(at), pa.array(np.concatenate(places).astype(np.int32))],
                    names=["key", "ctx", "id", "h", "pos"])
    return run


def _packed(texts: DataFrame, kind: str) -> DataFrame:
    """(id, h, z): texts compressed, since they are shuffled next."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = pa.array([press.compress(t.as_py().encode()) for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), z], names=["id", "h", "z"])
    return texts.mapInArrow(run, f"id {kind}, h long, z binary")


def _context_rows(length: int, gram: int) -> Callable:
    """The context bytes of each listed anchor of a document."""
    left = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        press = zstandard.ZstdDecompressor()
        names = ["key", "ctx", "n_ctx", "left", "right"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            out = []
            for z, spots in zip(batch.column("z"), batch.column("spots")):
                data = press.decompress(z.as_py())
                for s in spots.as_py():
                    p = s["pos"]
                    out.append((s["key"], s["ctx"], s["n_ctx"], data[max(0, p - left):p][::-1], data[p:p + length]))
                    if len(out) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*out)), kinds)], names=names)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*out)), kinds)], names=names)
    return run


def _scan_groups(length: int, gram: int) -> Callable:
    """Rows sorted by group: one suffix array for each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(groups):
            key, ctx, e, d = [], [], [], []
            for rows in groups:
                for (k, c, _, _), (x, y) in zip(rows, extents([r[2] for r in rows], [r[3] for r in rows], length, gram)):
                    if y:
                        key.append(k), ctx.append(c), e.append(x), d.append(y)
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(ctx, pa.int64()), pa.array(e, pa.int32()), pa.array(d, pa.int32())],
                                              names=["key", "ctx", "l", "r"])
        now, rows = None, []
        for batch in batches:
            done = []
            for g, *row in zip(*(batch.column(c).to_pylist() for c in ("gid", "key", "ctx", "left", "right"))):
                if g != now:
                    if len(rows) > 1:
                        done.append(rows)
                    now, rows = g, []
                rows.append(row)
            yield result(done)
        yield result([rows] if len(rows) > 1 else [])
    return run


def _string_rows(length: int) -> Callable:
    """Of each context the hash of every string of ``length`` bytes over its anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, ctx, left, right in zip(*(batch.column(c).to_pylist() for c in ("key", "ctx", "left", "right"))):
                data = np.frombuffer(left[::-1] + right, np.uint8)
                at = np.arange(max(0, len(data) - length + 1))
                h = rolling.mix(rolling.spans_hash(rolling.prefix_sums(data), at, at + length)).view(np.int64)
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), pa.array(np.full(n, ctx)),
                                                  pa.array((len(left) - at).astype(np.int32)), pa.array(h)], names=["key", "ctx", "back", "s"])
    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   split_group: int = SPLIT_GROUP, max_group: int = MAX_GROUP) -> DataFrame:
    """(id, h, spans) of the rows that hold a repeated string: ``spans`` are byte
    ranges (start, stop), unmerged, that cover exactly the bytes of the strings of ``length``
    bytes that also start anywhere else, in the same text or another one."""
    gram = length // 2
    kind = docs.schema[id_col].dataType.simpleString()
    rows = _doc_rows(docs, id_col, text_col)
    found = rows.mapInArrow(_anchor_rows(length, gram), f"key long, ctx long, id {kind}, h long, pos int")
    often = found.groupBy("key").count().filter("count > 1").select("key")
    found = cut_lineage(found.join(often, "key"))

    classes = found.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "h", "pos")).alias("at"))
    per_key = classes.groupBy("key").agg(F.count(F.lit(1)).alias("n_ctx"), F.count_if(F.col("n") == 1).alias("single"))
    classes = cut_lineage(classes.join(per_key, "key").select("key", "ctx", "n", "n_ctx", "single", "at.*"))

    # classes of grams with several contexts, unless all are repeated as a whole already
    spots = (classes.filter("n_ctx > 1 and single > 0").groupBy("id", "h")
             .agg(F.collect_list(F.struct("key", "ctx", "n_ctx", "pos")).alias("spots")))
    texts = _packed(rows, kind)
    met = texts.join(spots, texts["id"].eqNullSafe(spots["id"]) & (texts["h"] == spots["h"])).select("z", "spots")
    contexts = met.mapInArrow(_context_rows(length, gram), "key long, ctx long, n_ctx long, left binary, right binary")

    far, near = length - length // 4, length // 4 + 1
    parts = F.when(F.col("n_ctx") <= split_group, F.array(F.col("key"))).otherwise(F.array_compact(F.array(
        F.when(F.length("right") >= far, F.xxhash64(F.lit("r"), "key", F.substring("right", 1, far))),
        F.when(F.length("left") >= near, F.xxhash64(F.lit("l"), "key", F.substring("left", 1, near))))))
    grouped = cut_lineage(contexts.select("key", "ctx", "left", "right", F.explode(parts).alias("gid")))
    sizes = grouped.groupBy("gid").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    sized = grouped.join(sizes, "gid")
    scanned = (sized.filter(F.col("size") <= max_group).drop("size").repartition("gid").sortWithinPartitions("gid")
               .mapInArrow(_scan_groups(length, gram), "key long, ctx long, l int, r int"))
    strings = (sized.filter(F.col("size") > max_group).select("key", "ctx", "left", "right").dropDuplicates(["key", "ctx"])
               .mapInArrow(_string_rows(length), "key long, ctx long, back int, s long"))
    twice = strings.groupBy("key", "back", "s").count().filter("count > 1").drop("count")
    counted = strings.join(twice, ["key", "back", "s"]).select("key", "ctx", F.col("back").alias("l"), (length - F.col("back")).alias("r"))
    reach = scanned.unionByName(counted).groupBy("key", "ctx").agg(F.max("l").alias("l"), F.max("r").alias("r"))

    whole = classes.filter("n > 1").select("key", "ctx", F.lit(length - gram).alias("l"), F.lit(length).alias("r"))
    single = classes.filter("n = 1").select("key", "ctx").join(reach, ["key", "ctx"])
    ends = found.join(whole.unionByName(single), ["key", "ctx"]).select(
        "id", "h", F.struct(F.greatest(F.col("pos") - F.col("l"), F.lit(0)).alias("start"), (F.col("pos") + F.col("r")).alias("stop")).alias("span"))
    return ends.groupBy("id", "h").agg(F.collect_set("span").alias("spans"))


def merged(spans: list, n: int) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans within a text of n bytes."""
    out: list[list[int]] = []
    for start, stop in sorted((s["start"], min(s["stop"], n)) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **sizes) -> DataFrame:
    """One row per input row: ``id_col``, kept (the remaining bytes, joined), removed (the maximal
    removed byte ranges), n_bytes.

    A byte goes if a string of ``length`` UTF-8 bytes over it also starts anywhere else in
    the table, the same text included. Strings never cross texts and are judged
    on the input. A null text counts as empty; texts shorter than ``length`` stay whole.
    Repeated rows are copies of each other and lose all bytes from ``length``
    on, also with a null id. Other columns are not read; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = _packed(_doc_rows(docs, id_col, text_col), kind)
    spans = repeated_spans(docs, id_col, text_col, length, **sizes)
    met = texts.join(spans, texts["id"].eqNullSafe(spans["id"]) & (texts["h"] == spans["h"]), "left").select(texts["id"], "z", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            kept, removed, n = [], [], []
            for z, spans in zip(batch.column("z"), batch.column("spans")):
                data = press.decompress(z.as_py())
                gone = merged(spans.as_py(), len(data))
                edges = [0, *(x for run in gone for x in run), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                removed.append([{"start": a, "stop": b} for a, b in gone])
                n.append(len(data))
            ranges = pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(kept, pa.binary()), ranges, pa.array(n, pa.int64())],
                                             names=["id", "kept", "removed", "n_bytes"])

    return (met.mapInArrow(run, f"id {kind}, kept binary, removed array<struct<start:bigint,stop:bigint>>, n_bytes long")
            .withColumnRenamed("id", id_col))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **sizes) -> DataFrame:
    """``docs`` with the kept text of :func:`remove_repeats` in ``text_col``, other columns unchanged.
    A character of which only some bytes are left goes; a null text stays null."""
    key, h, gone, own = (fresh(c, docs) for c in ("span_id", "span_hash", "spans", "own_hash"))
    spans = repeated_spans(docs, id_col, text_col, length, **sizes).select(F.col("id").alias(key), F.col("h").alias(h), F.col("spans").alias(gone))
    named = docs.withColumn(own, F.xxhash64(text_or_empty(text_col)))
    met = named.join(spans, named[id_col].eqNullSafe(spans[key]) & (named[own] == spans[h]), "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, gone in zip(texts, spans):
            if gone is not None and len(gone):
                data = text.encode()
                edges = [0, *(x for run in merged(list(gone), len(data)) for x in run), len(data)]
                text = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])).decode(errors="ignore")
            out.append(text)
        return pd.Series(out, dtype=object)

    return met.select(*(cut(F.col(c), F.col(gone)).alias(c) if c == text_col else named[c] for c in docs.columns))


@register("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(documents(spark, sf_dir))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    return left.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """The maximal removed ranges by counting every string; for tests on small tables."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            d = hashlib.md5(t[i:i + length]).digest()
            seen[d] = seen.get(d, 0) + 1
    return [merged([{"start": i, "stop": i + length} for i in range(len(t) - length + 1)
                    if seen[hashlib.md5(t[i:i + length]).digest()] > 1], len(t)) for t in texts]
