"""Near-duplicate detection with bottom-k sketches of one hash function.

1. Each text becomes its set of word shingles, as 63-bit hashes; the sketch
   keeps the ``SKETCH`` least. Rows with equal sets are one class from here on.
2. *Inverted lists* of retained values propose pairs. Only the rarest values of a
   sketch are listed: two classes that reach the similarity share so many
   retained values that one of these is among the rarest of both (``_needed``). Sets that fit the
   sketch as a whole are listed by the exact bound.
   In a larger table a value is in more texts that have nothing else in common, so only lists of up to ``MET`` members propose their pairs at
   once. Classes of longer ones are listed by the *runs of three* values that follow each other in their sketches: of 48 values of a
   union, each in both sketches with probability 0.8, three in a row are so but for 4e-8 (``_runs``).
3. Pairs pass the *union-sketch estimate*: among the least values of both sketches together,
   the share of those in both, with a margin of five standard deviations.
4. The *exact Jaccard* of the full sets decides each link.

A list of runs does not emit all its pairs. In each round it compares its members with one leader, the class whose
values are the most frequent ones, and keeps how each near member's set *differs* from the leader's. Edited copies of one
text differ little, and two of them that do not both link with the leader can only link if they share many of
these differences (``_shared_differences``), so inverted lists of the rarest differences propose their pairs. That is exact for members of
similarity ``CORE`` or more with whatever they link with, which by the triangle inequality of the Jaccard
distance has ``RANGE`` or more with the leader. They leave the list. After the rounds, short lists emit what they still hold, and classes of
longer ones are listed again by the rarest values of their whole sketches, by the same margin, and those that long lists still hold by
the rarest shingles of their full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import rolling
from .common import documents, fresh, text_or_empty, written
from .graph import components
from .registry import register

WORDS = 5          # of a shingle
SIMILARITY = 80    # percent
SKETCH = 48        # retained values
LISTED = 24        # of these, the least are looked up in lists
MARGIN = 6         # standard deviations that the number of shared values may fall short
ROUNDS = 6         # of leaders, at most
CORE = 50          # percent, with the leader, from which all links of a class are found through it
RANGE = 30         # percent: CORE less what the distance of two linked classes may be
LEAST_LED = 0.25   # of the classes in long lists, that have to come near a leader for a round to go on
MET = 4            # members up to which a list of one value emits pairs
SHORT = 32         # members up to which a list of runs emits pairs
SLICE_BYTES = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: of ``words`` words, A-Z in lower case;
    a text of fewer words has its whole sequence as one, a text without words none."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8).copy()
    borders = np.cumsum([0, *(len(t) + 1 for t in raw)])
    data[(data >= 65) & (data <= 90)] += 32
    blank = _BLANK[data]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    h = rolling.mix(rolling.spans_hash(rolling.prefix_sums(data), starts, ends) + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts >= 1024):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
    rolled = h
    for k in range(1, words):
        rolled = rolling.mix(rolled[:-1] + np.uint64(2 * k + 1)) + h[k:]
    rolled = rolling.mix(rolled) >> np.uint64(1)
    at, out = np.searchsorted(starts, borders), []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a:b - words + 1]))
        elif b > a:
            digest = hashlib.blake2b(h[a:b].tobytes(), digest_size=8).digest()
            out.append(np.array([int.from_bytes(digest, "little") >> 1], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, begin, size = batch.column("text"), 0, 0
            for i in range(batch.num_rows):
                size += len(column[i].as_buffer() or b"")
                if size >= SLICE_BYTES or i == batch.num_rows - 1:
                    some = batch.slice(begin, i + 1 - begin)
                    sets = shingle_sets(some.column("text").to_pylist(), words)
                    least = [s[:SKETCH] for s in sets]
                    flat = np.concatenate(least).view(np.int64)
                    offsets = np.cumsum([0, *map(len, least)]).astype(np.int32)
                    keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                    yield pa.RecordBatch.from_arrays(
                        [some.column("id"), some.column("h"), pa.array(list(map(len, sets)), pa.int64()), pa.array(keys, pa.binary()),
                         pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "h", "n", "set", "sketch"])
                    begin, size = i + 1, 0
    return run


def _needed(m: Column) -> Column:
    """Values that two lists of ``m`` retained ones share at least, if the sets reach the similarity."""
    p = SIMILARITY / 100
    return F.greatest(F.lit(1), F.ceil(p * m - MARGIN * F.sqrt(p * (1 - p) * m)))


def _postings(classes: DataFrame) -> DataFrame:
    """(value, node, n, fame) for the rarest retained values of each class, of values that two classes have; ``fame`` says
    how frequent all values of the class are, most of all in texts that others are edited from.

    Sets of up to SKETCH shingles are held whole and listed apart (values below 0), by
    the exact bound. A set that may also meet a larger one is listed both ways.
    """
    n = F.col("n")
    whole = classes.filter(n <= SKETCH).select("node", "n", n.alias("m"), F.ceil(n * SIMILARITY / 100).alias("need"),
                                               F.explode("sketch").alias("v")).withColumn("value", -F.col("v") - 1)
    m = F.least(n, F.lit(LISTED))
    parts = classes.filter(100 * n >= SIMILARITY * SKETCH).select("node", "n", m.alias("m"), _needed(m).alias("need"),
                                                                  F.explode(F.slice("sketch", 1, LISTED)).alias("v")).withColumn("value", F.col("v"))
    rows = whole.unionByName(parts).drop("v")
    met = rows.join(rows.groupBy("value").count().filter("count > 1"), "value")
    # rarest first; values of one class only, which are not in `met`, come before all
    mode = Window.partitionBy("node", F.col("value") < 0)
    place = F.col("m") - F.count(F.lit(1)).over(mode) + F.row_number().over(mode.orderBy("count", "value"))
    fame = F.sum(F.log2("count")).over(mode) / F.col("m")
    return (met.withColumn("place", place).withColumn("fame", fame).filter(F.col("place") <= F.col("m") - F.col("need") + 1)
            .select("value", "node", "n", "fame"))


def _runs(classes: DataFrame) -> DataFrame:
    """(value, node, n) for each run of three values that follow each other in the sketch of a class, of runs that two classes have.

    A set that fits the sketch is there as a whole; sets that differ by a fifth of their union at most have a run in common then, but
    for one of four shingles in one of five, which have two in a row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("sketch")
            v, sizes = lists.flatten().to_numpy().view(np.uint64), lists.value_lengths().to_numpy().astype(np.int64)
            at = np.repeat(np.arange(len(sizes)), sizes)
            two = rolling.mix(rolling.mix(v[:-1]) + v[1:])
            three = rolling.mix(two[:-1] + v[2:])
            i, j = np.flatnonzero(at[2:] == at[:-2]), np.flatnonzero((at[1:] == at[:-1]) & (sizes[at[1:]] <= 5))
            of = np.concatenate((at[i], at[j]))
            value = (np.concatenate((three[i], two[j])) >> np.uint64(1)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(value), batch.column("node").take(pa.array(of)), batch.column("n").take(pa.array(of))],
                                             names=["value", "node", "n"])

    rows = classes.select("node", "n", "sketch").mapInArrow(run, "value long, node long, n long")
    return rows.join(rows.groupBy("value").count().filter("count > 1").select("value"), "value")


def _texts(rows: DataFrame, wanted: DataFrame, kind: str, words: int) -> DataFrame:
    """(node, z): the compressed text of one row of each wanted class (node, rep, set)."""
    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        c = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = pa.array([c.compress(t.as_py().encode()) for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), z], names=["id", "h", "z"])

    packed = rows.mapInArrow(press, f"id {kind}, h long, z binary")
    met = packed.join(wanted, packed["id"].eqNullSafe(wanted["rep"]["id"]) & (packed["h"] == wanted["rep"]["h"]))
    return met.select("node", "z").dropDuplicates(["node"])


def _compared(words: int, least: int, differ: bool):
    """Pairs whose full sets reach a similarity of ``least`` percent, with the shingles they share and, if asked, those of only one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        d = zstandard.ZstdDecompressor()
        last, own = None, None
        for batch in batches:
            a, b, za, zb = (batch.column(c) for c in ("a", "b", "za", "zb"))
            for start in range(0, batch.num_rows, 64):
                part, out, sizes, apart = range(start, min(start + 64, batch.num_rows)), [], [], [np.zeros(0, np.uint64)]
                others = shingle_sets([d.decompress(zb[i].as_py()).decode() for i in part], words)
                for i, other in zip(part, others):
                    if a[i].as_py() != last:
                        last, own = a[i].as_py(), shingle_sets([d.decompress(za[i].as_py()).decode()], words)[0]
                    shared = len(np.intersect1d(own, other, assume_unique=True))
                    if 100 * shared >= least * (len(own) + len(other) - shared):
                        out.append(i)
                        sizes.append((len(own), len(other), shared))
                        apart.append(np.setxor1d(own, other, assume_unique=True) if differ else apart[0])
                at, numbers = pa.array(out, pa.int32()), np.array(sizes, np.int64).reshape(-1, 3)
                offsets = pa.array(np.cumsum([len(x) for x in apart]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [a.take(at), b.take(at), *map(pa.array, numbers.T), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(apart).view(np.int64)))],
                    names=["a", "b", "na", "nb", "shared", "apart"])
    return run


def _estimated(sa: str, sb: str, percent: int) -> Column:
    """Whether the union sketch of two sketches lets the similarity be reached."""
    p = percent / 100
    least = F.slice(F.array_sort(F.array_union(sa, sb)), 1, SKETCH)
    both, k = F.size(F.array_intersect(least, F.array_intersect(sa, sb))), F.size(least)
    return both >= p * k - 5 * F.sqrt(p * (1 - p) * k)


def _likely(pairs: DataFrame, classes: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """Those of ``pairs`` (a, b) that pass the estimate."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(_estimated("sa", "sb", percent)).select("a", "b")


def _links(likely: DataFrame, texts: DataFrame, words: int, percent: int = SIMILARITY, differ: bool = False) -> DataFrame:
    """Those of the pairs (a, b) whose full sets reach the similarity, as of :func:`_compared`."""
    held = likely.join(texts.select(F.col("node").alias("b"), F.col("z").alias("zb")), "b") \
        .join(texts.select(F.col("node").alias("a"), F.col("z").alias("za")), "a")
    return held.select("a", "b", "za", "zb").sortWithinPartitions("a").mapInArrow(
        _compared(words, percent, differ), "a long, b long, na long, nb long, shared long, apart array<bigint>")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after what the pairs (a, b) link."""
    ends = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    joined = links.select("a", "b").join(ends("a"), "a").join(ends("b"), "b")
    moved = components(joined.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    return written(roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
                   .select("node", F.coalesce("to", "root").alias("root"), "fame"), "roots")


def _alike(x, y, percent: int = SIMILARITY) -> Column:
    """Whether sets of these sizes can reach the similarity."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _placed(rows: DataFrame, owner: list[str], space: list[str]) -> DataFrame:
    """``rows`` (of a value ``v``) of values that two owners have, with their ``place`` among those of the owner, the most frequent
    one first. Owners that share ``k`` values have one in common that is at place ``k`` or later for both."""
    met = rows.join(rows.groupBy(*space, "v").count().filter("count > 1"), [*space, "v"])
    place = F.row_number().over(Window.partitionBy(*owner).orderBy(F.desc("count"), F.desc("v")))
    return met.withColumn("place", place).drop("count")


def _shared_differences(near: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b) of different roots that may link, by what their sets have in common in their difference from a leader's (a leader's set is ``a`` of ``near``).

    With the leader's size n, a set that lacks x of its shingles and has y others, and p for the similarity, two sets link if
    they share at least (w + w' - (100 - p) n) / (100 + p) differences, where w = 100 x + p y. A set with w <= (100 - p) n links with the leader,
    so of two that are not yet linked the one with the larger w, the *far* one, exceeds this.
    """
    p = SIMILARITY
    w = 100 * (F.col("na") - F.col("shared")) + p * (F.col("nb") - F.col("shared"))
    over = w - (100 - p) * F.col("na")
    members = near.select(
        F.col("a").alias("lead"), F.col("b").alias("node"), F.col("nb").alias("n"), w.alias("w"), over.alias("over"), "apart",
        (100 * F.col("shared") >= CORE * (F.col("na") + F.col("nb") - F.col("shared"))).alias("core")).join(roots.select("node", "root"), "node")
    mixed = (members.groupBy("lead").agg(F.min("w").alias("least"), F.min("root").alias("r"), F.max("root").alias("r2"))
             .filter("r < r2").select("lead", "least"))
    members = (members.join(mixed, "lead").withColumn("far", F.when(F.col("over") > 0, F.ceil((F.col("over") + F.col("least")) / (100 + p))))
               .withColumn("close", F.ceil((F.col("w") + F.greatest("over", F.lit(1))) / (100 + p))))
    rows = members.select("lead", "node", "far", "close", F.explode("apart").alias("v"))
    rows = _placed(rows, ["lead", "node"], ["lead"]).filter(F.col("place") >= F.least("far", "close"))
    rows = written(rows.join(members.select("lead", "node", "n", "w", "core", "root"), ["lead", "node"]), "differences")
    far = rows.filter(F.col("place") >= F.col("far")).drop("far", "close", "place")
    close = rows.filter(F.col("place") >= F.col("close")).select("lead", "v", *[F.col(c).alias(c + "2") for c in ("node", "n", "w", "core", "root")])
    met = far.join(close, ["lead", "v"]).filter(
        (F.col("root") != F.col("root2")) & (F.col("core") | F.col("core2")) & _alike("n", "n2")
        & ((F.col("w") > F.col("w2")) | (F.col("w") == F.col("w2")) & (F.col("node") > F.col("node2"))))
    return met.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()


def _full_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        d = zstandard.ZstdDecompressor()
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                some = batch.slice(start, 64)
                sets = shingle_sets([d.decompress(z.as_py()).decode() for z in some.column("z")], words)
                offsets = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [some.column("node"), pa.array(list(map(len, sets)), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64)))],
                    names=["node", "n", "s"])
    return run


def _pairs_within(rows: DataFrame, key: str) -> DataFrame:
    """(a, b) of different roots that share a ``key``, of ``rows`` (key, node, n, root)."""
    other = rows.select(key, F.col("node").alias("b"), F.col("root").alias("root2"), F.col("n").alias("n2"))
    return (rows.withColumnRenamed("node", "a").join(other, key)
            .filter((F.col("a") < F.col("b")) & (F.col("root") != F.col("root2")) & _alike("n", "n2")).select("a", "b").distinct())


def _led(now: DataFrame) -> DataFrame:
    """Each row of the lists (value, node, n, fame) with the ``lead`` (node, n) of its list.

    A list's most famous member is put up; a class votes for the one that is put up most often in its lists, and a list is led by
    the one with most votes. So a list that only far edited copies are in is led by the text that they are edited from.
    """
    most = lambda rows, key: (rows.groupBy(key, "lead").agg(F.count(F.lit(1)).alias("c")).groupBy(key)
                              .agg(F.max(F.struct("c", "lead"))["lead"].alias("lead")))
    up = now.groupBy("value").agg(F.max(F.struct("fame", "node", "n")).alias("m")).select("value", F.struct("m.node", "m.n").alias("lead"))
    votes = most(now.select("value", "node").join(up, "value"), "node")
    chosen = most(now.select("value", "node").join(votes, "node"), "value")
    return now.select("value", "node", "n").join(chosen, "value")


def _middles(near: DataFrame) -> DataFrame:
    """(lead, better): the member that comes closer to all others than their leader does.

    What most members differ in from the leader is the leader's own; the member nearest to the leader's set
    without these differences is taken.
    """
    found = near.select(F.col("a").alias("lead"), F.col("b").alias("node"), F.col("nb").alias("n"), "apart")
    parts = found.select("lead", "node", F.explode("apart").alias("v"))
    sizes = found.groupBy("lead").agg(F.count(F.lit(1)).alias("members"))
    own = parts.groupBy("lead", "v").count().filter("count > 2").join(sizes, "lead").filter("2 * count > members").select("lead", "v")
    gain = parts.join(own, ["lead", "v"]).groupBy("lead", "node").agg(F.count(F.lit(1)).alias("gain"))
    nearer = found.join(gain, ["lead", "node"]).withColumn("d", F.size("apart") - 2 * F.col("gain")).filter("d < 0")
    return nearer.groupBy("lead").agg(F.min(F.struct("d", "node", "n")).alias("m")).select("lead", F.struct("m.node", "m.n").alias("better"))


def link_classes(classes: DataFrame, rows: DataFrame, kind: str, words: int) -> DataFrame:
    """(node, root) of the classes that share a list with another one; linked ones have one root."""
    lists = written(_postings(classes), "postings")
    shared = lists.groupBy("value").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    lists = written(lists.join(shared, "value"), "lists")
    roots = written(lists.groupBy("node").agg(F.max("fame").alias("fame")).select("node", F.col("node").alias("root"), "fame"), "roots")
    met = _pairs_within(lists.filter(F.col("c") <= MET).select("value", "node", "n", F.col("node").alias("root")), "value")
    many = written(lists.filter(F.col("c") > MET).select("node").distinct(), "many")
    lists = written(_runs(classes.join(many, "node", "left_semi")), "runs")
    n_lists, before, short = lists.count(), None, []
    for step in range(ROUNDS + 1):
        now = lists.join(roots, "node").select("value", "node", "n", "root", "fame")
        counts = now.groupBy("value", "root").agg(F.count(F.lit(1)).alias("c"))
        open_lists = counts.groupBy("value").agg(F.sum("c").alias("members"), (F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))).alias("p")).filter("p > 0")
        now = now.join(open_lists, "value")
        few = written(now.filter(F.col("members") <= SHORT).select("value", "node", "n"), "short")
        now = written(now.filter(F.col("members") > SHORT).drop("members"), "now")
        if step:
            short.append(few)
        else:
            pairs = met.union(_pairs_within(few.withColumn("root", F.col("node")), "value")).distinct()
            first = written(_likely(written(pairs, "pairs"), classes), "likely")
            wanted = first.select(F.col("a").alias("node")).union(first.select("b")).union(now.select("node")).distinct()
            texts = written(_texts(rows, classes.join(wanted, "node").select("node", "rep"), kind, words), "texts")
        open_pairs = (now.select("value", "p").distinct().agg(F.sum("p")).first()[0] or 0) // 2
        # leaders help while they take classes from lists
        if not open_pairs or step == ROUNDS or step and (open_pairs <= n_lists or open_pairs > 0.8 * before):
            break
        before = open_pairs
        led = written(_led(now), "led")
        compared = lambda rows: _links(_likely(written(
            rows.filter((F.col("node") != F.col("lead.node")) & _alike("n", "lead.n", RANGE))
            .select(F.col("lead.node").alias("a"), F.col("node").alias("b")).distinct(), "led-pairs"), classes, RANGE), texts, words, RANGE, True)
        near = written(compared(led), "near")
        if near.select("b").distinct().count() < LEAST_LED * now.select("node").distinct().count():
            break
        middles = written(_middles(near), "middles")
        moved = led.join(middles, led["lead"]["node"] == middles["lead"]).select("value", "node", "n", F.col("better").alias("lead"))
        kept = led.join(middles, led["lead"]["node"] == middles["lead"], "left_anti")
        near = written(near.join(middles.select(F.col("lead").alias("a")), "a", "left_anti").select(*near.columns).union(compared(moved)), "near")
        led = kept.union(moved).filter("node <> lead.node")
        union = F.col("na") + F.col("nb") - F.col("shared")
        roots = _merged(roots, near.filter(100 * F.col("shared") >= SIMILARITY * union))
        pairs = written(_shared_differences(near, roots), "pairs")
        roots = _merged(roots, _links(_likely(pairs, classes), texts, words))
        core = near.filter(100 * F.col("shared") >= CORE * union).select(F.col("a").alias("lead"), F.col("b").alias("node")).distinct()
        lists = written(led.select("value", "node", "n", F.col("lead.node").alias("lead")).join(core, ["lead", "node"], "left_anti").select("value", "node", "n"), "lists")
    ends = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    first = first.join(ends("a"), "a").join(ends("b"), "b").filter("ra <> rb").select("a", "b")
    pairs = first.limit(0)
    if short:
        pairs = _pairs_within(reduce(DataFrame.union, short).join(roots.select("node", "root"), "node"), "value")
    rest = written(now.select("node").distinct(), "rest")
    if not rest.isEmpty():
        held = classes.join(rest, "node").select("node", "n", F.explode("sketch").alias("v"))
        again = _placed(held, ["node"], []).filter(F.col("place") >= _needed(F.least("n", F.lit(SKETCH)))).join(roots.select("node", "root"), "node")
        again = written(again.select("v", "node", "n", "root"), "again")
        still = written(again.groupBy("v").agg(F.count(F.lit(1)).alias("c"), (F.min("root") < F.max("root")).alias("open")).filter(f"c > {SHORT} and open").select("v"), "still")
        pairs = pairs.union(_pairs_within(again.join(still, "v", "left_anti"), "v"))
        rest = written(again.join(still, "v").select("node").distinct(), "rest")
        if not rest.isEmpty():
            full = texts.join(rest, "node").mapInArrow(_full_sets(words), "node long, n long, s array<bigint>").select("node", "n", F.explode("s").alias("v"))
            listed = _placed(full, ["node"], []).filter(100 * F.col("place") >= SIMILARITY * F.col("n")).join(roots.select("node", "root"), "node")
            pairs = pairs.union(_pairs_within(listed.select("v", "node", "n", "root"), "v"))
    likely = written(first.union(_likely(written(pairs.distinct(), "pairs"), classes)).distinct(), "likely")
    return _merged(roots, _links(likely, texts, words)).select("node", "root")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per input row: ``id_col``, n_shingles, component_id, kept, h (a hash of the text), chosen.

    Rows are linked when their shingle sets share at least 80 percent of their union;
    ``component_id`` is the smallest id reachable by links, the row's own included, and
    ``kept`` says that it is the row's own. Null texts count as empty; rows without
    words are linked with nothing. Repeated rows are linked with each other. A null id is
    reachable but never the smallest, unless a component has no other. ``chosen`` marks equal rows of which one is
    to stay for their component (all rows without words are). Other columns are not read; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = written(texts.mapInArrow(_sketches(words), f"id {kind}, h long, n long, set binary, sketch array<bigint>"), "rows")
    first = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    classes = written(rows.filter("n > 0").groupBy("set")
                      .agg(F.min(first).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
                      .withColumn("node", F.monotonically_increasing_id()), "classes")
    roots = link_classes(classes, texts, kind, words)
    grouped = classes.select("node", "set", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = grouped.groupBy("root").agg(F.min("rep").alias("best"))
    decided = grouped.join(least, "root").select("set", "best")
    out = rows.select("id", "h", "n", "set").join(decided, "set", "left")
    own = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("best.id")).otherwise(F.col("id")).alias("component_id"),
                      F.when(F.col("n") > 0, F.col("id").eqNullSafe(F.col("best.id"))).otherwise(True).alias("kept"),
                      "h", F.when(F.col("n") > 0, own.eqNullSafe(F.col("best"))).otherwise(True).alias("chosen"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``docs`` with one row of each component of :func:`near_dedup`, and all rows without words; columns unchanged."""
    mark, key = fresh("text_hash", docs), fresh("chosen_id", docs)
    stay = (near_dedup(docs, id_col, text_col, words).filter("chosen")
            .select(F.col(id_col).alias(key), F.col("h").alias(mark)).distinct())
    named = docs.withColumn(mark, F.xxhash64(text_or_empty(text_col)))
    met = named.join(stay, (named[mark] == stay[mark]) & named[id_col].eqNullSafe(stay[key]), "left_semi")
    return met.dropDuplicates([mark, id_col]).drop(mark)


@register("op7_near_dedup")
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir), words=2).select("doc_id", "n_shingles", "component_id", "kept")
