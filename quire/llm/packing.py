"""Sum-of-squares online packing of documents into windows of tokens.

Each task packs its documents as they come, with no shuffle. Whole windows are
cut from long documents first. The rest (less than a window) goes to the fill
level that minimises the sum of the squared counts of partly filled windows: a
level array holds how many windows stand at each level, and placing ``s``
tokens on level ``h`` changes the sum by ``2 (N[h+s] - N[h]) + 2``. Ties take the
fullest level. Windows stay as they were placed. When a task ends, or keeps more than
``max_open`` partly filled windows, the fullest of these are filled up with pieces cut from the
emptiest, so only what fills a gap is taken apart (at the end all, beyond the bound until half are left); the
last remainder becomes windows whose sizes are powers of two, which need no padding.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_or_empty
from .registry import register
from .tokens import library_encoder, slices, with_end

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
WINDOW = 2048
MAX_OPEN = 2048

SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, "
          "offset long, sequence_length long")


class SumOfSquares:
    """Online packer. ``add`` and ``finish`` return closed windows, each a list of
    pieces (key, start, ids, key_tokens) whose ids are 4 bytes each."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        import numpy as np

        self.np, self.window, self.max_open = np, window, max_open
        # windows by level; N[0] = 1/2 and N[window] = -1/2 make the rule above
        # hold for a new window and for one that becomes full
        self.count = np.zeros(window + 1)
        self.count[0], self.count[window] = 0.5, -0.5
        self.level: list[list[list]] = [[] for _ in range(window + 1)]
        self.n_open = 0

    def add(self, key, ids: bytes) -> list[list]:
        n, closed = len(ids) // 4, []
        whole = n - n % self.window
        for at in range(0, whole, self.window):
            closed.append([(key, at, ids[4 * at:4 * (at + self.window)], n)])
        if n > whole:
            closed += self._place((key, whole, ids[4 * whole:], n), n - whole)
        return closed

    def _place(self, piece: tuple, s: int) -> list[list]:
        there = self.count[:self.window - s + 1]
        cost = self.np.where(there > 0, self.count[s:] - there, self.np.inf)
        h = len(cost) - 1 - int(cost[::-1].argmin())
        if h:
            pieces = self.level[h].pop()
            self.count[h] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if h + s == self.window:
            return [pieces]
        self._open(h + s, pieces)
        return self._top_up(self.max_open // 2) if self.n_open > self.max_open else []

    def _open(self, level: int, pieces: list) -> None:
        self.level[level].append(pieces)
        self.count[level] += 1
        self.n_open += 1

    def _top_up(self, stay: int) -> list[list]:
        """Fills the fullest open windows from the emptiest ones, until no more than ``stay`` (at least one) are open."""
        todo = deque((level, pieces) for level in range(self.window - 1, 0, -1) for pieces in self.level[level])
        for level in range(1, self.window):
            self.level[level], self.count[level] = [], 0
        self.n_open, closed = 0, []
        while len(todo) > max(stay, 1):
            level, pieces = todo.popleft()
            while level < self.window:
                donor_level, donor = todo.pop()
                taken, rest = _cut(donor, self.window - level)
                moved = min(donor_level, self.window - level)
                pieces, level = pieces + taken, level + moved
                if rest:
                    todo.append((donor_level - moved, rest))
                elif not todo:
                    break
            if level < self.window:
                todo.append((level, pieces))
            else:
                closed.append(pieces)
        for level, pieces in todo:
            self._open(level, pieces)
        return closed

    def finish(self) -> list[list]:
        closed = self._top_up(0)
        last = [p for pieces in self.level[1:self.window] for q in pieces for p in q]
        left = sum(len(p[2]) for p in last) // 4
        while left:
            size = 1 << (left.bit_length() - 1)
            now, last = _cut(last, size)
            closed.append(now)
            left -= size
        return closed


def _cut(pieces: list[tuple], n: int) -> tuple[list[tuple], list[tuple]]:
    """The first ``n`` tokens of the pieces (all, if fewer), and what is left."""
    for i, (key, start, ids, total) in enumerate(pieces):
        here = len(ids) // 4
        if here > n:
            head = [(key, start, ids[:4 * n], total)] if n else []
            return pieces[:i] + head, [(key, start + n, ids[4 * n:], total), *pieces[i + 1:]]
        n -= here
    return pieces, []


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
         end_id: int = END_ID, window: int = WINDOW, max_open: int = MAX_OPEN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit
    integers), doc_tokens, sequence_id, offset, sequence_length.

    Each id of each document (its tokens, then ``end_id``) lies in exactly one
    piece; pieces fill a sequence from offset 0 without gaps. Sequences are full
    or a power of two long, so none needs padding. A null text counts as empty
    and packs its end id alone. Repeated rows and repeated or null ids are
    packed each on their own. Other columns are not read. An empty table gives
    no rows. A sequence lies in one partition of ``docs``: its id is the
    partition's number times 2**32 plus its place there.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, packer = library_encoder(vocabulary, fold=True), SumOfSquares(window, max_open)
        at = TaskContext.get().partitionId() << 32

        def rows(closed: list[list]) -> pa.RecordBatch:
            nonlocal at
            out = []
            for pieces in closed:
                lengths = [len(p[2]) // 4 for p in pieces]
                offset = 0
                for (key, start, ids, total), n in zip(pieces, lengths):
                    out.append((key, start, n, ids, total, at, offset, sum(lengths)))
                    offset += n
                at += 1
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 4
            columns = zip(*out) if out else [()] * 8
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_length"]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

        for batch, texts in slices(batches, "text"):
            closed = []
            flat, place = with_end(*encoder.encode(texts), end_id)
            raw, place = flat.astype("<u4").tobytes(), place.tolist()
            for key, a, b in zip(batch.column("doc_id").to_pylist(), place, place[1:]):
                closed += packer.add(key, raw[4 * a:4 * b])
            yield rows(closed)
        yield rows(packer.finish())

    one = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return one.mapInArrow(run, SCHEMA)


@register("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "sequence_length")
