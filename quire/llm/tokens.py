"""Whole-text tokenization with public vocabularies inside Spark tasks.

The pre-tokenizers used here split between runs of letters, digits and signs, around
line ends and before a space that such a run follows. A slice of texts is cut at these
places with numpy, and equal pieces are found by sorting. Pieces repeat far more
than texts do: each worker keeps the ids of recent pieces in a bounded cache of sorted arrays and asks the
library only for new ones. Where a character is not surely of a kind named
above, nothing is cut and the library sees the longer piece.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from . import rolling

CACHE_PIECES = 600_000   # about 60 bytes each
SLICE_BYTES = 2 << 20    # texts encoded at once
SHORT = 16               # pieces of up to so many bytes are told apart by two 8-byte words; longer ones are encoded each time
PIECE = np.dtype([("key", np.uint64), ("low", np.uint64), ("high", np.uint64), ("size", np.uint64)])

_LETTER, _SIGN, _DIGIT, _LINE, _SPACE = 1, 2, 3, 4, 5
_KINDS = np.zeros(256, np.uint8)
_KINDS[[*range(65, 91), *range(97, 123)]] = _LETTER
_KINDS[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = _SIGN  # no apostrophe
_KINDS[48:58], _KINDS[10], _KINDS[32] = _DIGIT, _LINE, _SPACE
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def piece_starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where pieces begin in UTF-8 bytes; ``texts``: where texts begin."""
    kind = _KINDS[data]
    lead = np.flatnonzero(data == 0xC3)  # Latin letters of two bytes, but for two signs among them
    kind[lead] = kind[lead + 1] = np.where((data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7), _LETTER, 0)
    run = (kind != 0) & (kind <= _DIGIT)
    line = kind == _LINE
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (run[:-1] & run[1:] & (kind[:-1] != kind[1:])) | (run[:-1] & line[1:])
    cut[2:-1] |= run[:-2] & line[1:-1] & run[2:]  # behind a single line end; more of them depend on what follows
    cut[:-2] |= (kind[:-1] == _SPACE) & run[1:]
    cut[texts] = True
    return np.flatnonzero(cut[:-1])


def fold_case(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the Latin capitals of two bytes."""
    data = data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    low = np.flatnonzero(data == 0xC3) + 1
    some = low[(data[low] >= 0x80) & (data[low] <= 0x9E) & (data[low] != 0x97)]
    data[some] += 32
    return data


class PieceCache:
    """Ids of different short pieces, in arrays sorted by the pieces' keys.

    When more than ``limit`` would be held, the pieces that no slice asked for since they came go,
    and all of them if that leaves more than half of the limit.
    """

    def __init__(self, limit: int = CACHE_PIECES):
        self.limit = limit
        self._set(np.zeros(0, PIECE), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def _set(self, pieces: np.ndarray, place: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        self.pieces, self.place, self.size, self.ids = pieces, place, size, ids
        self.key = np.ascontiguousarray(pieces["key"])
        self.asked = np.zeros(len(pieces), bool)

    def find(self, pieces: np.ndarray) -> np.ndarray:
        """The row of each piece, -1 where it is not held."""
        if not len(self.key):
            return np.full(len(pieces), -1)
        row = np.minimum(np.searchsorted(self.key, pieces["key"]), len(self.key) - 1)
        row[self.pieces[row] != pieces] = -1
        self.asked[row[row >= 0]] = True
        return row

    def add(self, pieces: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Holds new pieces; of several with one key only one. ``size``: ids of each piece, in the order of ``ids``."""
        keep = np.arange(len(self.key))
        if len(self.key) + len(pieces) > self.limit:
            keep = np.flatnonzero(self.asked)
            keep = keep if len(keep) <= self.limit // 2 else keep[:0]
        held = _ranges(self.place[keep], self.size[keep])
        kept = self.size[keep]
        _, first = np.unique(pieces["key"], return_index=True)
        at = np.searchsorted(self.key[keep], pieces["key"][first])
        there = at < len(keep)
        there[there] = self.key[keep][at[there]] == pieces["key"][first][there]
        at, first = at[~there], first[~there]
        begin = np.cumsum(size) - size
        place = np.insert(np.cumsum(kept) - kept, at, len(held) + begin[first])
        self._set(np.insert(self.pieces[keep], at, pieces[first]), place, np.insert(kept, at, size[first]),
                  np.concatenate((self.ids[held], ids)))


class Encoder:
    """Encodes whole texts by pieces. ``encode``: ids of each of some texts, as the tokenizer gives them.

    ``specials``: strings whose texts are encoded as a whole. ``fold``: the tokenizer
    folds case, so pieces are looked up in lower case.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], specials: list[str] = (), fold: bool = False, limit: int = CACHE_PIECES):
        self.ask, self.specials, self.fold, self.cache = encode, specials, fold, PieceCache(limit)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and where each text's begin (and the end)."""
        odd = [i for i, t in enumerate(texts) if any(s in t for s in self.specials)]
        if odd:
            whole = dict(zip(odd, self.ask([texts[i] for i in odd])))
            flat, at = self.encode(["" if i in whole else t for i, t in enumerate(texts)])
            parts = [whole.get(i, flat[at[i]:at[i + 1]]) for i in range(len(texts))]
            return np.concatenate(parts).astype(np.uint32), np.cumsum([0, *map(len, parts)])
        raw = [t.encode() for t in texts]
        borders = np.cumsum([0, *map(len, raw)])
        if not borders[-1]:
            return np.zeros(0, np.uint32), borders
        data = np.frombuffer(b"".join(raw), np.uint8)
        starts = piece_starts(data, borders[:-1][np.diff(borders) > 0])
        if self.fold:
            data = fold_case(data)
        table, place, size, which = self._ids(data, starts)
        n = size[which]
        flat = table[_ranges(place[which], n)]
        before = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
        return flat, before[np.searchsorted(starts, borders)]

    def _ids(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, where the different pieces' begin in them, how many these are, and which piece stands at each start."""
        chosen, which, pieces = distinct(data, starts)
        ends = np.append(starts[1:], len(data))
        row = np.full(len(chosen), -1)
        row[:len(pieces)] = self.cache.find(pieces)
        missing = np.flatnonzero(row < 0)
        raw, at = data.tobytes(), chosen[missing]
        got = self.ask([raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())])
        n = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.fromiter(chain.from_iterable(got), np.uint32, int(n.sum()))
        place, size = np.empty(len(chosen), np.int64), np.empty(len(chosen), np.int64)
        held = row >= 0
        place[held], size[held] = self.cache.place[row[held]], self.cache.size[row[held]]
        place[missing], size[missing] = len(self.cache.ids) + np.cumsum(n) - n, n
        table = np.concatenate((self.cache.ids, ids))
        short = int(np.searchsorted(missing, len(pieces)))
        if short:
            self.cache.add(pieces[missing[:short]], n[:short], ids[:int(n[:short].sum())])
        return table, place, size, which


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from ``begin`` on, ``size`` of each, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def distinct(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``starts`` of the different pieces, which of them each piece is, and the short ones
    among them, which come first. Long pieces may come more than once."""
    size = np.append(starts[1:], len(data)) - starts
    padded = np.concatenate((data, np.zeros(SHORT, np.uint8)))
    words = np.ndarray((len(data) + SHORT - 7,), "<u8", padded, strides=(1,))
    low = words[starts] & _MASKS[np.minimum(size, 8)]
    high = words[starts + 8 * (size > 8)] & _MASKS[np.clip(size - 8, 0, 8)]
    key = rolling.mix(low ^ rolling.mix(high + size.astype(np.uint64)))
    short = size <= SHORT
    _, first, which = np.unique(key[short], return_index=True, return_inverse=True)
    at = np.flatnonzero(short)
    same = at[first][which]
    if not ((low[at] == low[same]) & (high[at] == high[same]) & (size[at] == size[same])).all():  # two pieces of one key
        first, which = np.arange(len(at)), np.arange(len(at))
    long = np.flatnonzero(~short)
    chosen = np.concatenate((at[first], long))
    out = np.empty(len(starts), np.int64)
    out[at], out[long] = which, len(first) + np.arange(len(long))
    pieces = np.empty(len(first), PIECE)
    some = at[first]
    pieces["key"], pieces["low"], pieces["high"], pieces["size"] = key[some], low[some], high[some], size[some]
    return chosen, out, pieces


@lru_cache(maxsize=4)
def library_encoder(path: str, fold: bool = False) -> Encoder:
    """Of the tokenizers library; strings of special tokens in a text are encoded as the library does by itself."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)

    def encode(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    return Encoder(encode, [t.content for t in tok.get_added_tokens_decoder().values()], fold)


def with_end(flat: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Puts ``end_id`` after each text's ids."""
    return np.insert(flat, at[1:], end_id).astype(np.uint32), at + np.arange(len(at))


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the batches with about SLICE_BYTES of text each, and their texts (null: empty)."""
    for batch in batches:
        start, size, texts = 0, 0, []
        column = batch.column(text)
        for i in range(batch.num_rows):
            texts.append(column[i].as_py() or "")
            size += len(texts[-1])
            if size >= SLICE_BYTES or i == batch.num_rows - 1:
                yield batch.slice(start, i + 1 - start), texts
                start, size, texts = i + 1, 0, []
