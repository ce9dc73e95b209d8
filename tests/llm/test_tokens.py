"""Tokenization, token files, packing and BPE against the libraries themselves."""

import base64
import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm import bpe, packing, token_files, tokens
from quire.llm.tokens import library_encoder

SF = "/root/testdata/sf0.001"
TEXTS = st.text(alphabet=st.one_of(st.sampled_from(list("aZ é\n\t '.,!09ßs<|>×÷ÀÞ") + ["́", " ", " ", "\x1c", "中", "İ"]),
                                   st.characters(exclude_categories=("Cs",))), max_size=60)
ODD = ["", " ", "  a  b ", "a \n b\n\nc", "it's 'S 's <|endoftext|> x", "x" * 3000, "ab " * 2000, " a  b", "é ́e", " a", "a "]


@lru_cache
def lib(name):
    return Tokenizer.from_file(P.path(name))


@lru_cache
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.VOCABULARY), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(texts, name, spaced):
    flat, at = library_encoder(P.path(name), fold=not spaced).encode(texts)
    for t, a, b in zip(texts, at, at[1:]):
        assert flat[a:b].tolist() == lib(name).encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_give_the_library_ids(name, spaced):
    same(ODD, name, spaced)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_pieces_give_the_library_ids_random(texts):
    same(texts, "byte_bpe_50k.json", True)
    same(texts, "word_bpe_49k.json", False)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_bpe_matches_the_library(texts):
    flat, at = bpe.text_encoder(P.path(bpe.VOCABULARY), P.PATTERN).encode(texts)
    for t, a, b in zip(texts, at, at[1:]):
        assert flat[a:b].tolist() == tik().encode_ordinary(t)
        assert bpe.decode_ids(P.path(bpe.VOCABULARY), flat[a:b].astype("<u4").tobytes())[1] == t.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40), st.text(max_size=10), st.integers(0, 40), st.integers(0, 10))
def test_append_and_replace_equal_encoding_anew(text, more, at, cut):
    v = bpe.load_vocabulary(P.path(bpe.VOCABULARY))
    e = bpe.PrefixEncoder(v, text.encode())
    e.append(more.encode())
    assert e.last == bpe.PrefixEncoder(v, (text + more).encode()).last
    data = e.data
    start = min(at, len(data))
    stop = min(start + cut, len(data))
    e.replace(start, stop, more.encode())
    anew = bpe.PrefixEncoder(v, data[:start] + more.encode() + data[stop:])
    assert e.last == anew.last and e.ids() == anew.ids()


def test_edit_near_the_start_encodes_few_prefixes_again():
    v = bpe.load_vocabulary(P.path(bpe.VOCABULARY))
    e = bpe.PrefixEncoder(v, b"the quick brown fox jumps over it " * 60)
    again = e.replace(5, 6, b"Q")
    assert again < len(e.data) / 2
    assert e.last == bpe.PrefixEncoder(v, e.data).last


def odd_documents(spark):
    rows = [(None, "no id"), (3, None), (3, None), (5, "same"), (5, "same"), (7, "x " * 9000), *((10 + i, t) for i, t in enumerate(ODD))]
    return spark.createDataFrame([(a, b, "p", 1) for a, b in rows], "doc_id long, text string, part string, ids int")


def test_bpe_rows(spark):
    docs = odd_documents(spark)
    got = bpe.encode_texts(docs, P.path(bpe.VOCABULARY))
    assert sorted((str(r[0]), np.frombuffer(r[1], "<u4").tolist()) for r in got.collect()) == \
        sorted((str(r.doc_id), tik().encode_ordinary(r.text or "")) for r in docs.collect())
    back = {r.data for r in bpe.decode_texts(got, P.path(bpe.VOCABULARY)).collect()}
    assert back == {(r.text or "").encode() for r in docs.collect()}
    assert bpe.encode_texts(docs.limit(0), P.path(bpe.VOCABULARY)).count() == 0


def test_op10_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in bpe.op10_bpe(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for k, t in docs.items():
        ids = tik().encode_ordinary(t or "")
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def expected_token_files(rows):
    at, out = 0, []
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*lib("byte_bpe_50k.json").encode(t or "", add_special_tokens=False).ids, 2]
        out.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_op2_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in token_files.op2_token_files(spark, SF).collect())
    assert got == expected_token_files(docs)


def test_token_files_odd_rows_and_selective_reads(spark, scratch):
    docs, path = odd_documents(spark), scratch + "/tokens"
    token_files.write_tokens(docs, path, P.path(token_files.VOCABULARY))
    want = expected_token_files([(r.doc_id, r.text) for r in docs.collect()])
    rows = token_files.read_tokens(spark, path)
    assert sorted((r.start, r.n_tokens) for r in rows.collect()) == sorted(x[1:3] for x in want)
    some = token_files.read_tokens(spark, path, 5, 10)
    assert sorted((r.doc_id, r.start) for r in some.collect()) == sorted(x[:2] for x in want if x[0] is not None and 5 <= x[0] <= 10)
    assert "tokens:array" not in rows.select("doc_id", "start")._jdf.queryExecution().executedPlan().toString()
    token_files.write_tokens(docs.limit(0), path + "-empty", P.path(token_files.VOCABULARY))
    assert token_files.read_tokens(spark, path + "-empty").count() == 0


def check_packing(rows, texts, window=2048):
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append((r.start, r.ids, r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.length == len(r.ids) // 4
    for k, t in texts.items():
        want = np.array([*lib("word_bpe_49k.json").encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        got = sorted(docs[k])
        assert b"".join(x[1] for x in got) == want and {x[2] for x in got} == {len(want) // 4}
        assert [x[0] for x in got] == [0, *np.cumsum([len(x[1]) // 4 for x in got]).tolist()][:-1]
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [0, *np.cumsum([n for _, n in s]).tolist()][:-1]
        total = sum(n for _, n in s)
        assert total == window or total & (total - 1) == 0 and total < window
    return sequences


def test_packing_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs, P.path(packing.VOCABULARY)).collect()
    check_packing(rows, {r.doc_id: r.text for r in docs.collect()})
    query = {(r.doc_id, r.start): r.ids_crc32 for r in packing.op4_packing(spark, SF).collect()}
    assert query == {(r.doc_id, r.start): zlib.crc32(r.ids) for r in rows}


def test_packing_odd_rows(spark):
    docs = odd_documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(packing.pack(docs, P.path(packing.VOCABULARY)).collect(), {r.doc_id: r.text for r in docs.collect()})
    assert packing.pack(odd_documents(spark).coalesce(1), P.path(packing.VOCABULARY)).filter("doc_id = 3").count() == 2
    assert packing.pack(docs.limit(0), P.path(packing.VOCABULARY)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(1, 5))
def test_sum_of_squares_rule(sizes, max_open):
    """Each placement minimises the sum of squared counts, recomputed in full."""
    packer, window = packing.SumOfSquares(16, 1000), 16
    for k, n in enumerate(sizes):
        before = packer.count[1:window].copy()
        packer.add(k, b"\0\0\0\0" * n)
        s = n % window
        if s:
            costs = []
            for h in range(window - s + 1):
                if h == 0 or before[h - 1] > 0:
                    after = before.copy()
                    if h:
                        after[h - 1] -= 1
                    if h + s < window:
                        after[h + s - 1] += 1
                    costs.append((after ** 2).sum())
            assert (packer.count[1:window] ** 2).sum() == min(costs)
    small, total = packing.SumOfSquares(16, max_open), sum(sizes)
    out = [w for k, n in enumerate(sizes) for w in small.add(k, b"\0\0\0\0" * n)] + small.finish()
    lengths = [sum(len(p[2]) // 4 for p in w) for w in out]
    assert sum(lengths) == total and all(x == 16 or x & (x - 1) == 0 for x in lengths)
    assert sum(x < 16 for x in lengths) <= 4


def test_piece_cache_stays_bounded_and_right():
    path = P.path("byte_bpe_50k.json")
    asked = []
    tok = Tokenizer.from_file(path)

    def ask(pieces):
        asked.extend(pieces)
        return [e.ids for e in tok.encode_batch_fast(pieces, add_special_tokens=False)]

    encoder, draw = tokens.Encoder(ask, limit=40), random.Random(5)
    for _ in range(80):
        texts = ["".join(draw.choice(["a", "B", " the", "\n", "é", "7", " cat", "x" * 20, "\0", " "]) for _ in range(draw.randint(0, 40))) for _ in range(6)]
        flat, at = encoder.encode(texts)
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
        held = encoder.cache
        assert (held.key[1:] > held.key[:-1]).all() and len(held.place) == len(held.size) == len(held.key)
    once = len(asked)
    first = tokens.Encoder(ask).encode(["the cat the cat the cat"])[0]
    assert len(asked) - once == 3 and len(first) == 6
    big = tokens.Encoder(ask)
    big.encode([" the cat sat"])
    once = len(asked)
    big.encode([" cat sat the"])
    assert len(asked) == once


def test_full_windows_are_filled_up_from_the_emptiest():
    packer = packing.SumOfSquares(16, 1000)
    for level, key in ((12, 1), (11, 2), (6, 3), (3, 4)):
        packer._open(level, [(key, 0, bytes(range(4 * level)), level)])
    out = packer.finish()
    shape = [[(p[0], p[1], len(p[2]) // 4) for p in w] for w in out]
    assert shape == [[(1, 0, 12), (4, 0, 3), (3, 0, 1)], [(2, 0, 11), (3, 1, 5)]]
    assert out[1][1][2] == bytes(range(4, 24)) and packer.n_open == 0 and packer.finish() == []
    packer, closed = packing.SumOfSquares(2048, 40), []
    draw = random.Random(3)
    for k in range(400):
        closed += packer.add(k, bytes(4 * draw.randint(1, 2047)))
        assert packer.n_open <= 40
    assert all(sum(len(p[2]) for p in w) == 4 * 2048 for w in closed)
