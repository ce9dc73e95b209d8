"""Spelling variants against a comparison of all words, and the contract's words against plain Python."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import spelling as S

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i + 1:] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1:]


def brute_force(counts, ratio=10):
    cut = {}
    for w in counts:
        for k in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            cut.setdefault(k, set()).add(w)
    form, rows = {}, {}
    for w, n in counts.items():
        near = [v for v in set().union(*(cut.get(k, ()) for k in {w} | {w[:i] + w[i + 1:] for i in range(len(w))})) if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
        rows[w] = len(near)
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, rows[w], counts[form[w]] if form[w] else None))
    return sorted(out)


def words_of(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def result(spark, counts, **kw):
    rows = spark.createDataFrame(list(counts.items()), "word string, n long")
    return sorted(map(tuple, S.spelling_variants(rows, **kw).collect()))


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, S.op11_spelling_variants(spark, SF).collect())) == brute_force(words_of(docs))


def test_edge_rows_of_documents(spark):
    docs = [(1, "Éclairs éclairs ÉCLAIRS straÿes_straÿes ×÷×÷×÷×"), (1, "ÉCLAIRS Éclairs"), (2, None), (3, ""), (4, "a" * 100_000), (5, "a" * 100_000),
            (6, "a" * 100_001 + " " + "a" * 100_001), (None, "wordless wordless"), (7, " ".join(["somewhere", "Sumewhere"] * 40))]
    rows = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, word int, r string")
    got = S.spelling_variants(S.vocabulary(S.noisy_runs(rows)))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == brute_force(words_of(docs))


@pytest.mark.parametrize("long,max_pairs,symbols", [(64, 4096, 6), (9, 4096, 6), (64, 1, 2), (64, 4096, 1)])
def test_every_way_finds_all(spark, long, max_pairs, symbols):
    rng = np.random.default_rng(5)
    counts = {}
    for _ in range(1200):
        counts["".join(rng.choice(list("abcé中\U0001F600"), rng.integers(4, 13), p=[.4, .2, .2, .1, .05, .05]))] = int(10 ** rng.integers(0, 6))
    for w in list(counts)[:200]:
        i = int(rng.integers(len(w)))
        counts.setdefault(w[:i] + w[i + 1:], 1)
        counts.setdefault(w[:i] + "b" + w[i:], 1000)
    assert result(spark, counts, long=long, max_pairs=max_pairs, symbols=symbols) == brute_force(counts)


def test_chains_and_ties(spark):
    counts = {"aaaaaaaa": 100_000, "aaaaaaa": 10_000, "aaaaaa": 1000, "aaaaa": 100, "aaaa": 10, "aaa": 1, "zaaaaaaaa": 3, "baaa": 100, "caaa": 100, "x": 5}
    assert result(spark, counts) == brute_force(counts)


def test_empty_null_and_repeated(spark):
    assert S.spelling_variants(spark.createDataFrame([], "word string, n long")).collect() == []
    rows = spark.createDataFrame([("abcdefg", 1), ("abcdefg", 4), (None, 9), ("", 2), ("abcdefh", 50)], "word string, n long").withColumn("form", F.lit(1))
    assert sorted(map(tuple, S.spelling_variants(rows).collect())) == brute_force({"abcdefg": 5, "abcdefh": 50})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=9))
def test_earlier_neighbours(word):
    own = np.array([word], np.uint64)
    _, got = S.earlier_neighbours(own, 4)
    want = {tuple(word)} | {tuple(word[:i] + word[i + 1:]) for i in range(len(word))} | {
        tuple(word[:i] + [c] + word[i + 1:]) for i in range(len(word)) for c in range(1, word[i])}
    code = {int(S._codes(np.array([w], np.uint64).reshape(1, -1))[0]) for w in want}
    assert len(got) == len(want) and set(map(int, got)) == code
