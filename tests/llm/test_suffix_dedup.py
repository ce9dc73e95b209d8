"""Suffix dedup against counting every string."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import suffix_dedup as S

SF = "/root/testdata/sf0.001"


def spans_of(spark, texts, length, **sizes):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    rows = {r.doc_id: r for r in S.remove_repeats(docs, length=length, **sizes).collect()}
    out = []
    for i, t in enumerate(texts):
        data, r = (t or "").encode(), rows[i]
        gone = [(x.start, x.stop) for x in r.removed]
        assert r.n_bytes == len(data)
        assert bytes(r.kept) == bytes(b for k, b in enumerate(data) if not any(a <= k < z for a, z in gone))
        out.append(gone)
    return out


def expect(texts, length):
    return S.brute_force([(t or "").encode() for t in texts], length)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6), st.binary(min_size=1, max_size=6)), min_size=2, max_size=9))
def test_intervals_give_all_occurrences(pairs):
    lefts, rights = [a for a, _ in pairs], [b for _, b in pairs]
    got = list(S.maximal_repeats(lefts, rights))
    for depth, members, extensions in got:
        shared = rights[members[0]][:depth]
        assert len(shared) == depth and set(members) == {i for i, r in enumerate(rights) if r[:depth] == shared}
        for i, e in zip(members, extensions):
            assert e == max(S.common(lefts[i], lefts[j]) for j in members if j != i)
    depths = {(d, tuple(sorted(m))) for d, m, _ in got}
    assert len(depths) == len(got)
    for i in range(len(rights)):
        for j in range(i):
            d = S.common(rights[i], rights[j])
            assert d == 0 or any(x == d and i in m and j in m for x, m, _ in got)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=5), st.text("ab", min_size=5, max_size=10)), min_size=2, max_size=40))
def test_extents_equal_all_pairs(pairs):
    lefts, rights = [a.encode() for a, _ in pairs], [b.encode() for _, b in pairs]
    got = S.extents(lefts, rights, 8, 1)
    for i in range(len(pairs)):
        met = [(S.common(lefts[i], lefts[j]), S.common(rights[i], rights[j])) for j in range(len(pairs)) if j != i]
        met = [(a, b) for a, b in met if a + b >= 8 and b >= 1]
        assert got[i] == (max([a for a, _ in met], default=0), max([b for _, b in met], default=0))


def cases():
    import random
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7)))
    passage = " ".join(word() for _ in range(25))
    texts = []
    for k in range(120):
        t = " ".join(word() for _ in range(rnd.randint(0, 40)))
        if k % 3 == 0:
            cut = rnd.randint(0, 60)
            t += passage[cut:cut + rnd.randint(10, 120)] + " ".join(word() for _ in range(rnd.randint(0, 20)))
        if k % 10 == 0:
            t += "be " * rnd.randint(5, 60)
        texts.append(t)
    return texts + [None, "", "x" * 39, "x" * 40, "x" * 300, texts[7], texts[7], texts[3] + "!" + texts[3], "ab" * 90]


def test_small_table_all_group_sizes(spark):
    texts = cases()
    want = expect(texts, 40)
    assert spans_of(spark, texts, 40) == want
    assert sum(map(bool, want)) > 30
    assert spans_of(spark, texts, 40, split_group=3) == want
    assert spans_of(spark, texts, 40, split_group=1, max_group=2) == want


def test_rows_without_id_repeats_and_empty_table(spark):
    t = "".join(chr(97 + i * i % 23) for i in range(100))
    docs = spark.createDataFrame([(None, t), (None, t), (4, "short"), (4, "other")], "doc_id long, text string")
    got = S.remove_repeats(docs, length=40).collect()
    assert sorted((str(r.doc_id), bytes(r.kept)) for r in got) == [("4", b"other"), ("4", b"short"), ("None", b""), ("None", b"")]
    assert S.remove_repeats(docs.limit(0), length=40).count() == 0


def test_op3_whole_table(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = dict(zip(docs, S.brute_force(list(docs.values()), S.LENGTH)))
    for r in S.op3_suffix_dedup(spark, SF).collect():
        gone, data = want[r.doc_id], docs[r.doc_id]
        kept = bytearray()
        at = 0
        for a, b in gone:
            kept += data[at:a]
            at = b
        kept += data[at:]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (
            len(data), sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept).hexdigest())
    assert any(want.values())
