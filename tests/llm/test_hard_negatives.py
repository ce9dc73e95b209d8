"""Hard negatives against all pairs in plain Python, and the product against numpy's."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import hard_negatives as H
from quire.llm.vectors import Heaps

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, label string, anchor string"


def brute_force(rows):
    good = [(i, r[0], [math.floor(256 * c) for c in r[1]], str(r[2])) for i, r in enumerate(rows)
            if r[0] is not None and r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all()]
    out = []
    for i, a, x, label in good:
        if a % 100 == 0:
            scored = [(-sum(p * q for p, q in zip(x, y)), v, m, j) for j, v, y, m in good if j != i and len(y) == len(x)]
            scored.sort()
            for ps, p, _, _ in [s for s in scored if s[2] == label][:5]:
                window = [(ns, n) for ns, n, m, _ in scored if m != label and -80 * ps <= -100 * ns <= -100 * ps][:5]
                out += [(a, p, k, n, -ps, -ns) for k, (ns, n) in enumerate(window, 1)]
    return sorted(out)


def odd_rows():
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(5, 6))
    rows = [(i, (centres[rng.integers(5)] + 0.3 * rng.normal(size=6)).tolist(), str(rng.integers(4)), "x") for i in range(1200)]
    rows += [(5000 + i, rows[100][1], str(i % 3), None) for i in range(300)]  # equal vectors: ties
    rows += [(7000 + i, rng.normal(size=2).tolist(), "0", "") for i in range(102)]
    rows += [(8000, [0.0] * 6, "1", ""), (8100, None, "1", ""), (8200, [], "1", ""), (8300, [1.0] * 6, None, ""), (8400, [1.0, None, 1.0, 1.0, 1.0, 1.0], "1", ""),
             (8500, [float("nan")] * 6, "1", ""), (8600, [float("-inf")] * 6, "1", ""), (None, [1.0] * 6, "1", ""), (200, rows[200][1], rows[200][2], "again"),
             (9000, [3.0] * 9, "1", "alone"), (9100, [1.5] * 6, "new label", "")]
    return rows


@pytest.mark.parametrize("group_bytes,tile", [(16 << 20, (256, 1024)), (8000, (3, 7))])
def test_equals_all_pairs(spark, group_bytes, tile):
    rows = odd_rows()
    got = H.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(4), group_bytes=group_bytes, tile=tile)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute_force(rows)


def test_query(spark):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
            for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted(map(tuple, H.op13_hard_negatives(spark, SF).collect()))
    assert got and got == brute_force(rows)


def test_empty_no_anchor_and_too_large(spark):
    assert H.hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
    assert H.hard_negatives(spark.createDataFrame([(1, [1.0], "a", ""), (100, [1.0], "a", "")], SCHEMA), is_anchor=F.lit(None).cast("boolean")).collect() == []
    with pytest.raises(ValueError):
        H.hard_negatives(spark.createDataFrame([(100, [1e12], "a", ""), (1, [1e12], "a", "")], SCHEMA))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.integers(1, 40), st.integers(1, 8), st.integers(0, 2**32))
def test_strassen_is_exact(m, k, n, base, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-2**31, 2**31, (m, k)), rng.integers(-2**31, 2**31, (k, n))
    assert (H.strassen(a, b, base) == (a.astype(object) @ b.astype(object) + 2**63) % 2**64 - 2**63).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-3, 3), st.integers(0, 50)), max_size=40, unique_by=lambda e: e[2]), st.integers(1, 4), st.integers(0, 40))
def test_heaps_merge(entries, k, cut):
    def pushed(*parts):
        h = Heaps(4, k, np.int64)
        for part in parts:
            g, key, i = (np.array([e[f] for e in part], np.int64) for f in range(3))
            h.push(g, key, i, i)
        return h

    left, right, whole = pushed(entries[:cut]), pushed(entries[cut:]), pushed(entries)
    left.push(right.group, right.key, right.id, right.node)
    want = [e for g in range(4) for e in sorted((x for x in entries if x[0] == g), key=lambda x: x[1:])[:k]]
    for h in (left, whole):
        assert list(zip(h.group.tolist(), h.key.tolist(), h.id.tolist())) == want
