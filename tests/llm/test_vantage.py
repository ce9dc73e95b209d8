"""Vantage-point trees against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import vantage as V

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, score string"


def brute_force(rows, k=10):
    good = [(i, r[0], np.array(r[1], np.float64)) for i, r in enumerate(rows)
            if r[0] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    out = []
    for i, q, x in good:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), v) for j, v, y in good if j != i and len(x) == len(y))[:k]
            out += [(q, rank, v, round(d, 9)) for rank, (d, v) in enumerate(near, 1)]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in df.collect())


def odd_rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 5))
    rows = [(i, (centres[rng.integers(6)] + 0.1 * rng.normal(size=5)).tolist(), "s") for i in range(1500)]
    rows += [(10_000 + i, rows[0][1], "copy") for i in range(400)]      # equal vectors: ties
    rows += [(20_000 + i, rng.normal(size=3).tolist(), None) for i in range(104)]  # another length
    rows += [(30_000, [1.0], "alone"), (None, [1.0] * 5, "no id"), (40_000, None, ""), (40_100, [], ""), (40_200, [0.0] * 5, ""), (40_300, [1.0, None, 1.0, 1.0, 1.0], ""),
             (40_400, [float("nan")] * 5, ""), (40_500, [float("inf")] * 5, ""), (100, rows[100][1], "repeated row"), (50_000, [7.0] * 4, "pair"), (50_001, [8.0] * 4, "")]
    return rows


@pytest.mark.parametrize("shard_bytes,sample_bytes,leaf", [(4 << 20, 8 << 20, 128), (4000, 8 << 20, 16), (4000, 20_000, 8), (1000, 2000, 4)])
def test_factor_one_is_exact(spark, shard_bytes, sample_bytes, leaf):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = V.nearest(df, factor=1.0, shard_bytes=shard_bytes, sample_bytes=sample_bytes, leaf=leaf)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert found(got) == brute_force(rows)


def test_recall_of_the_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, got = brute_force(rows), found(V.op12_vantage_neighbours(spark, SF))
    assert len(set(got) & set(want)) >= 0.9 * len(want)
    assert len(got) == len(want) and [r[:2] for r in got] == [r[:2] for r in want]


def test_small_shards_keep_recall(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = found(V.nearest(spark.read.parquet(f"{SF}/embeddings.parquet"), shard_bytes=16_000, leaf=8))
    want = {r[0::2][:2] for r in brute_force(rows)}
    assert len({(r[0], r[2]) for r in got} & want) >= 0.9 * len(want)


def test_empty(spark):
    assert V.nearest(spark.createDataFrame([], SCHEMA)).collect() == []
    assert V.nearest(spark.createDataFrame([(100, [1.0], "x")], SCHEMA)).collect() == []


def test_skips_are_bounds():
    rng = np.random.default_rng(9)
    x, q = rng.normal(size=(800, 4)), rng.normal(size=(50, 4))
    root, leaves = V.build(x, 20)
    radius = np.full(50, 0.7)
    rows, at = V.leaves_within(root, q, radius, 1.0)
    member = V.leaf_of(root, x)
    near = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2)) <= 0.7
    assert leaves > 10 and len(rows) < 50 * leaves
    assert set(zip(*(m.tolist() for m in (np.nonzero(near)[0], member[np.nonzero(near)[1]])))) <= set(zip(rows.tolist(), at.tolist()))


def test_is_query_may_read_other_columns(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], "ask" if i == 3 else None) for i in range(30)], SCHEMA)
    got = V.nearest(df, is_query=F.col("score") == "ask", k=2).collect()
    assert [tuple(r) for r in sorted(got)] == [(3, 1, 2, 1.0), (3, 2, 4, 1.0)]
