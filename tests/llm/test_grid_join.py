"""The grid order join against all pairs in double precision."""

import numpy as np

from quire.llm import grid_join as G

SF = "/root/testdata/sf0.001"


def brute_force(ids, vectors, cosine):
    good = [i for i, v in enumerate(vectors) if v is not None and None not in v and np.isfinite(v).all() and any(v)]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(ids)
    x = np.array([vectors[i] for i in good], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= cosine
    for a in range(len(good)):
        for b in range(a):
            if near[a, b]:
                i, j = good[a], good[b]
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    least = {}
    for i, k in enumerate(ids):
        r = find(i)
        least[r] = k if r not in least else min(least[r], k)
    return [(k, links[i], least[find(i)], least[find(i)] == k) for i, k in enumerate(ids)]


def cases():
    rng = np.random.default_rng(4)
    out = []
    for _ in range(25):
        c = rng.normal(size=12)
        out += [(c + rng.normal(size=12) * rng.uniform(0.05, 0.35)).tolist() for _ in range(rng.integers(1, 12))]
    out += rng.normal(size=(60, 12)).tolist()
    out = [np.float32(v).tolist() for v in out]
    return out + [None, [0.0] * 12, [float("nan")] * 12, [float("inf")] + [1.0] * 11, [None] + [1.0] * 11, out[0], out[0], [1e-30] * 12, [1e30] * 12]


def test_all_pairs_small_table(spark):
    vectors = cases()
    ids = [(7 * i) % len(vectors) for i in range(len(vectors))] if len(vectors) % 7 else list(range(len(vectors)))
    docs = spark.createDataFrame([(k, v, 1, "x") for k, v in zip(ids, vectors)], "vec_id long, embedding array<float>, node int, box string")
    want = sorted(brute_force(ids, vectors, 0.9))
    assert sum(n for _, n, _, _ in want) > 100
    for block in (2048, 16):
        assert sorted(tuple(r) for r in G.grid_join(docs, block=block).collect()) == want


def test_skipping_is_exact_and_happens():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=12) + rng.normal(size=(64, 12)) * 0.02 for _ in range(8)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :4].copy()
    count, label = G.compare(x, None, axes, 0.9, part=32)
    near = np.triu(x @ x.T >= 0.9, 1)
    assert (count == near.sum(0) + near.sum(1)).all()
    a, b = G.compare(x[:200], x[200:], axes, 0.9, part=32)
    assert (a == np.concatenate((near[:200, 200:].sum(1), near[:200, 200:].sum(0)))).all()


def test_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, [1.0, 0.0]), (5, [2.0, 0.0]), (5, [3.0, 0.1]), (6, [0.0, 1.0]), (7, [1.0])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in G.grid_join(docs).collect())
    assert got == [(False, 5, 2, 5, True), (False, 5, 2, 5, True), (False, 6, 0, 6, True), (False, 7, 0, 7, True), (True, 0, 2, 5, False)]
    assert G.grid_join(docs.limit(0)).count() == 0


def test_op6_whole_table(spark):
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    want = sorted(brute_force([k for k, _ in rows], [list(v) for _, v in rows], 0.9))
    assert sorted(tuple(r) for r in G.op6_grid_join(spark, SF).collect()) == want


def test_each_length_is_joined(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.1, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [1.0]), (7, [])]
    got = G.grid_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 0, 6), (7, 0, 7)]


def test_blocks_are_not_shuffled_by_pairs(spark, monkeypatch):
    # spread evenly, so that all pairs of blocks are compared
    vectors = np.random.default_rng(2).normal(size=(400, 24))
    plans, real = [], G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in G.grid_join(docs, block=16).collect()) == brute_force(list(range(400)), vectors.tolist(), 0.9)
    compared = [p for p in plans if "xa#" in p]
    assert compared and not any("Exchange hashpartitioning" in p for p in compared)


def test_bound_by_the_leading_axes_loses_no_link():
    rng = np.random.default_rng(8)
    for shift in (0, 1.5):  # without and with a mean that makes most of the length
        x = np.concatenate([rng.normal(size=64) + rng.normal(size=(40, 64)) * s for s in (0.02, 0.2, 0.33, 1)] + [rng.normal(size=(300, 64))]) + shift
        x = G.unit_rows(x)
        axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
        near = x @ x.T >= 0.9
        for k in (1, 8, 32, 64):
            count, label = G.compare(x, None, axes[:, :k], 0.9, part=64)
            assert (count == near.sum(1) - 1).all()
            a, b = G.compare(x[:200], x[200:], axes[:, :k], 0.9, part=64)
            assert (a == np.concatenate((near[:200, 200:].sum(1), near[:200, 200:].sum(0)))).all()
