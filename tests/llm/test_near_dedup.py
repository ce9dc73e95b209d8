"""Near-duplicates against comparing all pairs of full sets."""

import random
import re

import pytest

from quire.llm import graph
from quire.llm import near_dedup as N
from quire.llm.graph import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_force(texts, k):
    """(set size, smallest reachable position) of each text."""
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def cases():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 5)))
    base = [[word() for _ in range(n)] for n in (12, 60, 60, 61, 200, 400)]
    texts = []
    for k in range(160):
        w = list(base[k % len(base)])
        for _ in range(rnd.randint(0, max(1, len(w) // 9))):
            w[rnd.randrange(len(w))] = word()
        texts.append(" ".join(w))
    return texts + [None, "", " \n", "One", "one", "two words", "TWO  words", "two words x", texts[0], "É one two", "é one two",
                    "w" * 3000, "w" * 3000 + " x y", "a\x1cb c", "a b c"]


def test_all_pairs_small_table(spark):
    texts = cases()
    docs = spark.createDataFrame([(i, t, "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, set string, n int")
    for k in (2, 5):
        got = {r.doc_id: r for r in N.near_dedup(docs, words=k).collect()}
        want = brute_force(texts, k)
        for i, (n, least) in enumerate(want):
            assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, least, i == least), (k, i)
        stay = N.drop_near_copies(docs, words=k)
        assert stay.columns == docs.columns
        assert sorted(r.doc_id for r in stay.collect()) == [i for i, (n, least) in enumerate(want) if i == least]


@pytest.mark.parametrize("rounds", [0, 1])
def test_leaders_and_pair_rounds_agree(spark, monkeypatch, rounds):
    texts = cases()[:80]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [least for _, least in brute_force(texts, 2)]
    monkeypatch.setattr(N, "ROUNDS", rounds)
    got = {r.doc_id: r.component_id for r in N.near_dedup(docs, words=2).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_repeated_rows_null_ids_and_empty_table(spark):
    t = "a b c d e f g h"
    docs = spark.createDataFrame([(None, t), (3, t), (3, t), (3, "other words here"), (9, None), (9, None)], "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in N.near_dedup(docs, words=2).collect()))
    assert got == [(False, 3, 2, 3, True), (False, 3, 7, 3, True), (False, 3, 7, 3, True), (False, 9, 0, 9, True), (False, 9, 0, 9, True), (True, 0, 7, 3, False)]
    assert sorted(str(r.doc_id) for r in N.drop_near_copies(docs, words=2).collect()) == ["3", "3", "9"]
    assert N.near_dedup(docs.limit(0), words=2).count() == 0


def test_op7_whole_table(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want = brute_force([t for _, t in docs], 2)
    got = {r.doc_id: r for r in N.op7_near_dedup(spark, SF).collect()}
    for (k, _), (n, least) in zip(docs, want):
        assert (got[k].n_shingles, got[k].component_id, got[k].kept) == (n, docs[least][0], docs[least][0] == k)
    assert sum(not r.kept for r in got.values()) > 5


def test_components_of_a_path_and_a_star(spark):
    path, star = [(i, i + 1) for i in range(60)], [(100, i) for i in range(101, 160)]
    got = components(spark.createDataFrame(path + star + [(200, 200)], "a long, b long")).collect()
    roots = {r.node: r.root for r in got}
    assert set(roots) == set(range(61)) | set(range(100, 160))
    assert len({roots[i] for i in range(61)}) == 1 and len({roots[i] for i in range(100, 160)}) == 1
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_frequent_values_without_common_neighbours_are_listed(spark):
    # 12 of the 24 least values are shared, each followed by one of the class alone
    alone = lambda c, i: 1000 * i + 1 + c
    sketch = lambda c: [v for i in range(12) for v in (1000 * i, alone(c, i))] + [alone(c, i) for i in range(20, 44)]
    n = 72
    classes = spark.createDataFrame([(c, 60, sketch(c)) for c in range(n)], "node long, n long, sketch array<bigint>")
    sizes = [r["count"] for r in N._postings(classes).groupBy("value").count().collect()]
    assert max(sizes) == n


def test_links_of_one_long_list(spark):
    rnd = random.Random(11)
    base = [f"w{i}" for i in range(70)]
    texts = []
    for _ in range(60):
        w = list(base)
        for i in rnd.sample(range(70), rnd.randint(1, 4)):
            w[i] = f"x{rnd.randrange(10 ** 6)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in N.near_dedup(docs, words=2).collect()}
    assert [got[i] for i in range(len(texts))] == [least for _, least in brute_force(texts, 2)]


def test_edited_copies_propose_few_pairs_and_lose_no_link(spark, monkeypatch):
    # copies edited so far that many do not link with their source; there are 7140 pairs
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(100):
        w = list(base)
        for i in rnd.sample(range(120), rnd.randint(1, 16)):
            w[i] = f"x{rnd.randrange(10 ** 6)}"
        texts.append(" ".join(w))
    for k in range(20):  # edited once more: these link with a copy, if not with the source
        w = texts[k].split()
        w[rnd.randrange(120)] = "again"
        texts.append(" ".join(w))
    proposed, within, differences = [], N._pairs_within, N._shared_differences
    count = lambda pairs: proposed.append(pairs.count()) or pairs
    monkeypatch.setattr(N, "SHORT", 2)
    monkeypatch.setattr(N, "_pairs_within", lambda *a: count(within(*a)))
    monkeypatch.setattr(N, "_shared_differences", lambda *a: count(differences(*a)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in N.near_dedup(docs, words=2).collect()}
    want = [least for _, least in brute_force(texts, 2)]
    assert [got[i] for i in range(len(texts))] == want
    assert len(set(want)) > 10 and sum(proposed) < 7140 / 5


def test_rows_with_a_common_passage_are_not_listed_by_full_sets(spark, monkeypatch):
    # the passage is a third of each text, so that long lists hold all of them
    rnd = random.Random(7)
    passage = [f"p{i}" for i in range(42)]
    texts = [" ".join([*passage, *(f"x{rnd.randrange(10 ** 6)}" for _ in range(78))]) for _ in range(72)]
    texts += [t + " again" for t in texts[:4]]
    monkeypatch.setattr(N, "_full_sets", lambda words: pytest.fail("full sets were listed"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in N.near_dedup(docs, words=2).collect()}
    assert [got[i] for i in range(len(texts))] == [least for _, least in brute_force(texts, 2)]


@pytest.mark.parametrize("few", [0, 7, 10_000])
def test_few_edges_are_contracted_at_once(spark, monkeypatch, few):
    rnd, steps, real = random.Random(few), [], graph.written
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)]
    want = list(range(80))
    for a, b in edges:
        a, b = want[a], want[b]
        want = [min(a, b) if x in (a, b) else x for x in want]
    monkeypatch.setattr(graph, "FEW", few)
    monkeypatch.setattr(graph, "written", lambda df, name: steps.append(name) or real(df, name))
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {a: roots[a] for e in edges for a in e if e[0] != e[1]}
    assert roots == linked and all((roots[a] == roots[b]) == (want[a] == want[b]) for a in roots for b in roots)
    assert few < 60 or steps == ["edges", "roots"]


def test_texts_that_share_frequent_shingles_only_propose_few_pairs(spark, monkeypatch):
    # 900 shingles, each in about a tenth of the texts: nearly all of the 8385 pairs share one
    rnd = random.Random(9)
    texts = [" ".join(f"w{rnd.randrange(30)}" for _ in range(100)) for _ in range(120)]
    texts += [t.replace(" ", " once ", 1) for t in texts[:10]]
    proposed, within = [], N._pairs_within
    monkeypatch.setattr(N, "_pairs_within", lambda *a: proposed.append(within(*a).count()) or within(*a))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in N.near_dedup(docs, words=2).collect()}
    want = [least for _, least in brute_force(texts, 2)]
    assert [got[i] for i in range(len(texts))] == want
    assert len(set(want)) == 120 and sum(proposed) < 8385 / 10


def test_sets_that_reach_the_similarity_have_a_run_in_common(spark):
    rnd, sets = random.Random(6), []
    for k in range(5):  # four of five shingles, each one left out
        sets.append(([10 * k + 1000 * i for i in range(5)], [10 * k + 1000 * i for i in range(5) if i != k]))
    for _ in range(300):
        union = rnd.sample(range(10 ** 6, 10 ** 9), rnd.randint(6, 100))
        alone = rnd.sample(union, len(union) // 5)
        cut = rnd.randint(0, len(alone))
        sets.append(([v for v in union if v not in alone[:cut]], [v for v in union if v not in alone[cut:]]))
    classes = [(i, len(s), sorted(s)[:N.SKETCH]) for i, s in enumerate(x for pair in sets for x in pair)]
    found = {}
    for r in N._runs(spark.createDataFrame(classes, "node long, n long, sketch array<bigint>")).collect():
        assert r.n == classes[r.node][1]
        found.setdefault(r.node, set()).add(r.value)
    assert all(found[2 * k] & found[2 * k + 1] for k in range(len(sets)))
