"""The pipeline against plain Python, stage by stage."""

import corpus_pipeline as P
import numpy as np
import public_tokenizers
import test_near_dedup
import test_tokens

from quire.llm import packing, suffix_dedup
from quire.llm.common import documents, written

SF = "/root/testdata/sf0.001"


def test_stages_equal_plain_python(spark):
    docs = documents(spark, SF)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = {}
    for name, stage in P.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        columns = docs.columns
        docs = written(stage(spark, docs, SF), f"test-{name}")
        rows = docs.collect()
        if name != "packing":
            assert docs.columns == columns == ["doc_id", "text", "lang", "source", "n_chars"]
            after = {r.doc_id: r for r in rows}
            assert len(after) == len(rows)
        out[name] = after = rows if name == "packing" else after
        ids = sorted(before)
        if name == "quality":
            assert all(before[k] == after[k] for k in after)
            right = [(k in after) == bool(q) for k, q in labels.items() if k in before]
            assert np.mean(right) > 0.95
        elif name == "exact_dedup":
            best = {}
            for k in ids:
                best[before[k].text] = k
            assert sorted(after) == sorted(best.values()) and all(before[k] == after[k] for k in after)
        elif name == "near_dedup":
            want = test_near_dedup.brute_force([before[k].text for k in ids], 5)
            assert sorted(after) == [ids[i] for i, (_, least) in enumerate(want) if i == least]
        elif name == "suffix_dedup":
            texts = [before[k].text.encode() for k in ids]
            for k, t, gone in zip(ids, texts, suffix_dedup.brute_force(texts, P.PASSAGE_BYTES)):
                edges = [0, *(x for run in gone for x in run), len(t)]
                assert after[k].text == b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2])).decode(errors="ignore")
                assert after[k].n_chars == len(after[k].text)
        else:
            test_tokens.check_packing(rows, {k: before[k].text for k in ids})
    assert len(out["exact_dedup"]) < len(out["quality"]) and len(out["near_dedup"]) < len(out["exact_dedup"])


def test_run_is_the_stages_and_odd_tables_pass(spark):
    rows = [(None, None, "x", "s", None), (1, "", "x", "s", 0), (2, "plain words " * 5, "en", "s", 1), (2, "plain words " * 5, "en", "s", 1),
            (3, "long " * 30000, "en", "t", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.limit(0)):
        for name, stage in P.STAGES[1:]:
            some = written(stage(spark, some, SF), f"odd-{name}")
        assert some.columns[:2] == ["doc_id", "start"]
        some.count()
    assert P.ORACLE_SQL is None and list(P.QUERIES) == ["pipeline"]
