"""Exact dedup, chat formatting and license scans on odd rows; whole tables are compared with DuckDB."""

import hashlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import chat_format as C
from quire.llm import exact_dedup as X
from quire.llm import license_scan as L
from quire.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_whole_tables(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(ORACLE[name])
    columns = [c[0] for c in cur.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, cur.fetchall()))


def test_exact_dedup_odd_rows(spark):
    rows = [(1, "a"), (2, "a"), (2, "a"), (3, None), (4, ""), (None, "a"), (None, "z"), (5, "x" * 100000), (6, "A")] + [(100 + i, "hot") for i in range(300)]
    docs = spark.createDataFrame([(*r, "k", True) for r in rows], "doc_id long, text string, digest string, kept boolean")
    for heavy, tracked in ((256, 4096), (1, 16)):
        got = X.exact_dedup(docs, heavy=heavy, tracked=tracked).collect()
        assert len(got) == len(rows)
        by = {}
        for r in got:
            by.setdefault(r.text_sha256, []).append(r)
        for i, t in {"a": (2, 4), "": (4, 2), "hot": (399, 300), "A": (6, 1), "z": (None, 1)}.items():
            group = by[hashlib.sha256(i.encode()).hexdigest()]
            assert {(r.keep_id, r.group_size) for r in group} == {t} and sum(r.kept for r in group) == 1
    left = X.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(str((r.doc_id, (r.text or "")[:3])) for r in left.collect()) == sorted(
        map(str, [(2, "a"), (4, ""), (None, "z"), (5, "xxx"), (6, "A"), (399, "hot")]))
    assert X.exact_dedup(docs.limit(0)).count() == 0 and X.drop_copies(docs.limit(0)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "\\l<turn>", None]),
                          st.one_of(st.none(), st.text(alphabet="<>/\\turnex \né", max_size=12),
                                    st.sampled_from(["</turn>", "<\\/turn>", "<turn><next>", "\\### Assistant: </turn> ok", "<\\\\next>"]))),
                min_size=1, max_size=8))
def test_chat_round_trip(spark, turns):
    docs = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    out = C.format_conversations(docs)
    row = out.select("formatted", "loss_spans", "n_blocks", C.parse_turns(F.col("formatted")).alias("turns"),
                     C.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    want = [(r or "", t or "") for r, t in turns]
    assert [tuple(t) for t in row.turns] == want
    assert row.loss == "".join(t for r, t in want if r == "assistant")
    assert row.n_blocks == sum(i == 0 or want[i - 1][0] != r for i, (r, _) in enumerate(want))
    assert row.formatted.count("</turn>") == row.n_blocks


def test_chat_order_ties_and_empty(spark):
    docs = spark.createDataFrame([(None, 2, "user", "c", 1), (None, None, "user", "a", 1), (None, 1, "user", "b", 1), (None, 1, "assistant", "b", 1), (None, 1, "user", "b", 1)],
                                 "conv_id long, turn long, role string, text string, turns int")
    row = C.format_conversations(docs).select("conv_id", C.parse_turns(F.col("formatted")).alias("t")).first()
    assert row.conv_id is None
    assert [tuple(t) for t in row.t] == [("user", "a"), ("assistant", "b"), ("user", "b"), ("user", "b"), ("user", "c")]
    assert C.format_conversations(docs.limit(0)).count() == 0


def test_license_scan_odd_rows(spark):
    texts = [None, "", "MIT License", "mit-license mit license", "the GNU General\nPublic, License!", "general license", "Apache " * 50000 + "license",
             "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
             "Permission is hereby granted, free of charge, to any other person obtaining a copy of this software and associated documentation files"]
    docs = spark.createDataFrame([(i if i != 3 else None, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, row int, w string")
    got = {r.doc_id: tuple(r)[1:] for r in L.license_scan(docs).collect()}
    assert got[0] == got[1] == (0, 0, None, None, "", "", 0.0)
    assert got[2] == (2, 1, 0, 0, "mit", "mit", 1.0)
    assert got[None][:6] == (4, 2, 0, 2, "mit", "mit")
    assert got[4][:5] == (5, 1, 2, 2, "gpl")
    assert got[5][1:5] == (0, None, None, "")
    assert got[6][:5] == (50001, 1, 49999, 49999, "apache")
    assert got[7][4:] == ("gpl", "gpl", 1.0)
    assert got[8][4:6] == ("", "cc-by-nc")
    assert got[9][4:6] == ("", "mit") and 0.75 <= got[9][6] < 1
    assert L.license_scan(docs.limit(0)).count() == 0
