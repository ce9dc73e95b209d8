"""Catalog invariants: upsert rules, idempotence, sticky state, interactions,
versioned store."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quire.operators import catalog as C
from quire.sinks import catalog_store as CS


def _papers(spark, rows):
    return spark.createDataFrame(rows, "paper_id string, title string, comment string, date_added string")


def test_upsert_rules(spark):
    cat = C.catalog_from_papers(_papers(spark, [("1", "old", "c", "2024-01-01"), ("2", "keep", None, "2024-01-02")]))
    cat = cat.withColumn("is_favourite", F.col("paper_id") == "1").withColumn("thumbnail", F.lit("t.png"))
    inc = spark.createDataFrame([("1", "new-a", 1), ("1", "new-b", 2), ("3", "fresh", 1)],
                                "paper_id string, title string, pos int")
    out = {r.paper_id: r for r in C.upsert_catalog(cat, inc, "2024-02-01").collect()}
    assert out["1"].title == "new-b"                      # last in batch wins
    assert out["1"].comment is None                       # missing field replaced by null
    assert out["1"].date_added == dt.date(2024, 1, 1)     # first date kept
    assert out["1"].is_favourite and out["1"].thumbnail == "t.png"   # sticky state
    assert out["2"].title == "keep"
    assert out["3"].date_added == dt.date(2024, 2, 1) and out["3"].is_favourite is False


def test_upsert_idempotent(spark):
    cat = C.catalog_from_papers(_papers(spark, [("1", "a", "c", "2024-01-01")]))
    inc = spark.createDataFrame([("1", "b", 1), ("2", "c", 2)], "paper_id string, title string, pos int")
    once = C.upsert_catalog(cat, inc, "2024-02-01")
    twice = C.upsert_catalog(once, inc, "2024-02-01")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_toggle_twice_is_identity(spark):
    cat = C.catalog_from_papers(_papers(spark, [("1", "a", None, "2024-01-01")]))
    ev = spark.createDataFrame([(1, "1", "favourite", None), (2, "1", "favourite", None),
                                (3, "1", "note", "x"), (4, "1", "note", "")],
                               "seq long, paper_id string, action string, note string")
    r = C.apply_interactions(cat, C.fold_interactions(ev)).first()
    assert r.is_favourite is False and r.favourite_note == ""   # empty note allowed, last wins


def test_validate_strict_raises(spark):
    bad = spark.createDataFrame([("1", None)], "paper_id string, title string")
    valid, rejected = C.validate_papers(bad)
    assert valid.count() == 0 and rejected.first().reject_reason == "missing_title"
    strict, _ = C.validate_papers(bad, strict=True)
    try:
        strict.collect()
        raise AssertionError("strict validation should fail")
    except Exception as e:  # noqa: BLE001
        assert "invalid paper" in str(e)


def test_set_if_null_first_wins(spark):
    cat = spark.createDataFrame([("1", None), ("2", "kept")], "paper_id string, code_url string")
    upd = spark.createDataFrame([("1", "b", 2), ("1", "a", 1), ("2", "z", 0)], "paper_id string, value string, pos int")
    out = dict(C.set_if_null(cat, upd, "code_url").collect())
    assert out == {"1": "a", "2": "kept"}


def test_versioned_store_rewrites_touched_dates_only(spark, tmp):
    root = f"{tmp}/catalog"
    first = spark.createDataFrame([("1", "a", 1), ("2", "b", 2)], "paper_id string, title string, pos int")
    assert CS.upsert(spark, root, first, "2024-01-01") == 1
    second = spark.createDataFrame([("9", "z", 1)], "paper_id string, title string, pos int")
    assert CS.upsert(spark, root, second, "2024-01-02") == 2
    third = spark.createDataFrame([("1", "a2", 1)], "paper_id string, title string, pos int")
    assert CS.upsert(spark, root, third, "2024-01-03") == 3
    cur = {r.paper_id: (r.title, str(r.date_added)) for r in CS.read_catalog(spark, root).collect()}
    assert cur == {"1": ("a2", "2024-01-01"), "2": ("b", "2024-01-01"), "9": ("z", "2024-01-02")}
    # commit 3 opened and rewrote the file of paper 1 only
    assert [(r.v, r.n_live, r.n_opened, r.n_rewritten) for r in CS.history(spark, root).orderBy("v").collect()] == [(1, 0, 0, 0), (2, 1, 0, 0), (3, 2, 1, 1)]
    assert {r.paper_id for r in CS.read_catalog(spark, root, since="2024-01-02").collect()} == {"9"}
    assert {r.paper_id: r.title for r in CS.read_catalog(spark, root, version=2).collect()} == {"1": "a", "2": "b", "9": "z"}


def test_failed_commit_is_invisible_and_not_reused(spark, tmp):
    root = f"{tmp}/catalog"
    first = spark.createDataFrame([("1", "a", 1)], "paper_id string, title string, pos int")
    CS.upsert(spark, root, first, "2024-01-01")
    # a crashed commit 2: data files written, no commit-log row
    orphan = C.catalog_from_papers(spark.createDataFrame([("1", "BROKEN", "2024-01-01")],
                                                         "paper_id string, title string, date_added string"))
    orphan.write.parquet(f"{root}/data/00000002-crashed")
    assert {r.title for r in CS.read_catalog(spark, root).collect()} == {"a"}
    assert CS.next_version(spark, root) == 2
    CS.upsert(spark, root, spark.createDataFrame([("1", "b", 1)], "paper_id string, title string, pos int"),
              "2024-01-02")
    assert [(r.paper_id, r.title) for r in CS.read_catalog(spark, root).collect()] == [("1", "b")]


def test_many_commits_states_streams_compaction_and_pruning(spark, tmp, monkeypatch):
    monkeypatch.setattr(CS, "CHECKPOINT_EVERY", 3)
    root, schema = f"{tmp}/catalog", "paper_id string, title string, pos int"
    for n in range(8):
        rows = [(f"p{n}", "new", 1), (None, "no id", 1), (f"q{n}", None, 1)] + [("shared", f"v{n}", 1)] * (n % 4 == 3)
        batch = spark.createDataFrame(rows, schema)
        assert CS.upsert(spark, root, batch, "2024-01-01", "s", n) == n + 1
        assert CS.upsert(spark, root, batch, "2024-01-01", "s", n) == n + 1       # delivered twice
        assert CS.head(spark, root) == n + 1
        if n == 1:
            CS.snapshot(spark, root, "2024-01-05")
        if n == 4:
            CS.snapshot(spark, root, "2024-03-01")
    titles = lambda df: {r.paper_id: r.title for r in df.collect()}
    want = {f"p{n}": "new" for n in range(8)} | {"shared": "v7"}
    assert titles(CS.read_catalog(spark, root)) == want
    assert CS.upsert(spark, root, spark.createDataFrame([("late", "x", 1)], schema), "2024-01-01", "s", 0) == 8   # known from a state
    assert CS.rejected(spark, root).groupBy("reject_reason").count().count() == 2 and CS.rejected(spark, root).count() == 16
    n_files = CS.live_files(spark, root).count()
    assert CS.compact(spark, root) == 9 and CS.live_files(spark, root).count() < n_files
    assert titles(CS.read_catalog(spark, root)) == want
    assert titles(CS.read_catalog(spark, root, version=4))["shared"] == "v3"
    done = CS.prune(spark, root, "2024-03-02").first()
    assert (done.n_pruned, done.n_kept) == (1, 1) and done.n_files_deleted > 0
    assert titles(CS.read_snapshot(spark, root, "2024-03-01"))["shared"] == "v3"
    assert titles(CS.read_catalog(spark, root)) == want
    with pytest.raises(ValueError):
        CS.read_snapshot(spark, root, "2024-01-05")
    assert CS.prune(spark, root, "2024-03-02").first().n_files_deleted == 0


def test_bitmaps_admit_every_id_and_few_others(spark, tmp):
    root = f"{tmp}/catalog"
    rows = spark.range(3000).select(F.format_string("%06d", F.col("id") * 2).alias("paper_id"), F.lit("t").alias("title"))
    CS.upsert(spark, root, rows, "2024-01-01")
    files = CS.live_files(spark, root)
    parts = spark.range(12).select(F.format_string("%06d", F.col("id") * 500).alias("paper_id"))
    assert CS.files_that_may_hold(files, parts).count() >= 1
    for odd in range(1, 40, 2):  # inside the range, in no file: mostly denied by the bitmap
        one = spark.createDataFrame([(f"{odd:06d}",)], "paper_id string")
        hit = CS.files_that_may_hold(files, one).count()
        if not hit:
            break
    assert hit == 0
    assert CS.files_that_may_hold(files, spark.createDataFrame([("999999",), (None,)], "paper_id string")).count() == 0


def test_two_writers(spark, tmp):
    root = f"{tmp}/catalog"
    CS.upsert(spark, root, spark.createDataFrame([("1", "a")], "paper_id string, title string"), "2024-01-01")
    with pytest.raises(RuntimeError):
        CS._put(spark, spark.createDataFrame([], CS.LOG), root, "v=1")
