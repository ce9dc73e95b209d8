"""Stream == batch over several micro-batches; ingest is exactly-once."""

from pyspark.sql import functions as F

from quire.operators.catalog import fold_interactions
from quire.sinks import catalog_store as CS
from quire.sources import fixtures as X
from quire.streaming import streams as ST


def test_stream_interactions_equals_batch(spark, sf, tmp):
    ev = X.table(spark, sf, "events")
    ev.repartition(5).write.parquet(f"{tmp}/events")            # five files -> five micro-batches
    src = (spark.readStream.schema(ST.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/events"))
    got = ST.run_available(ST.stream_interactions(ST.interactions_from_events(src)), "t_inter",
                           checkpoint=f"{tmp}/ck")
    exp = fold_interactions(ST.interactions_from_events(ev), key="doc_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))


def test_three_drops_on_one_checkpoint(spark, sf, tmp):
    ev = X.table(spark, sf, "events")
    run = lambda: sorted(map(tuple, ST.run_available(
        ST.stream_interactions(ST.interactions_from_events(spark.readStream.schema(ST.EVENTS).parquet(f"{tmp}/ev"))),
        "t", "update", f"{tmp}/ck", key="doc_id").collect()))
    for drop in range(3):
        ev.filter(F.col("event_id") % 3 == drop).write.mode("append").parquet(f"{tmp}/ev")
        got = run()
        seen = ev.filter(F.col("event_id") % 3 <= drop)
        assert got == sorted(map(tuple, fold_interactions(ST.interactions_from_events(seen), key="doc_id").collect()))
    assert run() == got                                                     # no new files: the same state
    # a micro-batch writes the keys it changed, not all state
    one = ev.filter(F.col("event_type") == "click").limit(1)
    one.write.mode("append").parquet(f"{tmp}/ev")
    run()
    assert spark.read.parquet(f"{tmp}/ck-out/epoch=3").count() == 1


def test_stream_dedupe_and_daily_counts(spark, sf, tmp):
    ev = X.table(spark, sf, "events")
    ev.union(ev.limit(100)).repartition(3).write.parquet(f"{tmp}/dup")   # replayed events
    src = spark.readStream.schema(ST.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/dup")
    out = ST.run_available(ST.stream_dedupe(src, "event_id", "40 days"), "t_dedupe", "append", f"{tmp}/ck1")
    assert out.count() == ev.count()
    src2 = spark.readStream.schema(ST.EVENTS).parquet(f"{tmp}/dup")
    days = ST.run_available(ST.stream_daily_counts(src2), "t_days", "complete", f"{tmp}/ck2")
    exp = ev.union(ev.limit(100)).groupBy(F.to_date("ts").alias("day")).count()
    assert sorted(map(tuple, days.collect())) == sorted(map(tuple, exp.collect()))


def test_stream_ingest_rerun_processes_nothing(spark, sf, tmp):
    recs = X.paper_records(spark, sf).select(F.col("paper_id").alias("arxiv_id"), "title")
    recs.write.json(f"{tmp}/landing/d1")
    ST.stream_ingest(spark, f"{tmp}/landing/d1", f"{tmp}/cat", "2024-02-01", checkpoint=f"{tmp}/ck")
    v1 = CS.next_version(spark, f"{tmp}/cat")
    ST.stream_ingest(spark, f"{tmp}/landing/d1", f"{tmp}/cat", "2024-02-01", checkpoint=f"{tmp}/ck")
    assert CS.next_version(spark, f"{tmp}/cat") == v1                # no new commit
    assert CS.read_catalog(spark, f"{tmp}/cat").count() == recs.count()


def test_streams_do_not_depend_on_session_time_zone(spark, sf):
    import __spark_entry__ as E
    base = {n: sorted(map(tuple, E.queries()[n](spark, sf).collect()))
            for n in ("stream_daily_counts", "stream_interactions")}
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        for n, rows in base.items():
            assert sorted(map(tuple, E.queries()[n](spark, sf).collect())) == rows, n
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
