"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is materialised with the ``noop`` sink (the whole plan runs, nothing
is collected to the driver): one warm-up run, then the median of
``BENCH_REPS`` runs. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quire.plans import QUERIES  # noqa: E402
from quire.session import get_spark  # noqa: E402

HEADLINE = [
    "flagship", "triage", "stage1_candidates", "judge_by_terms", "upsert_catalog", "sectioned_view",
    "daily_view", "balanced_batches_by_date", "enrich_links", "card_links", "coverage",
    "parse_entries", "parse_abs_pages", "listing_ids_by_date", "agreement_matrix", "compare_models",
    "apply_interactions", "collapse_ws", "stream_interactions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = get_spark(f"local[{cpus}]", cpus)
    spark.conf.set("spark.sql.shuffle.partitions", str(cpus))
    times, failed = {}, {}
    for name in names:
        run = []
        try:
            for i in range(reps + 1):
                t0 = time.perf_counter()
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                if i:
                    run.append(time.perf_counter() - t0)
            times[name] = round(statistics.median(run), 3)
        except Exception as e:  # noqa: BLE001 - report the failure, keep measuring the rest
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "sum_median_query_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": sf, "cpus": cpus, "reps": reps}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
