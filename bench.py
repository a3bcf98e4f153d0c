"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables and BENCH_CPUS the local cores. Every query runs
to its last row into Spark's no-op sink, which computes all columns and keeps
none. A first untimed query warms the session up.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from freshet.cases.registry import all_queries  # noqa: E402
from freshet.session import local_session  # noqa: E402

#: Queries timed, with the table whose rows they work through.
HEADLINE = {
    "masked_lineitem": "lineitem", "masked_customer_by_nation": "customer", "mask_audit": "customer",
    "mask_name": "part", "mask_email": "customer", "mask_date": "orders", "mask_datetime": "events",
    "mask_text": "documents", "mask_string": "documents", "mask_phone": "documents", "mask_place": "orders",
    "mask_url": "pages", "mask_integer": "events", "mask_float": "orders", "mask_money": "orders",
    "mask_zero": "documents", "mask_plan_status": "part", "publish_masked": "customer",
    "row_scrub": "conversations", "log_redact": "documents", "log_tail": "documents", "log_tail_lines": "documents",
    "snapshot_latest": "pages", "snapshot_matches_by_repository": "pages", "snapshot_not_covered": "orders",
    "storage_plan": "orders", "carry_table_plan": "orders", "migration_result": "lineitem",
    "failure_streaks": "orders", "fleet_removable": "orders", "fleet_refresh_due": "orders", "fleet_diff": "orders",
    "condition_history": "events", "spec_changes": "events", "spec_changes_stream": "events", "run_metrics": "events",
    "verify_health": "lineitem", "progress_totals": "events", "progress_totals_stream": "events",
    "latest_payloads": "events", "latest_payloads_stream": "events", "stall_watch": "events", "stall_watch_stream": "events",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else list(HEADLINE)
    spark = local_session(tempfile.mkdtemp(prefix="freshet-bench-"), "freshet-bench", cores=cores, memory=os.environ.get("BENCH_MEMORY", "16g"))
    runs = all_queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        runs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("masked_customer_by_nation")
    timings = {name: run(name) for name in names}
    tables = {HEADLINE[n] for n in names if n in HEADLINE}
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in tables}
    print(json.dumps({
        "metric": "freshet headline queries, total wall clock",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "rows_per_sec": {n: round(rows[HEADLINE[n]] / timings[n]) for n in names if n in HEADLINE},
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
