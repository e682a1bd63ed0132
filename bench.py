"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from chronolith.session import local_session

HEADLINE = [
    "ts_full_scan", "ts_range", "ts_range_reverse", "ts_latest", "ts_latest_index", "ts_at_index", "ts_count", "ts_previous", "ts_next_3",
    "ts_edges", "ts_states", "hist_previous_values", "seg_days_10", "seg_counts", "seg_of_position", "live_ingest", "update_resume",
    "store_update", "store_counts", "store_latest", "store_latest_few", "live_rollover_history", "rt_get_bucketed", "bitmap_counts",
    "store_round_trip", "rt_apply_changes", "rt_put", "rt_get", "rel_page", "rel_save_all", "bench_ordered_scan", "bench_point_lookups", "bench_latest_as_of",
]


def main() -> None:
    from chronolith.plans.queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    QUERIES["ts_count"](spark, sf_dir).collect()  # start-up isn't timed
    taken = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        taken[name] = round(time.perf_counter() - start, 3)
    size = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": float(size[1]) if size else None}))
    spark.stop()


if __name__ == "__main__":
    main()
