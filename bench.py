"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the
cores. BENCH_QUERIES may list queries, separated by commas, or be "all".
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import all_queries  # noqa: E402
from checks.run_checks import local_session  # noqa: E402

HEADLINE = [
    "a5_demand_grid", "a4_od_hour_trips", "a6_od_matrix", "a15_compare_hours", "a19_box_statistics",
    "j1_attach_centroids", "j2_box_zone_scattered", "j4_compare_groups", "j7_assign_dates", "j12_rows_by_part",
    "w1_sliding_windows", "w2_zone_windows", "w3_day_pairs", "w8_global_rank",
    "g1_sample_exact_share", "g3_equal_frequency", "g4_perturb_counts", "g5_cap_groups", "g6_even_days",
    "g8_jitter", "q1_quantile_map",
    "m2_fit_mixture", "m3_assign_clusters", "m5_draw_trips", "m8_train_series", "m12_train_zone_model",
    "m14_train_kinds", "d2_trip_clusters", "e2_errors", "e5_divergence", "t1_sort_by_time",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8)))
    wanted = os.environ.get("BENCH_QUERIES", "")
    queries = all_queries()[0]
    names = list(queries) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = local_session(cores)
    queries["a1_trips_per_hour"](spark, folder).collect()   # start the session's workers
    times = {}
    for name in names:
        began = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
