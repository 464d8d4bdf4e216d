"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR: folder of input tables. BENCH_CPUS: local cores. BENCH_QUERIES:
comma-separated names, or "all". BENCH_REPEAT: runs per query, the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from freshet.plans.catalogue import QUERIES  # noqa: E402
from freshet.session import local_session  # noqa: E402

HEADLINE = [
    "compile_daily",
    "paired_yield_diff",
    "sum_strict",
    "hourly_mean",
    "quartiles",
    "box_stats",
    "join_full_chain",
    "row_number_long",
    "cumsum_strict_long",
    "rolling_mean_long",
    "fill_locf_long",
    "fill_linear_long",
    "fill_linear",
    "fill_regression",
    "top_half",
    "topk_group",
    "tidy_wide_year",
    "lm_simple",
    "lm_pvalue",
    "lm_table",
    "corr_cross",
    "cluster_zscore_quartiles",
    "assign_vectors",
    "som_fit",
    "permanova_f",
    "permanova_p",
    "figure_snow_vs_yield",
    "stream_hourly_mean",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    spark = local_session(cpus, "freshet-bench")
    # start the JVM's and the Python workers' machinery, and the table later analyses read
    QUERIES["paired_yield_diff"](spark, folder).write.format("noop").mode("overwrite").save()
    QUERIES["assign_cluster"](spark, folder).write.format("noop").mode("overwrite").save()
    QUERIES["count_share"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        runs = []
        for _ in range(repeat):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
    spark.stop()
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
