"""Time the headline queries: one JSON line on standard output.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Every query runs in full
(all rows are produced, into a sink that drops them); one warm-up query comes first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablewise.session import local_session  # noqa: E402
from tablewise.workloads import all_queries  # noqa: E402

HEADLINE = (
    "list_page", "list_deep_page", "list_search", "facet_counts", "related_all", "related_top5", "metric_all_ops",
    "recent_rows", "trend_month", "distribution_top6", "profile_columns", "profile_top_values", "profile_duplicate_rows",
    "stride_sample", "missing_markers", "format_predicates", "infer_types", "infer_entities", "link_overlap", "links_final",
    "clean_rows", "clean_report", "merge_fill", "read_files", "validate_split", "typed_cells", "widen_enums", "apply_creates",
    "apply_updates", "apply_deletes", "current_version", "version_risks",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_MEMORY", "12g"))
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = all_queries(), {}
    queries["facet_counts"](spark, sf_dir).collect()
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
