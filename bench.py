"""Times of the headline queries, as one JSON line.

Each query is read out into a sink that keeps nothing (noop), once to warm up
and once timed."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "walk_tree", "glob_paths", "rule_match_last_wins", "grep_literal", "diff_trees", "diff_files", "merge_decide", "merge_text",
    "ancestors", "merge_base_pairs", "list_revisions", "blame_append_only", "locate_objects", "exact_dedup", "overlay_listing", "trace_summary", "json_runs_range_join",
)


def main() -> None:
    from arbor.plans import registry
    from arbor.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "16g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = registry.queries(), {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
