"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with a no-op write (every row computed, no
collect). Prints one JSON line:
{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cwescope.plans.catalog import REGISTRY  # noqa: E402
from cwescope.session import local_session  # noqa: E402

HEADLINE = [
    "compare_tools", "merge_findings", "recall_by_class_tool",
    "evaluate_run", "tune_thresholds", "roc_auc_macro", "prf_averaged", "decode_labels",
    "corpus_stats", "project_profile", "split_stratified", "split_sequential", "parse_git_url",
    "class_distribution",
    "code_metrics", "api_context", "identifier_report", "strip_comments_html", "loc",
    "tree_nodes", "edge_union", "graph_stats", "node_features", "gcn_propagate", "gat_propagate",
    "reach_uaf", "taint_source",
    "clone_join", "semantic_variance", "embed_corpus",
    "src_functions", "join_findings",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    keys = [k for k in (sys.argv[1:] or HEADLINE) if k in REGISTRY]
    spark = local_session(cpus, shuffle_partitions=2 * cpus, app="cwescope-bench")
    # Warm-up (JIT, class loading) on the smallest data; not timed.
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):
        REGISTRY["compare_tools"].spark_df(spark, warm).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for k in keys:
        t0 = time.time()
        REGISTRY[k].spark_df(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[k] = round(time.time() - t0, 3)
        print(f"{k}: {times[k]}s", file=sys.stderr, flush=True)
    spark.stop()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
