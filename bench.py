"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from kerbline.plans.registry import load_all  # noqa: E402
from kerbline.session import local_session  # noqa: E402

HEADLINE = (
    "class_table", "quantile_profile", "overlap_counts", "format_agreement", "near_duplicate_pairs", "near_duplicate_counts",
    "scene_groups", "same_sign_pairs", "change_sample", "greedy_match", "group_split", "stratified_split", "propagated_labels",
    "dataset_stats", "label_texts", "merged_annotations", "classification_score", "answer_key", "confirmed_events", "settled_votes",
    "lane_departure", "one_per_tick", "last_known_state", "gated_alerts", "acknowledged_alerts", "contract_violations",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, max(8, int(cores)) if cores.isdigit() else 8, "bench")
    queries, _ = load_all()
    queries["class_histogram"](spark, folder).collect()  # start the JVM and the file cache
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
