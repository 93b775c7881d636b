"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from voxlake.plans.registry import QUERIES
from voxlake.session import local_session

HEADLINE = (
    "attention_scores",
    "rescore_report",
    "repeats_same_cluster",
    "repeats_same_intent_orders",
    "repeat_groups",
    "attention_queue",
    "call_details",
    "issue_outcomes",
    "issue_days",
    "agent_issues",
    "agent_overview",
    "customer_list",
    "evidence_coverage",
    "turns_merged",
    "mood_points",
    "mood_shifts",
    "single_split_shifts",
    "evidence_built",
    "citation_pass_rates",
    "judgments_coerced",
    "word_error_rates",
    "similar_vector_pairs",
    "vector_components",
    "cluster_names",
    "full_analysis",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    spark.read.parquet(f"{sf}/events.parquet").count()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
