"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is run to completion through the ``noop`` sink (the whole plan
executes, nothing is collected to the driver) and timed from plan build to
finish. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "keyword_top1",
    "keyword_scores",
    "first_match_label",
    "combined_diagnosis_rules",
    "keyword_top1_documents",
    "scalar_text_normalise",
    "median_impute",
    "intake_impute",
    "domain_violations",
    "record_lookup",
    "record_update_merge",
    "vaccination_push",
    "vaccination_last_n",
    "animal_report",
    "label_encode",
    "accuracy_metric",
    "scan_lookup_raw",
    "csv_quoted_text",
    "health_status_forest",
    "survival_forest",
    "stream_vaccination_state",
    "stream_record_state",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE

    from herdlens.plans.registry import load_all
    from herdlens.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                          app="herdlens-bench")
    reg = load_all()
    # Warm the JVM (class loading, codegen caches) outside the timings.
    reg["fatal_outcome_label"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        reg[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
