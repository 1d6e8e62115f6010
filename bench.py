"""Time the headline queries once each and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from landledger.session import build_session  # noqa: E402

HEADLINES = [
    # stage-building queries first: each pays for the stages it is the first to need
    "resolve_list", "spatial_overlap", "union_containment", "match_decision", "parcel_rollup", "delivery_widening",
    "candidates_ranked",
    # views over the stages
    "list_reconciliation", "parcel_resolution", "match_reconciliation", "list_overview", "loss_by_commodity",
    "loss_by_era", "worst_parcels", "candidate_reconciliation", "portfolio",
    # audit
    "cell_match", "grade_outcomes", "stage_accuracy", "question_delta", "artifact_load", "pairwise_jaccard",
    "kendall_tau", "fleiss_kappa",
    # transcripts, documents, distances
    "usage_cost", "slow_calls", "heartbeat_throttle", "call_durations", "secret_scan", "section_ranges", "section_cut",
    "corpus_digest", "polyconic_distance",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        app="bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    from landledger.catalog import QUERIES

    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
