"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from hindcast.plans import catalog
from hindcast.session import local_session

HEADLINE = [
    "w1_velocity",
    "w2_amount_stats_micros",
    "w4_history_count",
    "w7_global_velocity",
    "w10_behavioural_bundle",
    "g8_graph_bundle_with_components",
    "g6_component_sizes",
    "q3_padded_sequences",
    "t4_out_of_fold",
    "x1_ratio_split",
    "x7_rank_deciles",
    "d3_null_rates",
    "d10_amount_distribution",
    "j1_one_to_one_left",
    "b3_group_comparison",
    "e5_evaluation_record",
    "c5_calibration_error",
    "k7_capacity_sensitivity",
    "k16_time_deciles",
    "h5_pairwise_stability",
    "c2_sigmoid",
    "m3_column_transformer",
    "m5_logistic_scores",
    "m6_boosted_scores",
    "n2_anomaly_scores",
    "m7_scoring_latency",
    "r2_replay",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"), "16g", tempfile.mkdtemp(prefix="bench-"))
    # Start the JVM, the code generator and the Python workers before the clock runs.
    for name in ("w3_recency", "b3_group_comparison_p_values"):
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    scale = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
