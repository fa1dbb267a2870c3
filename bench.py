"""Time the headline queries; prints one JSON line.

Reads ``$BENCH_SF_DIR`` (default sf0.1) on ``local[$BENCH_CPUS]``. Each number is
the median of three runs into a ``noop`` sink after one warm-up run.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tallyguard.catalog import QUERIES
from tallyguard.session import build_session

HEADLINE = [
    "s04_parquet_scan",
    "s05_pruned_parquet_scan",
    "p07_hash_pii",
    "w01_device_txn_count",
    "w01_payments_scale",
    "w02_device_amount_zscore",
    "w04_receiver_unique_senders",
    "w06_live_features",
    "w10_topology_signal",
    "w11_running_amount_stats",
    "p11_assemble_features",
    "o02_temporal_split_80_20",
    "j01_ordinal_encode",
    "j03_graph_delta_asof",
    "a03_corridor_fit",
    "a06_roc_auc",
    "a07_pr_auc",
    "a08_score_quantiles",
    "a10_payment_degree",
    "a15_node_risk_rollup",
    "a21_cache_outcomes",
    "m08_holdout_evaluation",
    "m10_score_batch",
    "t05_rate_limit",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in HEADLINE:
        run(name)
        times[name] = round(statistics.median(run(name) for _ in range(3)), 4)
    print(
        json.dumps(
            {
                "metric": "total_headline_query_time",
                "value": round(sum(times.values()), 4),
                "unit": "sec",
                "queries": times,
                "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
