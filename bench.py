"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores, BENCH_QUERIES=all times every registered query. Every query runs once to warm up, then BENCH_REPEATS times
(default 3); the median counts. Results go to Spark's noop sink, so all rows
and columns are computed and none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from scoreloom.registry.spark_queries import QUERIES
from scoreloom.session import build_session

HEADLINE = (
    "evaluate_performance",
    "compare_models",
    "report_full",
    "confusion_wide",
    "mean_loss",
    "prepare_shards",
    "shard_manifest",
    "to_sample",
    "drop_malformed",
    "scale_features",
    "class_weights",
    "data_statistics",
    "best_epoch",
    "weighted_loss",
    "softmax_probs",
    "train_epoch",
    "batch_gradient",
    "train_model",
)


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = build_session(
        app_name="scoreloom-bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    warm, cold = {}, {}
    for name in QUERIES if os.environ.get("BENCH_QUERIES") == "all" else HEADLINE:
        run = lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        cold[name] = round(timed(run), 3)
        warm[name] = round(statistics.median(timed(run) for _ in range(repeats)), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of medians",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "cpus": int(cpus),
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
