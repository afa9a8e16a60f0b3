"""Runs headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from riskloom.plans.registry import QUERIES

NAMES = ["transaction_velocity", "recipient_fanin", "pit_features", "paysim_features", "recipient_investigation", "recipient_candidate_queue", "recipient_concentration", "rule_backtest", "threshold_drift", "typology_sizing", "roc_auc", "average_precision", "capacity_frontier", "window_alpha_grid", "policy_grid", "adaptive_routing"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["rule_backtest"](spark, sf).write.format("noop").mode("overwrite").save()  # warm-up
    took = {}
    for name in NAMES:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
