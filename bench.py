"""Benchmark the headline queries.

Runs at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]
and prints one JSON line. Each query is executed fully with the ``noop``
sink (no collect to the driver): once cold, then ``BENCH_REPEAT`` warm runs;
the reported per-query time is the best warm run (cold times are included
separately).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# training_rows is the flagship; w_order_count / w_revenue_total are the
# 3-window lookback (count, exact sum) over every scenario, comparable with
HEADLINE = ["training_rows", "w_order_count", "w_revenue_total", "shop_training_rows",
            "txn_training_rows", "running_cash", "metrics_report"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]

    from pyspark.sql import SparkSession
    from pitwise.session import STATIC_CONF, apply_conf
    from pitwise.plans.registry import QUERIES, load_all

    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("pitwise-bench")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", str(max(8, 2 * int(cpus))))
             .config("spark.driver.memory", "16g")
             .config(map=STATIC_CONF)
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    apply_conf(spark)
    if not spark.sparkContext.getCheckpointDir() and not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pitwise-bench-ckpt-"))
    load_all()

    def run(name: str) -> float:
        spark.catalog.clearCache()      # no reuse of persisted blocks across runs
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    warm, cold = {}, {}
    for n in names:
        cold[n] = round(run(n), 3)
        warm[n] = round(min(run(n) for _ in range(max(repeat, 1))), 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_warm_total", "value": round(sum(warm.values()), 3),
                      "unit": "sec", "queries": warm, "cold": cold,
                      "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf_dir,
                      "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
