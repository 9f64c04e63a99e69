"""Times the headline queries after a warm-up; prints one JSON line. With --sweep N..., one line for each number of cores."""

from __future__ import annotations

import json
import os
import subprocess
import sys
import time

from pyspark.sql import SparkSession

from orrery import catalog

HEADLINE = ["dataset_info", "zscore_rows", "nb_predict", "nb_metrics", "svm_predict", "svm_metrics_lr1", "knn_predict", "dt_predict", "dt_metrics", "mlp_forward", "mlp_full_steps"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["class_counts"](spark, sf_dir).collect()  # starts the session, the readers and a Python worker
    spark.range(int(cpus)).mapInArrow(lambda batches: batches, "id long").count()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    if sys.argv[1:2] == ["--sweep"]:
        for n in sys.argv[2:] or ["1", "2", "4", "8"]:
            subprocess.run([sys.executable, __file__], env={**os.environ, "BENCH_CPUS": n}, check=True)
    else:
        main()
