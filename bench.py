"""Time the headline queries; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from quillstat.queries import QUERIES

HEADLINE = ["tableone", "t1_numeric", "km", "log_rank", "cox_efron", "auc_delong", "ols", "ols_robust", "glm_binomial", "glm_gamma", "exact_match", "iptw_ate", "ceac"]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["t1_counts"](spark, d).collect()  # starts the session and compiles what all share
    taken = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, d).collect()
        taken[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
