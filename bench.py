"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is run once to completion through the ``noop`` sink (full
execution, no driver collect) after a warm-up of the session on the small
sf0.001 tables.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from assay_spark.plans.queries import QUERIES  # noqa: E402
from assay_spark.session import get_spark  # noqa: E402

HEADLINE = [
    "flagship_knn_eval",      # split -> standardise -> kNN -> metrics
    "subsamples_grid",        # 3 sizes x 25 repeats stratified draw + split
    "evaluate_grid",          # all cells x {ols, ridge, knn, mean} in one job
    "profile_describe",       # describe with exact quartiles on lineitem
    "box_stats",              # grouped exact quartiles + whiskers on events
    "stratified_split",       # exact largest-remainder split of orders
    "sample_n",               # exact 1800-row draw from orders
    "corr_matrix",            # pairwise correlation, one aggregate
    "response_features",      # 1710-long response embedding per row
    "shot_noise",             # finite-shot resampling, md5 draws
    "regression_metrics",     # grouped MSE/MAE/R2/RMSE/MAPE
    "rollup_scores",          # mean/std roll-up
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=cpus,
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEM", "16g")})
    # warm-up: JVM class loading / JIT and the Python worker pool, using the
    # flagship on the separate sf0.001 tables (no data or cache is shared
    # with the timed runs, which read $BENCH_SF_DIR)
    QUERIES["rollup_scores"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.range(64).repartition(cpus).mapInPandas(lambda it: it, "id long").write.format("noop").mode("overwrite").save()
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm) and os.path.abspath(warm) != os.path.abspath(sf_dir):
        QUERIES["flagship_knn_eval"](spark, warm).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}))


if __name__ == "__main__":
    main()
