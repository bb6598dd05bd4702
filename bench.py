"""Times every headline query; prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (comma separated keys) override the defaults.
"""

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from riskframe.plans import all_queries  # noqa: E402
from riskframe.session import drop_shared_folders, local_session  # noqa: E402

# Fits dominate these; they run once, the others take the median of three.
SLOW = {
    "train_logreg", "train_random_forest", "train_gbt", "train_mlp", "score_model", "model_store", "score_batched",
    "shap_kernel", "shap_permutation", "lime_local", "importance_table", "background_cross",
}


def run(spark, sf_dir, key):
    start = time.perf_counter()
    all_queries.QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "riskframe-bench")
    keys = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k] or list(all_queries.QUERIES)
    run(spark, sf_dir, "confusion_matrix")  # warm the session up
    times = {}
    for key in keys:
        repeats = 1 if key in SLOW else 3
        times[key] = round(statistics.median(run(spark, sf_dir, key) for _ in range(repeats)), 3)
        print(f"{key} {times[key]}", file=sys.stderr, flush=True)
    drop_shared_folders(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
