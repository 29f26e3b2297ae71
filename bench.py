"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once untimed on a small input, so that code is compiled, then
once timed, its whole result written to a no-op sink."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from skyfuse.plans import registry  # noqa: E402
from skyfuse.session import local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("regrid_mean", "knn_impute", "optical_flow", "kernel_smooth", "k_gradient", "transition_matrix", "generator_matrix_small", "generator_matrix", "obs_assembly", "compare_per_step", "state_reconstruction", "kalman_filter", "gibbs_ffbs")


def main() -> None:
    spark = local_session(CPUS, int(CPUS), threads=int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    queries["gibbs_full"] = registry.gibbs_full
    warm = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
    took = {}
    for name in (*HEADLINE, "gibbs_full"):
        if name != "gibbs_full" and os.path.isdir(warm):
            queries[name](spark, warm).write.format("noop").mode("overwrite").save()
        began = time.perf_counter()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
