"""Headline queries, timed: prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local threads.
Each query runs once to warm up and once for the clock, into a sink that keeps
nothing, so the whole result is computed and no row reaches the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from echofold.plans import catalog  # noqa: E402
from echofold.session import local_session  # noqa: E402

HEADLINE = [
    "flagship", "network_epochs", "trend_and_driver", "gated_slope", "legendre_fit", "interp_tide_null", "repeat_interval",
    "nearest_match", "multilook", "complex_block_mean", "unwrap_phase", "block_weighted_mean", "pair_chain", "coherent_spectrum",
    "coherent_scan_jackknife", "jackknife_by_entity", "change_point", "kernel_profile", "robust_flags", "common_lag_fit",
    "misfit_profile", "modulus_interval", "rerun_diff", "pass_marginals",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    took = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
