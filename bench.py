"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from quernstone.plans import registry
from quernstone.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [*(f"tpch_q{n:02d}" for n in range(1, 23)), "click_q05", "click_q14", "click_q24", "a15_cube", "j03_mark_customers", "j10_asof", "j14_counted", "w03_rows_frame", "v01_knn_l2", "t06_tumbling"]


def main() -> None:
    spark = local_session(CPUS, "bench")
    runs = {name: (lambda q=registry.QUERIES[name]: q(spark, SF_DIR)) for name in HEADLINE}
    took = {}
    for name, run in runs.items():
        best = float("inf")
        for _ in range(2):
            start = time.perf_counter()
            run().write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline queries, best of two", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
