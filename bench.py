"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query is timed to a full materialisation of all its columns (the ``noop`` sink); no table is shared between
queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "events_union_standardised",
    "affected_pairs",
    "affected_customers",
    "affected_area_pct",
    "distance_to_event_km",
    "nearest_event",
    "dbscan_per_user",
    "dbscan_all",
    "main_cluster",
    "cluster_metrics",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    from riskgrid.plans.queries import REGISTRY
    from riskgrid.session import local_session
    spark = local_session(cpus=cpus, shuffle_partitions=int(cpus) * 2, app="riskgrid-bench")
    times = {}
    rows = {}
    for name in only:
        fn = REGISTRY[name][0]
        t0 = time.time()
        counted = Observation()
        fn(spark, sf_dir).observe(counted, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
        rows[name] = counted.get["n"]
        times[name] = round(time.time() - t0, 3)
        print(f"{name}: {times[name]}s, {rows[name]} rows", file=sys.stderr, flush=True)
    spark.stop()
    sf = sf_dir.rstrip("/").split("sf")[-1]
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "rows": rows, "sf": sf}))


if __name__ == "__main__":
    main()
