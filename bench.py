"""Headline queries at one scale factor; prints one JSON line.

Every query is run to its last row into a sink that keeps nothing, so the time is that of
the query and not of moving rows to the driver.
"""

from __future__ import annotations

import json
import os
import time

from evigraph.plans import catalog
from evigraph.session import local_session

HEADLINE = (
    "r1_candidates",
    "merge_nodes",
    "apply_aliases",
    "graph_quality_report",
    "family_catalog",
    "benchmark_summary",
    "repeat_flags",
    "cooldown_filter",
    "fold_mentions",
    "suspicious_nodes",
    "clean_documents",
    "sections",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n] or HEADLINE
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.read.parquet(f"{folder}/part.parquet").count()  # start the executors before the clock
    times: dict[str, float] = {}
    for name in only:
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
