"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1) holds the tables, BENCH_CPUS the cores. A short query warms the
session up; then each query is timed from building its plan to having all its rows: three times if it takes less
than SHORT seconds, and the median counts, otherwise once. Staged tables are deleted after each run.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from siterank.session import local_session  # noqa: E402
from siterank.sources.staging import drop_stages  # noqa: E402

HEADLINE = [
    "count_within_filtered", "sum_within", "avg_areas_within", "exclude_within", "assign_city", "nearest_line_within",
    "nearest_crossing", "nearest_barrier", "clip_miles", "erase_corridors", "dissolved_miles", "line_clusters",
    "zonal_mean", "tallied_features", "regional_rank", "county_id", "study_roster",
    "label_sites_plan", "line_miles_plan", "prioritized_subset",
]
SHORT = 5.0


def run(spark, name: str, sf_dir: str) -> float:
    start = time.time()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = time.time() - start
    drop_stages(spark)
    return took


def timed(spark, name: str, sf_dir: str) -> float:
    first = run(spark, name, sf_dir)
    return first if first >= SHORT else median([first, run(spark, name, sf_dir), run(spark, name, sf_dir)])


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8)))
    names = sys.argv[1:] or HEADLINE
    run(spark, "count_within_filtered", sf_dir)
    times = {}
    for name in names:
        times[name] = round(timed(spark, name, sf_dir), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "spark": spark.version,
                "cores": spark.sparkContext.defaultParallelism,
                "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
            }
        )
    )


if __name__ == "__main__":
    main()
