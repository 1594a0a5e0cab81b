"""Headline queries, timed end to end (planning, size checks and full results).

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS] and
prints one JSON line.  Every query writes all its rows to Spark's noop sink.  A warm-up
query on the smallest tables starts the JVM before the clock does; ``publish`` is the time to
build the scene that the other queries share.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from sceneframe.plans.registry import QUERIES, published  # noqa: E402

HEADLINE = [
    "zone_hierarchy", "points_in_zones", "poses_in_zones", "objects_deepest_zone", "zones_report", "robot_pose",
    "objects_within", "describe_surroundings", "nearby_ranked", "find_nearest", "distance_to",
    "route_zones", "describe_route", "orient", "goals_for_zones", "query_zone", "query_object",
    "pose_as_of", "matched_responses", "navigation_status", "arrivals_detected", "last_log_lines",
    "objects_snapshot", "map_features", "answered_requests", "scored_cases", "eval_report",
    "planned_journeys", "stream_pose_zone",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "12g")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))      # one machine
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:] or HEADLINE
    times = {}
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        QUERIES["distinct_labels"](spark, warm).write.format("noop").mode("overwrite").save()
    start = time.perf_counter()
    scene = published(spark, sf_dir)
    scene.zones.write.format("noop").mode("overwrite").save()
    times["publish"] = round(time.perf_counter() - start, 3)
    for name in only:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
