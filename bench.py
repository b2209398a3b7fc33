"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from aislemetry.session import get_spark  # noqa: E402
from aislemetry.plans import catalog  # noqa: E402

HEADLINE = (
    "footfall_by_hour", "footfall_spark", "run_window", "visits", "dwell_by_zone", "shopper_totals",
    "heatmap_accumulate", "heatmap_grid", "shelf_latest", "lost_revenue", "recent_stockouts",
    "replenishment_top", "queue_status", "wait_pred_vs_actual", "conversion_by_zone", "funnel",
    "store_rollup", "kpi_15m", "throttle_occupancy", "crossings", "close_stockouts", "fill_status",
    "shelf_incidents", "alerts_from_events", "arrival_rate", "queue_estimates", "zone_of",
    "clip_detections", "iou_pairs", "match_blobs", "compare_detections", "merge_fragments",
    "track_features", "dwell_report", "evaluate_run", "validate_events_good", "rollup_lanes",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = get_spark("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    # One warm pass over the inputs, so the first query does not pay for start-up.
    for table in ("events", "lineitem", "part"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    boxes = rows / times["clip_detections"] if times.get("clip_detections") else None
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(os.path.normpath(sf_dir)), "cpus": int(cpus),
        "boxes_per_s_clip_detections": round(boxes) if boxes else None}))
    spark.stop()


if __name__ == "__main__":
    main()
