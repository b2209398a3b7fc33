"""Row types: the event envelope, the per-type tables, frames and dimensions."""
from __future__ import annotations

from pyspark.sql import functions as F

ENVELOPE = ("t double, store_id string, stream string, zone_id string, event_type string, "
            "payload string")

# The record contract.
STREAMS = ("overhead", "shelf", "-")
EVENT_KEYS = {
    "tripwire": ("dir", "tripwire_id"),
    "occupancy": ("count",),
    "visit": ("track_id", "t_enter", "t_exit"),
    "heatmap": ("t_bucket", "tiles"),
    "shelf_fill": ("fill",),
    "stockout_start": ("sku", "facing"),
    "stockout_end": ("sku", "facing"),
    "planogram_violation": ("expected_sku", "observed"),
    "lane_occ": ("lane", "cells"),
    "queue_estimate": ("lane", "count", "pred_wait_s"),
    "pos_txn": ("lane", "items", "amount", "zone_hint"),
    "alert": ("severity", "rule", "message"),
}
PAYLOAD_DDL = {
    "tripwire": "dir string, tripwire_id string",
    "occupancy": "count bigint",
    "visit": "track_id bigint, t_enter double, t_exit double",
    "heatmap": "t_bucket bigint, tiles array<array<bigint>>",
    "shelf_fill": "fill double",
    "stockout_start": "sku string, facing string",
    "stockout_end": "sku string, facing string",
    "planogram_violation": "expected_sku string, observed string",
    "lane_occ": "lane bigint, cells array<bigint>",
    "queue_estimate": "lane bigint, count double, pred_wait_s double",
    "pos_txn": "lane bigint, items bigint, amount double, zone_hint string",
    "alert": "severity string, rule string, message string",
}

TABLES = {
    "run": "run_id string, store_id string, started double, clipset string",
    "tripwire": "run_id string, t double, dir string",
    "occupancy": "run_id string, t double, count bigint",
    "visit": "run_id string, track_id bigint, zone string, t_enter double, t_exit double, dwell_s double",
    "heatmap": "run_id string, t_bucket bigint, gx bigint, gy bigint, count bigint",
    "shelf_fill": "run_id string, t double, roi string, fill double",
    "stockout": "run_id string, roi string, sku string, t_start double, t_end double",
    "planogram_violation": "run_id string, t double, roi string, expected string, observed string",
    "lane_occ": "run_id string, t double, lane bigint, cells array<bigint>",
    "queue_estimate": "run_id string, t double, lane bigint, count double, pred_wait_s double",
    "queue_truth": "clip string, t double, lane bigint, count bigint, actual_wait_s double",
    "pos_txn": "run_id string, t double, lane bigint, items bigint, amount double, zone_hint string",
    "alert": "run_id string, t double, severity string, rule string, message string, acked bigint",
    "kpi_15m": "run_id string, t_bucket bigint, key string, value double",
    "sync_state": "key string, last_bucket bigint",
}
RUN_TABLES = tuple(n for n in TABLES if n not in ("queue_truth", "sync_state"))

FRAME = (
    "run_id string, store_id string, stream string, frame_id bigint, t_ns bigint, flags int, "
    "num_blobs int, blobs array<struct<x:int,y:int,w:int,h:int,area:bigint>>, "
    "roi_fill array<int>, lane_occupancy array<int>")

DIMENSIONS = {
    "zones": "id string, polygon array<array<double>>",
    "rois": "id string, stream string, x int, y int, w int, h int, empty_below int, low_below int, "
            "pick_monitor boolean",
    "lanes": "id string, lane int, cell int, x int, y int, w int, h int",
    "tripwires": "id string, stream string, p1 array<double>, p2 array<double>, in_dir string",
    "planogram": "facing string, sku string, name string, unit_price double, "
                 "expected_sales_per_hour double, initial_stock int, low_threshold int",
}

# Frame geometry and record limits.
FULL_W, FULL_H = 640, 480
TABLE_W, TABLE_H = 320, 240
MAX_BLOBS, MAX_ROIS, MAX_LANES, LANE_CELLS = 64, 64, 16, 16
FLAG_WARM, FLAG_TRUNCATED = 1, 2
HEAT_CELL_M = 0.25
# Wall times before 2025-09-05 mean the clock was never set.
PLAUSIBLE_EPOCH = 1757030400.0


def store_keys(facts, dimension, *keys) -> list[str]:
    """Keys that join facts to a dimension: with the store where the dimension has rows per store."""
    if "store_id" not in dimension.columns:
        return list(keys)
    if "store_id" not in facts.columns:
        raise ValueError("the dimension is per store: give the facts their store_id (schema.with_store)")
    return ["store_id", *keys]


DEALS = 64


def dealt_join(facts, dimension, on, deal_by=None, how="inner"):
    """Facts joined to a table of few keys; the facts of each key are dealt over `DEALS` tasks, as few keys hold them all.

    `deal_by` names the columns that tell facts of a key apart (all by default).
    """
    deal = F.pmod(F.xxhash64(*(deal_by or facts.columns)), F.lit(DEALS)).cast("int")
    each = dimension.withColumn("__deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    return facts.withColumn("__deal", deal).join(each, [*on, "__deal"], how).drop("__deal")


def with_run(facts, per_run):
    """Facts left-joined to a table of runs; the facts of each run are dealt over `DEALS` tasks, as few runs hold them all."""
    return dealt_join(facts, per_run, ["run_id"], how="left")


def with_store(facts, run):
    """Facts of a run with their run's store."""
    return with_run(facts, run.select("run_id", "store_id").distinct())
