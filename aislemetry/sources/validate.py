"""Checks on events and dimensions."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislemetry.schema import (EVENT_KEYS, LANE_CELLS, MAX_LANES, MAX_ROIS, PLAUSIBLE_EPOCH, STREAMS,
                               TABLE_H, TABLE_W)


def check_events(events: DataFrame, min_time=None) -> DataFrame:
    """Add `reason` (NULL when good) and the missing and unexpected payload keys."""
    expected = F.lit(None).cast("array<string>")
    for kind, keys in EVENT_KEYS.items():
        expected = F.when(F.col("event_type") == kind, F.array(*map(F.lit, sorted(keys)))
                          ).otherwise(expected)
    got = F.coalesce(F.json_object_keys("payload"), F.array().cast("array<string>"))
    e = events.withColumn("__want", expected).withColumn("__got", got)
    e = e.withColumn("missing", F.array_sort(F.array_except("__want", "__got"))).withColumn(
        "unexpected", F.array_sort(F.array_except("__got", "__want")))
    reason = (F.when(F.col("__want").isNull(), "unknown event_type")
              .when(F.col("stream").isNull() | ~F.col("stream").isin(*STREAMS), "unknown stream")
              .when((F.size("missing") > 0) | (F.size("unexpected") > 0), "payload mismatch"))
    if min_time is not None:
        reason = F.coalesce(reason, F.when(F.col("t") < min_time, "implausible time"))
    return e.withColumn("reason", reason).drop("__want", "__got")


def validate_events(events: DataFrame, min_time=None) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine). Pass `PLAUSIBLE_EPOCH` to refuse unset clocks."""
    checked = check_events(events, min_time)
    good = checked.where(F.col("reason").isNull()).drop("reason", "missing", "unexpected")
    return good, checked.where(F.col("reason").isNotNull())


def validate_dimensions(dims: dict[str, DataFrame]) -> DataFrame:
    """All violations of a set of dimension tables: table, entry, problem.

    Tables carry store_id; every check is per store.
    """
    def bad(name, df, entry, problem):
        return df.select("store_id", F.lit(name).alias("table"), F.col(entry).cast("string").alias("entry"),
                         F.lit(problem).alias("problem"))

    def required(name, key, cols):
        return [bad(name, dims[name].where(F.col(c).isNull()), key, f"missing {c}") for c in cols]

    def duplicates(name, key):
        d = dims[name].groupBy("store_id", key).count().where("count > 1")
        return bad(name, d, key, f"duplicate {key}")

    def outside(name):
        x, y, w, h = map(F.col, ("x", "y", "w", "h"))
        wrong = (w <= 0) | (h <= 0) | (x < 0) | (y < 0) | (x + w > TABLE_W) | (y + h > TABLE_H)
        return bad(name, dims[name].where(wrong), "id", "box outside the frame")

    def too_many(name, limit):
        d = dims[name].groupBy("store_id").count().where(F.col("count") > limit)
        return bad(name, d, "count", f"more than {limit} entries")

    def stream(name):
        return bad(name, dims[name].where(~F.col("stream").isin("overhead", "shelf")), "id", "unknown stream")

    levels = (F.col("empty_below") >= 0) & (F.col("empty_below") < F.col("low_below")) & (F.col("low_below") <= 255)
    parts = [
        *required("rois", "id", ("id", "stream", "x", "y", "w", "h", "empty_below", "low_below")),
        *required("lanes", "id", ("id", "lane", "cell", "x", "y", "w", "h")),
        *required("zones", "id", ("id", "polygon")),
        *required("tripwires", "id", ("id", "stream", "p1", "p2", "in_dir")),
        *required("planogram", "facing", ("facing", "sku", "name", "unit_price", "expected_sales_per_hour")),
        duplicates("rois", "id"), duplicates("lanes", "id"), duplicates("zones", "id"),
        duplicates("tripwires", "id"), duplicates("planogram", "facing"),
        outside("rois"), outside("lanes"), too_many("rois", MAX_ROIS), too_many("lanes", MAX_LANES),
        stream("rois"), stream("tripwires"),
        bad("rois", dims["rois"].where(~levels), "id", "bad fill thresholds"),
        bad("zones", dims["zones"].where(F.size("polygon") < 3), "id", "polygon needs 3 points"),
        bad("tripwires", dims["tripwires"].where(~F.col("in_dir").isin("up", "down", "left", "right")),
            "id", "bad in_dir"),
        bad("planogram", orphan_facings(dims["planogram"], dims["rois"]), "facing", "facing has no roi"),
    ]
    return reduce(DataFrame.unionByName, parts)


def orphan_facings(planogram: DataFrame, rois: DataFrame) -> DataFrame:
    return planogram.join(rois.select("store_id", F.col("id").alias("facing")),
                          ["store_id", "facing"], "left_anti")


def pack_cells(df: DataFrame, col="cells") -> DataFrame:
    """Pad lane cells with 0 to 16 and keep the low byte of each.

    Longer arrays are an error of the source; `cells_ok` is false for them.
    """
    c = F.col(col)
    pad = F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.lit(LANE_CELLS) - F.size(c), F.lit(0)))
    full = F.concat(c.cast("array<bigint>"), pad)
    return df.withColumn("cells_ok", F.size(c) <= LANE_CELLS).withColumn(
        col, F.transform(full, lambda v: v.bitwiseAND(F.lit(255).cast("bigint"))))


def event_time(frames: DataFrame, epoch: float | str, keys=("run_id", "stream")) -> DataFrame:
    """Epoch time of frames from their monotonic clock: the first frame is `epoch`.

    `epoch` is a number or the name of a column. The first tick is formed per
    stream and joined back, so no stream is sorted as a whole.
    """
    keys = list(keys)
    first = frames.groupBy(*keys).agg(F.min_by("t_ns", "frame_id").alias("__t0"))
    base = F.col(epoch) if isinstance(epoch, str) else F.lit(float(epoch))
    return frames.join(first, keys).withColumn(
        "t", base + (F.col("t_ns") - F.col("__t0")) / 1e9).drop("__t0")


__all__ = ["PLAUSIBLE_EPOCH", "check_events", "event_time", "orphan_facings", "pack_cells",
           "validate_dimensions", "validate_events"]
