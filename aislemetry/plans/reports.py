"""Per-clip movement report from per-frame tracks.

tracks: run_id, stream, track_id, frame_id, u, v (foot point), still, travelled and
optionally zone. frames: run_id, stream, frame_id. All reports are keyed by run
and stream.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislemetry.functions.geometry import near_edge, region_of
from aislemetry.functions.timebuckets import frame_bucket
from aislemetry.schema import FULL_H, FULL_W

SCENE = ["run_id", "stream"]
TRACK = [*SCENE, "track_id"]
HEAT_CELL = 16
FULL_RECT = (0, 0, FULL_W, FULL_H)


def _most_common(tracks, label, name):
    """The label with most rows per track; the one reached first wins a tie."""
    n = tracks.where(F.col(label).isNotNull()).groupBy(*TRACK, label).agg(
        F.count("*").alias("__n"), F.min("frame_id").alias("__f"))
    return n.groupBy(*TRACK).agg(
        F.max_by(label, F.struct(F.col("__n"), -F.col("__f"))).alias(name))


def dwell_report(tracks: DataFrame, fps=15.0, rect=FULL_RECT) -> DataFrame:
    t = tracks.withColumn("__region", region_of(F.col("u"), F.col("v"), rect))
    d = t.groupBy(*TRACK).agg(
        F.min("frame_id").alias("__f0"), F.max("frame_id").alias("__f1"), F.count("*").alias("__n"),
        F.count_if("still").alias("__s"), F.max_by("travelled", "frame_id").alias("__w"))
    d = d.join(_most_common(t, "__region", "mostly_in_region"), TRACK)
    if "zone" in tracks.columns:
        d = d.join(_most_common(t, "zone", "mostly_in_zone"), TRACK, "left").fillna("", ["mostly_in_zone"])
    extra = ["mostly_in_zone"] if "zone" in tracks.columns else []
    return d.select(*TRACK, *[F.round(F.col(c) / fps, 2).alias(n) for c, n in (
        ("__f0", "first_seen_s"), ("__f1", "last_seen_s"), ("__n", "present_s"),
        ("__s", "standing_still_s"))], F.bround("__w", 0).cast("bigint").alias("walked_px"),
        "mostly_in_region", *extra)


def _spans(tracks):
    return tracks.groupBy(*TRACK).agg(
        F.min("frame_id").alias("f0"), F.max("frame_id").alias("f1"), F.count("*").alias("present"),
        F.min_by(F.struct("u", "v"), "frame_id").alias("born"),
        F.max_by(F.struct("u", "v"), "frame_id").alias("gone"))


def _lengths(frames):
    return frames.groupBy(*SCENE).agg(F.max("frame_id").alias("last_frame"))


def footfall_report(tracks, frames, fps=15.0, bucket_s=10.0) -> DataFrame:
    """People present, arrivals and departures per time bucket."""
    n = tracks.groupBy(*SCENE, "frame_id").agg(F.count("*").alias("n"))
    f = frames.select(*SCENE, "frame_id").join(n, [*SCENE, "frame_id"], "left").fillna(0, ["n"])
    b = f.groupBy(*SCENE, frame_bucket(F.col("frame_id"), fps, bucket_s).alias("bucket")).agg(
        F.round(F.avg("n"), 2).alias("people_present_mean"), F.max("n").alias("people_present_max"))
    last = _lengths(frames)
    s = _spans(tracks)
    arr = s.groupBy(*SCENE, frame_bucket(F.col("f0"), fps, bucket_s).alias("bucket")).agg(
        F.count("*").alias("arrivals"))
    # Tracks are first counted per last frame, so the clip length joins few rows.
    dep = (s.groupBy(*SCENE, "f1").agg(F.count("*").alias("__n")).join(last, SCENE)
           .where(F.col("f1") < F.col("last_frame"))
           .groupBy(*SCENE, frame_bucket(F.col("f1"), fps, bucket_s).alias("bucket"))
           .agg(F.sum("__n").alias("departures")))
    key = [*SCENE, "bucket"]
    j = b.join(arr, key, "left").join(dep, key, "left").join(last, SCENE).fillna(0, ["arrivals", "departures"])
    return j.select(
        *SCENE, F.round(F.col("bucket") * bucket_s, 1).alias("from_s"),
        F.round(F.least((F.col("bucket") + 1) * bucket_s, (F.col("last_frame") + 1) / fps), 1).alias("to_s"),
        "people_present_mean", "people_present_max", "arrivals", "departures")


def entries_exits_door(crossings, frames, fps=15.0, bucket_s=10.0) -> DataFrame:
    """Door crossings per bucket. crossings: run_id, stream, frame_id, dir."""
    c = crossings.groupBy(*SCENE, frame_bucket(F.col("frame_id"), fps, bucket_s).alias("bucket")).agg(
        F.count_if(F.col("dir") == "in").alias("entered"), F.count_if(F.col("dir") == "out").alias("exited"))
    top = frame_bucket(F.col("last_frame"), fps, bucket_s)
    spine = _lengths(frames).select(*SCENE, F.explode(F.sequence(F.lit(0).cast("bigint"), top)).alias("bucket"))
    return spine.join(c, [*SCENE, "bucket"], "left").fillna(0, ["entered", "exited"]).select(
        *SCENE, F.round(F.col("bucket") * bucket_s, 1).alias("from_s"), "entered", "exited",
        F.lit("configured door line").alias("basis"))


def entries_exits_edge(tracks, frames, fps=15.0, rect=FULL_RECT) -> DataFrame:
    """Without a door: tracks of half a second or more that touch the frame edge."""
    s = _spans(tracks).where(F.col("present") >= int(0.5 * fps)).join(_lengths(frames), SCENE)
    entered = near_edge(F.col("born.u"), F.col("born.v"), rect)
    left = near_edge(F.col("gone.u"), F.col("gone.v"), rect) & (F.col("f1") < F.col("last_frame"))
    return s.select(*TRACK, entered.cast("int").alias("entered_view_from_edge"),
                    left.cast("int").alias("left_view_via_edge"),
                    F.lit("frame edge (no door configured)").alias("basis"))


def heat_cells(tracks) -> DataFrame:
    def cell(c, top):
        return F.floor(F.floor(F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(float(top - 1)))) / HEAT_CELL)

    return tracks.groupBy(*SCENE, cell("u", FULL_W).alias("gx"), cell("v", FULL_H).alias("gy")).agg(
        F.count("*").alias("samples"))


def clip_summary(tracks, frames, fps=15.0, rect=FULL_RECT) -> DataFrame:
    """Headline numbers of each clip."""
    n = tracks.groupBy(*SCENE, "frame_id").agg(F.count("*").alias("n"))
    f = frames.select(*SCENE, "frame_id").join(n, [*SCENE, "frame_id"], "left").fillna(0, ["n"])
    f = f.groupBy(*SCENE).agg(F.count("*").alias("frames"), F.round(F.avg("n"), 2).alias("people_present_mean"),
                              F.max("n").alias("people_present_max"))
    d = dwell_report(tracks, fps, rect).groupBy(*SCENE).agg(
        F.count("*").alias("distinct_people"), F.count_if(F.col("standing_still_s") >= 2.0).alias("stood_still_2s"),
        F.max("standing_still_s").alias("longest_still_s"))
    e = entries_exits_edge(tracks, frames, fps, rect).groupBy(*SCENE).agg(
        F.sum("entered_view_from_edge").alias("entered"), F.sum("left_view_via_edge").alias("exited"))
    h = heat_cells(tracks).groupBy(*SCENE).agg(
        F.max_by(F.struct("gx", "gy", "samples"), F.struct("samples", -F.col("gy"), -F.col("gx"))).alias("hot"))
    j = f.join(d, SCENE, "left").join(e, SCENE, "left").join(h, SCENE, "left")
    gx, gy = F.col("hot.gx"), F.col("hot.gy")
    return j.select(
        *SCENE, "frames", F.round(F.col("frames") / fps, 1).alias("duration_s"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("entered", "exited")],
        "people_present_mean", "people_present_max",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("distinct_people", "stood_still_2s")],
        F.coalesce("longest_still_s", F.lit(0.0)).alias("longest_still_s"),
        (gx * HEAT_CELL + HEAT_CELL // 2).cast("bigint").alias("hot_x"),
        (gy * HEAT_CELL + HEAT_CELL // 2).cast("bigint").alias("hot_y"),
        region_of(gx * HEAT_CELL, gy * HEAT_CELL, rect).alias("hot_region"),
        F.col("hot.samples").alias("hot_samples"))
