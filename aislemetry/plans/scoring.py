"""Accuracy against labels and agreement between two detectors, all clips at once.

Detected tables and label tables share the key `clip`.
"""
from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aislemetry.operators.asof import nearest, overlap_best
from aislemetry.operators.detections import FRAME_KEY, match_blobs
from aislemetry.operators.ordered import (LastValid, Prev, holds_rank, resolve, scan, weighted_ranks,
                                          whole_groups)

# Acceptance limits.
TARGETS = {"entry_count_error": 0.10, "exit_count_error": 0.10, "occupancy_mae": 1.5,
           "stockout_recall": 0.95, "stockout_false_alarms": 1, "dwell_mae": 5.0,
           "count_mae": 1.0, "count_agreement": 0.9, "mean_iou": 0.7}


def count_error(got, want):
    return F.try_divide(got - want, F.when(want != 0, want).cast("double"))


def entry_exit_error(tripwire: DataFrame, labels: DataFrame) -> DataFrame:
    """Signed fraction of miscounted entries and exits; NULL without labels."""
    def counts(df, a, b):
        return df.groupBy("clip").agg(F.count_if(F.col("dir") == "in").alias(a),
                                      F.count_if(F.col("dir") == "out").alias(b))

    j = counts(labels, "entries_labelled", "exits_labelled").join(
        counts(tripwire, "entries_detected", "exits_detected"), "clip", "full").fillna(0)
    return j.select("clip", "entries_detected", "entries_labelled",
                    count_error(F.col("entries_detected"), F.col("entries_labelled")).alias("entry_count_error"),
                    count_error(F.col("exits_detected"), F.col("exits_labelled")).alias("exit_count_error"))


def occupancy_mae(occupancy: DataFrame, labels: DataFrame, chunk_s="auto") -> DataFrame:
    """Mean error of the report nearest to each labelled sample."""
    m = nearest(labels, occupancy.select("clip", "t", "seq", "count"), ["clip"], right_seq="seq",
                chunk_s=chunk_s)
    m = m.where(F.col("near").isNotNull())
    return m.groupBy("clip").agg(F.avg(F.abs(F.col("near.count") - F.col("count"))).alias("occupancy_mae"))


def match_visits(labels: DataFrame, visit: DataFrame) -> DataFrame:
    """Per labelled visit: matches with temporal IoU 0.5 and the best one's dwell error.

    labels: clip, label_id, zone, t_enter, t_exit; visit: clip, seq, zone, t_enter, t_exit.
    """
    p = overlap_best(labels, visit.select("clip", "zone", "seq", "t_enter", "t_exit"),
                     ["clip", "zone"], ["clip", "label_id"])
    err = F.abs((F.col("d_exit") - F.col("d_enter")) - (F.col("t_exit") - F.col("t_enter")))
    return p.select("clip", "label_id", "matches", err.alias("dwell_error"))


def dwell_and_switches(labels: DataFrame, visit: DataFrame) -> DataFrame:
    m = match_visits(labels, visit).groupBy("clip").agg(
        F.avg("dwell_error").alias("dwell_mae"), F.sum(F.col("matches") - 1).alias("__sw"),
        F.count("*").alias("visits_matched"))
    want = labels.groupBy("clip").agg(F.count("*").alias("visits_labelled"))
    got = visit.groupBy("clip").agg(F.count("*").alias("visits_detected"))
    j = want.join(got, "clip", "full").join(m, "clip", "left")
    labelled = F.col("visits_labelled").isNotNull()
    return j.select("clip", "dwell_mae",
                    F.when(labelled, F.coalesce("__sw", F.lit(0))).alias("id_switches"),
                    F.coalesce("visits_detected", F.lit(0)).alias("visits_detected"),
                    F.coalesce("visits_labelled", F.lit(0)).alias("visits_labelled"),
                    F.when(labelled, F.coalesce("visits_matched", F.lit(0))).alias("visits_matched"))


def match_stockouts(labels: DataFrame, starts: DataFrame, tol=10.0) -> DataFrame:
    """Each label, in list order, takes the first unused start of its facing near it.

    labels: clip, pos, facing, t_start; starts: clip, seq, facing, t. Where labels and starts of a facing lie further
    apart than `tol`, nothing on one side can take anything on the other, so such gaps cut the timeline into
    independent components. Each is matched by one pass over its labels; there are no rounds.
    Returns clip, facing, pos, t_start, seq, t.
    """
    keys = ["clip", "facing"]
    none = F.lit(None)
    line = labels.select(*keys, F.col("t_start").cast("double").alias("t"), "pos",
                         none.cast(starts.schema["seq"].dataType).alias("seq")).unionByName(
        starts.select(*keys, F.col("t").cast("double").alias("t"), none.cast(labels.schema["pos"].dataType).alias("pos"),
                      "seq"))
    chunk_s = resolve("auto", line, keys)
    line = scan(line, keys, ["t"], {"__p": Prev(F.col("t"))}, chunk_s)
    begins = F.col("__p").isNull() | (F.col("t") - F.col("__p") > tol)
    line = scan(line.withColumn("__b", F.when(begins, F.col("t"))), keys, ["t"],
                {"component": LastValid(F.col("__b"), True)}, chunk_s)
    by = [*keys, "component"]
    line = line.select(*by, "t", "pos", "seq").repartition(*by).sortWithinPartitions(*by)
    schema = T.StructType([line.schema[c] for c in (*keys, "pos")] + [T.StructField("t_start", T.DoubleType()),
                                                                   line.schema["seq"], line.schema["t"]])

    def run(batches):
        for rows in whole_groups(batches, by):
            t, pos, seq = (rows.column(c).to_pylist() for c in ("t", "pos", "seq"))
            free = sorted((s, x) for s, x in zip(seq, t) if s is not None)
            found = []
            for p, at in sorted((p, x) for p, x in zip(pos, t) if p is not None):
                hit = next((k for k, (_, x) in enumerate(free) if abs(x - at) <= tol), None)
                if hit is not None:
                    found.append((p, at, *free.pop(hit)))
            if found:
                head = [rows.column(k).slice(0, 1).take(pa.array([0] * len(found))) for k in keys]
                kinds = [rows.column(c).type for c in ("pos", "t", "seq", "t")]
                yield pa.RecordBatch.from_arrays(head + [pa.array(c, k) for c, k in zip(zip(*found), kinds)],
                                                 names=schema.names)

    return line.mapInArrow(run, schema)


def stockout_scores(labels: DataFrame, starts: DataFrame, tol=10.0) -> DataFrame:
    m = match_stockouts(labels, starts, tol).groupBy("clip").agg(F.count("*").alias("__m"))
    j = (labels.groupBy("clip").agg(F.count("*").alias("__w"))
         .join(starts.groupBy("clip").agg(F.count("*").alias("__g")), "clip", "full")
         .join(m, "clip", "left").fillna(0, ["__g", "__m"]))
    return j.select("clip", F.try_divide(F.col("__m"), F.col("__w")).alias("stockout_recall"),
                    (F.col("__g") - F.col("__m")).alias("stockout_false_alarms"))


def evaluate_run(tripwire, occupancy, visit, starts, gt: dict[str, DataFrame], chunk_s="auto") -> DataFrame:
    """Every accuracy figure of each clip and the verdict.

    Detected tables carry clip instead of run_id. `gt` holds entries, occupancy,
    visits (with label_id) and stockouts (with pos).
    """
    parts = [entry_exit_error(tripwire, gt["entries"]), occupancy_mae(occupancy, gt["occupancy"], chunk_s),
             stockout_scores(gt["stockouts"], starts), dwell_and_switches(gt["visits"], visit)]
    j = parts[0]
    for p in parts[1:]:
        j = j.join(p, "clip", "full")
    j = j.withColumn("stockout_false_alarms", F.coalesce("stockout_false_alarms", F.lit(0)))

    def within(c, needed=False):
        ok = F.abs(c) <= TARGETS[c]
        return F.coalesce(ok, F.lit(not needed))

    verdict = (within("entry_count_error", True) & within("occupancy_mae", True)
               & F.coalesce(F.col("stockout_recall") >= TARGETS["stockout_recall"], F.lit(True))
               & within("stockout_false_alarms") & within("exit_count_error") & within("dwell_mae"))
    return j.withColumn("passes", verdict)


def nearest_within(truth: DataFrame, pred: DataFrame, tol=2.0, keys=("clip", "lane"),
                   chunk_s="auto") -> DataFrame:
    """Truth rows with the nearest prediction of their lane, if within `tol`."""
    m = nearest(truth, pred, keys, right_seq="seq", chunk_s=chunk_s)
    return m.where(F.abs(F.col("near.t") - F.col("t")) <= tol)


def evaluate_queue(truth: DataFrame, pred: DataFrame, tol=2.0, chunk_s="auto") -> DataFrame:
    """Count and wait errors per clip; clips without a match keep NULLs."""
    m = nearest_within(truth, pred, tol, chunk_s=chunk_s).groupBy("clip").agg(
        F.avg(F.abs(F.col("near.count") - F.col("count"))).alias("count_mae"),
        F.avg(F.abs(F.col("near.pred_wait_s") - F.col("actual_wait_s"))).alias("wait_mae"),
        F.count("*").alias("n"))
    j = truth.select("clip").distinct().join(m, "clip", "left")
    return j.select("clip", "count_mae", "wait_mae", F.coalesce("n", F.lit(0)).alias("n"),
                    F.coalesce(F.col("count_mae") <= TARGETS["count_mae"], F.lit(False)).alias("count_pass"))


def summarise_clips(metrics: DataFrame, verdict="passes") -> DataFrame:
    """Mean of each numeric metric over the clips that have it, and whether all pass."""
    numeric = [f.name for f in metrics.schema.fields
               if f.dataType.typeName() in ("double", "float", "long", "integer", "short")]
    rows = metrics.select(verdict, *[F.col(c).cast("double").alias(c) for c in numeric])
    long = rows.unpivot([verdict], numeric, "metric", "value")
    return long.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.count("*").alias("n_clips"),
        F.bool_and(F.coalesce(verdict, F.lit(False))).alias("all_passed"))


def compare_detections(a: DataFrame, b: DataFrame, frames: DataFrame | None = None, fills=None,
                       threshold=0.5) -> DataFrame:
    """Agreement of two detection tables.

    `frames` lists every frame (both detectors saw the same clip); without it the
    frames with a box on either side count. `fills` (slot, fill_a, fill_b) adds
    the mean fill difference.
    """
    na = a.groupBy(*FRAME_KEY).agg(F.count("*").alias("na"))
    nb = b.groupBy(*FRAME_KEY).agg(F.count("*").alias("nb"))
    n = na.join(nb, FRAME_KEY, "full")
    if frames is not None:
        n = frames.select(*FRAME_KEY).join(n, FRAME_KEY, "left")
    n = n.fillna(0, ["na", "nb"]).groupBy("run_id", "stream").agg(
        F.count("*").alias("frames"), F.avg((F.col("na") == F.col("nb")).cast("int")).alias("count_agreement"),
        F.avg(F.col("nb") - F.col("na")).alias("mean_blob_delta"))
    m = match_blobs(a, b, threshold).groupBy("run_id", "stream").agg(
        F.count("*").alias("matched"), F.avg("iou").alias("mean_iou"))
    j = n.join(m, ["run_id", "stream"], "left").fillna(0, ["matched"]).fillna(0.0, ["mean_iou"])
    if fills is not None:
        d = fills.groupBy("run_id", "stream").agg(
            F.avg(F.abs(F.col("fill_a") - F.col("fill_b"))).alias("roi_fill_mae"))
        j = j.join(d, ["run_id", "stream"], "left")
    ok = (F.col("count_agreement") >= TARGETS["count_agreement"]) & (
        (F.col("mean_iou") >= TARGETS["mean_iou"]) | (F.col("matched") == 0))
    return j.withColumn("passes", ok)


def check_frame_counts(frames_a: DataFrame, frames_b: DataFrame) -> DataFrame:
    """Streams whose two sides do not have the same number of frames."""
    def n(df, c):
        return df.select(*FRAME_KEY).distinct().groupBy("run_id", "stream").agg(F.count("*").alias(c))
    j = n(frames_a, "a").join(n(frames_b, "b"), ["run_id", "stream"], "full").fillna(0, ["a", "b"])
    return j.where(F.col("a") != F.col("b"))


def timing_stats(durations: DataFrame, keys=("label",), col="ms", chunk_s="auto") -> DataFrame:
    """Frames, mean, 95th percentile (linear) and frames per second.

    Equal durations are one weighted row; the two ranks around the percentile come
    from a running sum of the weights. The total is a sum of decimals, so it has the
    same bits however the rows are dealt.
    """
    keys = list(keys)
    d = durations.select(*keys, F.col(col).cast("double").alias("ms")).where("ms is not null")
    total = d.groupBy(*keys).agg(F.sum(F.col("ms").cast("decimal(28,9)")).cast("double").alias("__s"))
    d = weighted_ranks(d, keys, "ms", chunk_s)
    at = (F.col("__n") - 1) * 0.95
    lo, hi = F.floor(at) + 1, F.least(F.floor(at) + 2, F.col("__n"))
    near = d.where(holds_rank(lo) | holds_rank(hi))
    g = near.join(total.withColumnsRenamed({k: f"__{k}" for k in keys}), reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])).groupBy(*keys).agg(
        F.max("__n").alias("frames"), F.max("__s").alias("__s"),
        F.min("ms").alias("__a"), F.max("ms").alias("__b"))
    part = (F.col("frames") - 1) * 0.95 - F.floor((F.col("frames") - 1) * 0.95)
    return g.select(
        *keys, "frames", (F.col("__s") / F.col("frames")).alias("mean_ms"),
        (F.col("__a") + (F.col("__b") - F.col("__a")) * part).alias("p95_ms"),
        F.coalesce(F.try_divide(F.col("frames") * 1000.0, F.col("__s")), F.lit(0.0)).alias("fps"))
