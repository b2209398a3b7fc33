"""Joins along time: nearest, interval-exists and label matching.

The first two emit no pairs: both sides are merged into one ordered timeline per
key and looked up with ordered scans, so the work is linear in the rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aislemetry.operators.ordered import LastValid, NextValid, resolve, scan


def _timeline(left, left_t, right, right_t, keys, left_first):
    a, b = (0, 1) if left_first else (1, 0)
    rows = left.select(*keys, F.col(left_t).cast("double").alias("__t"), F.lit(a).alias("__side"),
                       F.struct(*[F.col(c) for c in left.columns]).alias("__l"))
    marks = right.select(*keys, F.col(right_t).cast("double").alias("__t"),
                         F.lit(b).alias("__side"),
                         F.struct(*[F.col(c) for c in right.columns]).alias("__r"))
    return rows.unionByName(marks, allowMissingColumns=True)


def nearest(left: DataFrame, right: DataFrame, keys, t="t", right_t=None, right_seq=None,
            chunk_s="auto") -> DataFrame:
    """Each left row with the right row nearest in time; ties go to the earlier.

    Returns the left columns and a struct `near` (NULL when the key has none).
    Right rows on one instant collapse to the first by `right_seq`.
    """
    keys, right_t = list(keys), right_t or t
    first = F.min_by(F.struct(*[F.col(c) for c in right.columns]),
                     F.struct(right_seq or right_t)).alias("__r")
    right = right.groupBy(*keys, F.col(right_t).alias("__rt")).agg(first).select("__r.*")
    line = _timeline(left, t, right, right_t, keys, left_first=False)
    line = scan(line, keys, ["__t", "__side"],
                {"__b": LastValid(F.col("__r"), True), "__a": NextValid(F.col("__r"), True)},
                resolve(chunk_s, line, keys, "__t", measure=False))
    at = F.col("__t")
    take_before = F.col("__b").isNotNull() & (
        F.col("__a").isNull()
        | (at - F.col("__b")[right_t] <= F.col("__a")[right_t] - at))
    return (line.where(F.col("__l").isNotNull())
            .select("__l.*", F.when(take_before, F.col("__b")).otherwise(F.col("__a")).alias("near")))


def exists_within(left: DataFrame, right: DataFrame, keys, lo: str, hi: str, right_t="t",
                  flag="hit", chunk_s="auto") -> DataFrame:
    """Flag left rows that have a right row with `lo <= t <= hi`.

    True iff the first right row at or after `lo` is not past `hi`.
    """
    keys = list(keys)
    right = right.select(*keys, right_t).distinct()
    line = _timeline(left, lo, right, right_t, keys, left_first=True)
    line = scan(line, keys, ["__t", "__side"], {"__n": NextValid(F.col("__r")[right_t])},
                resolve(chunk_s, line, keys, "__t", measure=False))
    return (line.where(F.col("__l").isNotNull())
            .select("__l.*", F.coalesce(F.col("__n") <= F.col("__l")[hi], F.lit(False)).alias(flag)))


def _octave(a, b):
    length = F.greatest(F.col(b) - F.col(a), F.lit(1e-6))
    return F.floor(F.log2(length)).cast("int")


def _reach(min_iou):
    """Octaves by which the lengths of two intervals of that temporal IoU may differ."""
    reach = 1
    while 2 ** reach < 1.0 / min_iou:
        reach += 1
    return reach


def overlap_matches(labels: DataFrame, visits: DataFrame, keys, min_iou=0.5) -> DataFrame:
    """Label and detected intervals of one key whose temporal IoU reaches `min_iou`.

    Such pairs differ in length by at most 1/min_iou and their starts by at most
    the longer length, so both sides are bucketed by length octave and by start
    in units of that octave; only neighbouring buckets can pair up. Columns of
    the detected side carry the prefix `d_`.
    """
    keys, reach = list(keys), _reach(min_iou)
    octave = _octave
    left = labels.withColumn("__o", octave("t_enter", "t_exit")).withColumn(
        "__level", F.explode(F.sequence(F.col("__o") - reach, F.col("__o") + reach)))
    # A detected interval of octave L is shorter than 2^(L+1).
    unit = F.pow(F.lit(2.0), F.col("__level") + 1)
    span = F.col("t_exit") - F.col("t_enter")
    left = left.withColumn("__slot", F.explode(F.sequence(
        F.floor((F.col("t_enter") - F.greatest(unit, F.lit(0.0))) / unit).cast("bigint"),
        F.floor((F.col("t_enter") + span) / unit).cast("bigint"))))
    right = visits.select(
        *keys, F.col("t_enter").alias("d_enter"), F.col("t_exit").alias("d_exit"),
        *[F.col(c).alias(f"d_{c}") for c in visits.columns
          if c not in (*keys, "t_enter", "t_exit")],
        octave("t_enter", "t_exit").alias("__level"))
    right = right.withColumn("__slot", F.floor(
        F.col("d_enter") / F.pow(F.lit(2.0), F.col("__level") + 1)).cast("bigint"))
    overlap = F.greatest(F.lit(0.0), F.least("t_exit", "d_exit") - F.greatest("t_enter", "d_enter"))
    union = F.greatest("t_exit", "d_exit") - F.least("t_enter", "d_enter")
    return (left.join(right, [*keys, "__level", "__slot"])
            .withColumn("overlap_s", overlap)
            .where((union > 0) & (F.try_divide(F.col("overlap_s"), union) >= min_iou))
            .drop("__o", "__level", "__slot"))


TILE_LABELS, TILE_VISITS = 1024, 8192      # intervals of a tile
SPREAD = 8                                 # tasks over which the label tiles of one key and octave are dealt
CELLS = 1 << 18                            # pairs that are looked at in one step


def _tiles(rows: DataFrame, by, start, size, item) -> DataFrame:
    """Rows in (by, start) order cut into tiles of at most `size`; a range of the order is a task, whatever the keys."""
    line = rows.repartitionByRange(*by, start, "__item").sortWithinPartitions(*by, start, "__item")
    tile = F.floor(F.monotonically_increasing_id() / size).alias("__tile")
    return line.select("*", tile).groupBy(*by, "__tile").agg(
        F.sort_array(F.collect_list("__item")).alias(item), F.min("__from").alias("__from"), F.max("__to").alias("__to"))


def _look_up(a, b, s, e, min_iou):
    """Per label [a, b]: its matches among the visits [s, e], the best one's place, and the overlap with it.

    The best has the longest overlap and, of these, the first place. Labels are looked at in order of their starts, each
    block of them only against visits that start where one of them can still match.
    """
    n, place, overlap = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), np.zeros(len(a))
    at = np.argsort(s, kind="stable")
    s, e = s[at], e[at]
    low, high = _starts(a, b, min_iou)
    labels = np.argsort(a, kind="stable")
    done = 0
    while done < len(labels):
        first = np.searchsorted(s, low[labels[done]])
        block = labels[done:done + max(1, CELLS // max(1, len(s) - int(first)))]
        done += len(block)
        x, y = np.searchsorted(s, low[block].min()), np.searchsorted(s, high[block].max(), "right")
        if x >= y:
            continue
        a_, b_, s_, e_ = a[block][:, None], b[block][:, None], s[x:y], e[x:y]
        both = np.maximum(0.0, np.minimum(b_, e_) - np.maximum(a_, s_))
        good = both / (np.maximum(b_, e_) - np.minimum(a_, s_)) >= min_iou
        n[block] = good.sum(axis=1)
        both[~good] = -1.0
        overlap[block] = best = both.max(axis=1)
        place[block] = np.where(both == best[:, None], at[x:y], len(s)).min(axis=1)
    return n, place, overlap


def _starts(a, b, min_iou):
    """Bounds of the starts of what can match [a, b]; the rounding of times is far below the hair added to them."""
    size = F.abs if isinstance(a, Column) else np.abs
    hair = (size(a) + size(b)) * 1e-12
    return b - (b - a) / min_iou - hair, b - (b - a) * min_iou + hair


def overlap_best(labels: DataFrame, visits: DataFrame, keys, by, min_iou=0.5) -> DataFrame:
    """Per value of the label columns `by`: the number of `overlap_matches` and the best one.

    Returns `by`, `matches`, and t_enter, t_exit, d_enter, d_exit, d_seq and overlap_s of the match with the longest
    overlap, of these the one with the least `seq`. Pairs are counted where they are found: both sides are packed into
    tiles of bounded size in order of their starts, tiles that can match are joined, and a pair of tiles is one step in
    arrays that gives a row per label. So what is shuffled grows with the rows and not with the pairs.
    """
    keys, by, reach = list(keys), list(by), _reach(min_iou)
    some = F.col("t_exit") > F.col("t_enter")             # nothing overlaps an interval without length
    span = [F.col(c).cast("double").alias(c) for c in ("t_enter", "t_exit")]
    left = labels.where(some).select(*keys, _octave("t_enter", "t_exit").alias("__o"), *span, F.struct(*by).alias("__by"))
    low, high = _starts(F.col("t_enter"), F.col("t_exit"), min_iou)
    left = left.select(*keys, "__o", "t_enter", low.alias("__from"), high.alias("__to"),
                       F.struct("__by", "t_enter", "t_exit").alias("__item"))
    left = _tiles(left, [*keys, "__o"], "t_enter", TILE_LABELS, "__labels")
    left = left.withColumn("__level", F.explode(F.sequence(F.col("__o") - reach, F.col("__o") + reach))).withColumn(
        "__deal", F.pmod("__tile", F.lit(SPREAD)))
    right = visits.where(some).select(*keys, _octave("t_enter", "t_exit").alias("__level"), *span, "seq")
    right = right.select(*keys, "__level", "t_enter", F.col("t_enter").alias("__from"), F.col("t_enter").alias("__to"),
                         F.struct("seq", "t_enter", "t_exit").alias("__item"))
    right = _tiles(right, [*keys, "__level"], "t_enter", TILE_VISITS, "__visits").select(
        *keys, "__level", "__visits", F.col("__from").alias("__first"), F.col("__to").alias("__last"),
        F.explode(F.array(*[F.lit(n).cast("long") for n in range(SPREAD)])).alias("__deal"))
    tiles = left.join(right, [*keys, "__level", "__deal"]).where(
        (F.col("__last") >= F.col("__from")) & (F.col("__first") <= F.col("__to"))).select("__labels", "__visits")
    label, seq = (tiles.schema[c].dataType.elementType[f].dataType
                  for c, f in (("__labels", "__by"), ("__visits", "seq")))
    numbers = ("t_enter", "t_exit", "d_enter", "d_exit", "overlap_s")
    schema = T.StructType([T.StructField("__by", label), T.StructField("n", T.LongType()), T.StructField("d_seq", seq),
                           *[T.StructField(c, T.DoubleType()) for c in numbers]])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                own, seen = (batch.column(c).slice(k, 1).flatten() for c in ("__labels", "__visits"))
                a, b, s, e = (side.field(c).to_numpy() for side in (own, seen) for c in ("t_enter", "t_exit"))
                n, place, overlap = _look_up(a, b, s, e, min_iou)
                hit = np.flatnonzero(n)
                if len(hit):
                    place = place[hit]
                    yield pa.RecordBatch.from_arrays(
                        [own.field("__by").take(pa.array(hit)), pa.array(n[hit]), seen.field("seq").take(pa.array(place)),
                         *map(pa.array, (a[hit], b[hit], s[place], e[place], overlap[hit]))], names=schema.names)

    found = tiles.mapInArrow(run, schema).select("__by.*", "n", "d_seq", *numbers)
    best = F.min_by(F.struct(*numbers[:4], "d_seq", "overlap_s"), F.struct(-F.col("overlap_s"), "d_seq"))
    return found.groupBy(*by).agg(F.sum("n").alias("matches"), best.alias("__best")).select(*by, "matches", "__best.*")
