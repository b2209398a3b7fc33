"""Every dashboard number, for all runs at once.

Each function returns one row set keyed by `run_id`, so the same call answers
one run (filter the inputs) or the whole fleet.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aislemetry.functions import geometry as G
from aislemetry.functions import labels as L
from aislemetry.functions import timebuckets as TB
from aislemetry.operators.asof import exists_within, nearest
from aislemetry.operators.ordered import NextValid, Prev, RunSum, holds_rank, resolve, scan, weighted_ranks
from aislemetry.operators.thinning import throttle
from aislemetry.schema import store_keys, with_run, with_store

GRID_W, GRID_H = 16, 12
RUN = "run_id"


def between(df, t0=None, t1=None, t="t"):
    """Half-open time filter."""
    if t0 is not None:
        df = df.where(F.col(t) >= t0)
    if t1 is not None:
        df = df.where(F.col(t) < t1)
    return df


# --- live and footfall -------------------------------------------------------
def live_summary(runs, occupancy):
    last = occupancy.groupBy(RUN).agg(F.max_by("count", F.struct("t", "seq")).alias("count"),
                                      F.max("t").alias("occupancy_t"))
    return runs.select(RUN).distinct().join(last, RUN, "left").select(
        RUN, F.coalesce("count", F.lit(0)).alias("occupancy"), "occupancy_t")


def footfall_by_hour(tripwire, day=None, tz="UTC", zero_fill=False):
    """Entries per hour of the local day. `day` (epoch seconds) picks one day."""
    e = tripwire.where(F.col("dir") == "in")
    start = TB.local_midnight(F.col("t"), tz)
    if day is not None:
        lo = TB.local_midnight(F.lit(float(day)), tz)
        e, start = e.where((F.col("t") >= lo) & (F.col("t") < lo + 86400)), lo
    e = e.select(RUN, start.alias("day_start"),
                 F.floor((F.col("t") - start) / 3600).cast("bigint").alias("hour"))
    n = e.groupBy(RUN, "day_start", "hour").agg(F.count("*").alias("entries"))
    if not zero_fill:
        return n
    spine = n.select(RUN, "day_start").distinct().withColumn(
        "hour", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(23).cast("bigint"))))
    return spine.join(n, [RUN, "day_start", "hour"], "left").fillna(0, ["entries"])


def footfall_last_day(tripwire, window, tz="UTC"):
    """All 24 hours of the local day on which each run ended; hours and runs without entries are 0."""
    day = with_now(window.select(RUN), window).withColumn("day_start", TB.local_midnight(F.col("now"), tz))
    e = tripwire.where(F.col("dir") == "in").join(day, RUN).where(
        (F.col("t") >= F.col("day_start")) & (F.col("t") < F.col("day_start") + 86400))
    n = e.groupBy(RUN, F.floor((F.col("t") - F.col("day_start")) / 3600).cast("bigint").alias("hour")).agg(
        F.count("*").alias("entries"))
    spine = day.select(RUN, "day_start", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.lit(23).cast("bigint"))).alias("hour"))
    return spine.join(n, [RUN, "hour"], "left").fillna(0, ["entries"])


def footfall_peak(tripwire, day=None, tz="UTC"):
    """Busiest hour (the earliest on a tie) and the mean over all 24 hours."""
    h = footfall_by_hour(tripwire, day, tz, zero_fill=True)
    return h.groupBy(RUN, "day_start").agg(
        F.min_by("hour", F.struct(-F.col("entries"), "hour")).alias("peak_hour"),
        F.max("entries").alias("peak_entries"),
        F.round(F.sum("entries") / 24, 1).alias("avg_per_hour"))


def footfall_by_day(tripwire, n=7):
    """Entries per UTC day, the newest `n` days that have any."""
    d = (tripwire.where(F.col("dir") == "in").groupBy(RUN, TB.utc_day(F.col("t")).alias("day"))
         .agg(F.count("*").alias("entries")))
    w = Window.partitionBy(RUN).orderBy(F.col("day").desc())
    return d.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def footfall_totals(runs, tripwire):
    n = tripwire.groupBy(RUN).agg(F.count_if(F.col("dir") == "in").alias("entries"),
                                  F.count_if(F.col("dir") == "out").alias("exits"))
    n = runs.select(RUN).distinct().join(n, RUN, "left").fillna(0, ["entries", "exits"])
    return n.withColumn("net", F.col("entries") - F.col("exits"))


def run_window(runs, occupancy, tripwire, shelf_fill, visit):
    """First and last time over the four event tables."""
    parts = [d.groupBy(RUN).agg(F.min(c).alias("a"), F.max(c).alias("b"))
             for d, c in ((occupancy, "t"), (tripwire, "t"), (shelf_fill, "t"), (visit, "t_exit"))]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    w = u.groupBy(RUN).agg(F.min("a").alias("t0"), F.max("b").alias("t1"))
    return runs.select(RUN).distinct().join(w, RUN, "left")


def footfall_spark(tripwire, window, buckets=12):
    """Entries in equal slices of the run window; the last slice absorbs overflow.

    `window` holds run_id, t0, t1; the end is one second past the last event.
    """
    w = window.select(RUN, F.coalesce("t0", F.lit(0.0)).alias("t0"),
                      (F.coalesce("t1", F.lit(0.0)) + 1.0).alias("t1"))
    width = F.greatest((F.col("t1") - F.col("t0")) / buckets, F.lit(1e-6))
    # Only the hot time column crosses the join; counts are formed per second
    # first so that a busy run arrives pre-aggregated.
    per_t = tripwire.where(F.col("dir") == "in").groupBy(RUN, "t").agg(F.count("*").alias("__n"))
    b = per_t.join(w, RUN).select(
        RUN, F.least(F.lit(buckets - 1), F.floor((F.col("t") - F.col("t0")) / width))
        .cast("bigint").alias("bucket"), "__n")
    n = b.groupBy(RUN, "bucket").agg(F.sum("__n").alias("entries"))
    spine = w.select(RUN, F.explode(F.sequence(F.lit(0).cast("bigint"),
                                               F.lit(buckets - 1).cast("bigint"))).alias("bucket"))
    return spine.join(n, [RUN, "bucket"], "left").fillna(0, ["entries"])


# --- dwell -------------------------------------------------------------------
def dwell_by_zone(visit, t0=None, t1=None, chunk_s="auto"):
    """Visits, upper median and nearest-rank p90 of the dwell per zone.

    Equal dwells are one weighted row before any rank is formed, so a value that
    every visit shares is one row; ranks come from a running sum of the weights.
    """
    v = between(visit, t0, t1, "t_enter").where(F.col("dwell_s").isNotNull())
    keys = [RUN, "zone"]
    v = weighted_ranks(v, keys, "dwell_s", chunk_s)
    median = holds_rank(F.floor(F.col("__n") / 2) + 1)
    p90 = holds_rank(F.ceil((F.col("__n") * 9) / 10))
    return v.where(median | p90).groupBy(*keys).agg(
        F.max("__n").alias("visits"), F.max(F.when(median, F.col("dwell_s"))).alias("median_dwell_s"),
        F.max(F.when(p90, F.col("dwell_s"))).alias("p90_dwell_s"))


def shopper_totals(visit):
    """Per run: shoppers, mean of each one's longest stay, browsed and engaged."""
    s = visit.groupBy(RUN, "track_id").agg(F.max("dwell_s").alias("longest"),
                                           F.sum("dwell_s").alias("total"))
    return s.groupBy(RUN).agg(
        F.count("*").alias("shoppers"), F.round(F.avg("longest"), 1).alias("avg_dwell_s"),
        F.count_if(F.coalesce("longest", F.lit(0.0)) >= 5).alias("browsed"),
        F.count_if(F.coalesce("total", F.lit(0.0)) >= 30).alias("engaged"))


# --- heatmap -----------------------------------------------------------------
def heatmap(tiles, t0=None, t1=None):
    """Largest cumulative count per cell over a closed range of minutes."""
    h = tiles
    if t0 is not None:
        h = h.where(F.col("t_bucket") >= int(t0 // 60))
    if t1 is not None:
        h = h.where(F.col("t_bucket") <= int(t1 // 60))
    return h.groupBy(RUN, "gx", "gy").agg(F.max("count").alias("count"))


def heatmap_points(points, matrix):
    """Image points to floor cells."""
    x, y = G.image_to_floor(matrix, F.col("u"), F.col("v"))
    gx, gy = G.heatmap_index(x, y)
    return points.select(RUN, "t", gx.alias("gx"), gy.alias("gy"))


def heatmap_accumulate(cells, frames=None, publish_s=None, chunk_s="auto"):
    """Cumulative samples per cell and minute.

    By default one row per cell and minute that gained samples. With `publish_s`
    the stored table is reproduced: the first frame time only arms the clock, and
    each minute holds, for every cell seen so far, the total at its last publish.
    """
    w = Window.partitionBy(RUN, "gx", "gy").orderBy("t_bucket").rowsBetween(
        Window.unboundedPreceding, 0)
    if publish_s is None:
        n = cells.groupBy(RUN, "gx", "gy", TB.minute_index(F.col("t")).alias("t_bucket")).agg(
            F.count("*").alias("n"))
        return n.withColumn("count", F.sum("n").over(w)).drop("n")
    frames = (cells if frames is None else frames).select(RUN, "t").distinct()
    chunk_s = resolve(chunk_s, frames, [RUN])
    ticks = throttle(frames, [RUN], ["t"], publish_s)
    ticks = scan(ticks, [RUN], ["t"], {"__p": Prev(F.col("t"))}, chunk_s)
    ticks = ticks.where(F.col("__p").isNotNull()).select(RUN, "t")
    # A sample first shows at the next publish at or after it.
    line = (cells.select(RUN, "t", F.lit(0).alias("__o"), "gx", "gy")
            .unionByName(ticks.withColumn("__o", F.lit(1)), allowMissingColumns=True))
    line = scan(line, [RUN], ["t", "__o"],
                {"__tick": NextValid(F.when(F.col("__o") == 1, F.col("t")))},
                resolve(chunk_s, line, [RUN]))
    gained = (line.where((F.col("__o") == 0) & F.col("__tick").isNotNull())
              .groupBy(RUN, "gx", "gy", TB.minute_index(F.col("__tick")).alias("t_bucket"))
              .agg(F.count("*").alias("n")))
    minutes = ticks.select(RUN, TB.minute_index(F.col("t")).alias("t_bucket")).distinct()
    since = gained.groupBy(RUN, "gx", "gy").agg(F.min("t_bucket").alias("__first"))
    dense = since.join(minutes, RUN).where(F.col("t_bucket") >= F.col("__first")).drop("__first")
    full = dense.join(gained, [RUN, "gx", "gy", "t_bucket"], "left").fillna(0, ["n"])
    return full.withColumn("count", F.sum("n").over(w)).drop("n")


def heatmap_live(cells, now=None, decay=0.98, chunk_s="auto"):
    """Decayed presence per cell at `now` (default: each run's last frame).

    A sample decays from the frame before its own, the first frame from itself.
    Cells at or below 0.01 are dropped.
    """
    frames = cells.select(RUN, "t").distinct()
    frames = scan(frames, [RUN], ["t"], {"__p": Prev(F.col("t"))},
                  resolve(chunk_s, frames, [RUN]))
    n = cells.groupBy(RUN, "t", "gx", "gy").agg(F.count("*").alias("n"))
    n = n.join(frames, [RUN, "t"]).withColumn("__from", F.coalesce("__p", "t"))
    if now is None:
        last = cells.groupBy(RUN).agg(F.max("t").alias("__now"))
        n = n.join(last, RUN)
    else:
        n = n.withColumn("__now", F.lit(float(now)))
    v = F.sum(F.col("n") * F.pow(F.lit(decay), F.col("__now") - F.col("__from")))
    return (n.groupBy(RUN, "gx", "gy").agg(v.alias("__v")).where(F.col("__v") > 0.01)
            .select(RUN, "gx", "gy", F.round("__v", 3).alias("value")))


def floor_bounds(zones=None):
    """Extent in cells from zone polygons (plain numbers), or None."""
    if not zones:
        return None
    xs = [p[0] / 0.25 for _, poly in zones for p in poly]
    ys = [p[1] / 0.25 for _, poly in zones for p in poly]
    return min(xs), max(max(xs), min(xs) + 1), min(ys), max(max(ys), min(ys) + 1)


def _grid_cell(gx, gy, x0, x1, y0, y1):
    cx = (gx - x0) / F.greatest(x1 - x0, F.lit(1e-9)) * (GRID_W - 1)
    cy = (GRID_H - 1) - (gy - y0) / F.greatest(y1 - y0, F.lit(1e-9)) * (GRID_H - 1)
    return cx, cy


def heatmap_grid(tiles, bounds=None):
    """Dense 16x12 grid, row 0 at the far end, sqrt-scaled to 0..1.

    `bounds` are floor bounds in cells; without them each run's tiles set them.
    """
    if bounds is None:
        b = tiles.groupBy(RUN).agg(
            F.min("gx").cast("double").alias("x0"), F.max("gx").cast("double").alias("x1"),
            F.min("gy").cast("double").alias("y0"), F.max("gy").cast("double").alias("y1"))
        b = b.withColumns({"x1": F.greatest("x1", F.col("x0") + 1),
                           "y1": F.greatest("y1", F.col("y0") + 1)})
        g = tiles.join(b, RUN)
    else:
        g = tiles.withColumns(dict(zip(("x0", "x1", "y0", "y1"), map(F.lit, map(float, bounds)))))
    cx, cy = _grid_cell(F.col("gx"), F.col("gy"), *[F.col(c) for c in ("x0", "x1", "y0", "y1")])

    def clamp(v, top):
        return F.least(F.lit(top - 1), F.greatest(F.lit(0), F.bround(v, 0))).cast("bigint")

    g = g.groupBy(RUN, clamp(cy, GRID_H).alias("row"), clamp(cx, GRID_W).alias("col")).agg(
        F.sum("count").alias("n"))
    spine = (g.select(RUN).distinct()
             .withColumn("row", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(GRID_H - 1).cast("bigint"))))
             .withColumn("col", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(GRID_W - 1).cast("bigint")))))
    full = spine.join(g, [RUN, "row", "col"], "left").fillna(0, ["n"])
    top = F.max("n").over(Window.partitionBy(RUN))
    return full.select(RUN, "row", "col", F.round(F.sqrt(F.coalesce(
        F.try_divide(F.col("n"), F.when(top != 0, top)), F.lit(0.0))), 3).alias("heat"))


def zone_labels(zones: DataFrame, bounds):
    """Where each zone's name sits over the grid, in percent."""
    def mean(i):
        total = F.aggregate("polygon", F.lit(0.0), lambda s, p: s + p[i])
        return total / F.size("polygon") / 0.25

    cx, cy = _grid_cell(mean(0), mean(1), *[F.lit(float(b)) for b in bounds])

    def percent(v, top):
        return F.round(F.least(F.lit(92.0), F.greatest(F.lit(2.0), v / (top - 1) * 100)), 1)

    return zones.select(F.col("id").alias("name"), percent(cx, GRID_W).alias("left"),
                        percent(cy, GRID_H).alias("top"))


# --- shelf -------------------------------------------------------------------
def planogram_rates(planogram):
    """sku (of a store) -> revenue per hour; a repeated sku keeps its last entry."""
    keys = [c for c in ("store_id", "sku") if c in planogram.columns]
    last = planogram.groupBy(*keys).agg(F.max_by(
        F.struct("expected_sales_per_hour", "unit_price"), "position").alias("p"))
    return last.select(*keys, (F.coalesce("p.expected_sales_per_hour", F.lit(0.0))
                               * F.coalesce("p.unit_price", F.lit(0.0))).alias("rate"))


def planogram_lookup(stockout, planogram):
    """Left join of incidents to their revenue rate, 0 when unknown.

    No broadcast hint: the size of both sides decides, and AQE splits hot skus.
    """
    return stockout.join(planogram_rates(planogram), store_keys(stockout, planogram, "sku"), "left").withColumn(
        "rate", F.coalesce("rate", F.lit(0.0)))


def stockout_durations(stockout, t0=None, t1=None):
    s = between(stockout, t0, t1, "t_start").where(F.col("t_end").isNotNull())
    return s.select(RUN, "roi", "sku", "t_start", "t_end",
                    (F.col("t_end") - F.col("t_start")).alias("duration_s"))


def with_now(df, window):
    """Rows with `now`, one second past the last event of their run, which prices open incidents."""
    return with_run(df, window.select(RUN, (F.coalesce("t1", F.lit(0.0)) + 1.0).alias("now")))


def open_stockout_flag(shelf, stockout):
    """Add `stockout`: the facing has an incident without an end."""
    still = (stockout.where(F.col("t_end").isNull()).select(RUN, "roi").distinct()
             .withColumn("__open", F.lit(True)))
    return shelf.join(still, [RUN, "roi"], "left").withColumn(
        "stockout", F.coalesce("__open", F.lit(False))).drop("__open")


def shelf_latest(shelf_fill, stockout):
    """Latest fill per facing and whether it is out of stock."""
    last = shelf_fill.groupBy(RUN, "roi").agg(
        F.max("t").alias("t"), F.max_by("fill", F.struct("t", "seq")).alias("fill"))
    return open_stockout_flag(last, stockout)


def shelf_board(shelf_fill, stockout, rois=None, run=None, planogram=None):
    """Latest facings with their display state; an open incident forces empty.

    With `rois` or `planogram` per store, `run` tells the store of each run. A `planogram` adds the sku and name of
    the facing; of a repeated facing the last entry counts, an unknown one has neither.
    """
    s = shelf_latest(shelf_fill, stockout)
    if planogram is not None:
        out = shelf_board(shelf_fill, stockout, rois, run)
        out = with_store(out, run) if run is not None and "store_id" in planogram.columns else out
        on = store_keys(out, planogram, "facing")
        item = planogram.groupBy(*on).agg(F.max_by(F.struct("sku", "name"), "position").alias("__i")).select(
            *on, "__i.*").withColumnRenamed("facing", "roi")
        return out.join(item, ["roi" if k == "facing" else k for k in on], "left").select(
            RUN, "roi", "fill", "state", "sku", "name")
    if rois is not None:
        s = with_store(s, run) if run is not None and "store_id" in rois.columns else s
        on = store_keys(s, rois, "roi")
        s = s.join(rois.select(*on, "empty_below", "low_below"), on, "left")
    else:
        s = s.withColumns({"empty_below": F.lit(None).cast("int"), "low_below": F.lit(None).cast("int")})
    state = L.shelf_state(F.col("fill"), F.coalesce("empty_below", F.lit(60)),
                          F.coalesce("low_below", F.lit(110)))
    return s.select(RUN, "roi", F.floor("fill").cast("bigint").alias("fill"),
                    F.when(F.col("stockout"), "empty").otherwise(state).alias("state"))


def _lost(stockout, planogram, keys, now):
    end = F.coalesce("t_end", F.lit(float(now)) if not isinstance(now, str) else F.col(now))
    seconds = F.greatest(F.lit(0.0), end - F.col("t_start"))
    # Time is summed per sku before the lookup, so a hot sku reaches the join as
    # one row per run; the money is added as decimals, independent of task order.
    per = stockout.groupBy(*dict.fromkeys([*keys, *store_keys(stockout, planogram, "sku")])).agg(F.sum(seconds).alias("__s"))
    money = (F.col("__s") / 3600.0 * F.col("rate")).cast("decimal(30,6)")
    return planogram_lookup(per, planogram).groupBy(*keys).agg(
        F.round(F.sum(money).cast("double"), 2).alias("lost_revenue"))


def lost_revenue(stockout, planogram, now):
    """Sales missed while facings were empty; open incidents count up to `now`."""
    return _lost(stockout, planogram, [RUN], now)


def lost_revenue_by_facing(stockout, planogram, now):
    return _lost(stockout, planogram, [RUN, "roi"], now)


def recent_stockouts(stockout, planogram, now, n=20):
    """The newest `n` incidents of each run with their cost so far."""
    w = Window.partitionBy(RUN).orderBy(F.col("t_start").desc(), "roi", "sku", "t_end")
    top = stockout.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")
    end = F.coalesce("t_end", F.lit(float(now)) if not isinstance(now, str) else F.col(now))
    hours = F.greatest(F.lit(0.0), end - F.col("t_start")) / 3600.0
    return planogram_lookup(top, planogram).select(
        RUN, F.col("roi").alias("facing"), "sku", F.round(end - F.col("t_start"), 1).alias("duration_s"),
        F.round(hours * F.col("rate"), 2).alias("lost"),
        F.when(F.col("t_end").isNotNull(), "resolved").otherwise("active").alias("status"))


def replenishment_list(stockout, planogram, k=None):
    """Open incidents, dearest first; `k` keeps the top of each run."""
    s = planogram_lookup(stockout.where(F.col("t_end").isNull()), planogram).select(
        RUN, "roi", "sku", "t_start", F.col("rate").alias("revenue_rate"))
    if k is None:
        return s
    w = Window.partitionBy(RUN).orderBy(F.col("revenue_rate").desc(), "t_start", "roi", "sku")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def compliance_score(status, planogram):
    """Share of planogram facings that read normal; a missing one does not."""
    runs = status.select(RUN).distinct()
    last = status.groupBy(RUN, "roi").agg(F.max_by("status", F.struct("t", "seq")).alias("status"))
    plan = planogram.select(F.col("facing").alias("roi")).distinct()
    if "store_id" in planogram.columns:
        return _compliance_by_store(status, planogram)
    n = plan.agg(F.count("*")).scalar()
    ok = last.where(F.col("status") == "normal").join(plan, "roi", "left_semi").groupBy(RUN).agg(
        F.count("*").alias("__ok"))
    share = F.try_divide(F.coalesce("__ok", F.lit(0)) * 100.0, n)
    return runs.join(ok, RUN, "left").select(
        RUN, F.coalesce(F.round(share, 1), F.lit(100.0)).alias("compliance"))


def _compliance_by_store(status, planogram):
    """The same with a planogram per store: a run answers for the facings of its store."""
    last = status.groupBy(RUN, "store_id", "roi").agg(F.max_by("status", F.struct("t", "seq")).alias("status"))
    facings = status.select(RUN, "store_id").distinct().join(
        planogram.select("store_id", F.col("facing").alias("roi")).distinct(), "store_id", "left")
    read = facings.join(last, [RUN, "store_id", "roi"], "left")
    return read.groupBy(RUN).agg(F.coalesce(F.round(F.try_divide(
        F.count_if(F.col("status") == "normal") * 100.0, F.count("roi")), 1), F.lit(100.0)).alias("compliance"))


def inventory_summary(commits, status, stock):
    """Initial, current and removed items per facing, and their value.

    With `stock` per store every facing of the run's store is listed; else those that were read.
    """
    if "store_id" in stock.columns:
        facings = status.select(RUN, "store_id").distinct().join(stock, "store_id")
    else:
        facings = status.select(RUN, "roi").distinct().join(stock, "roi")
    gone = commits.groupBy(RUN, "roi").agg(F.sum("removed").alias("removed"))
    s = facings.join(gone, [RUN, "roi"], "left").withColumn("removed", F.coalesce("removed", F.lit(0)))
    return s.select(RUN, "roi", F.col("initial_stock").alias("initial"),
                    (F.col("initial_stock") - F.col("removed")).alias("current"), "removed",
                    F.round(F.col("removed") * F.col("unit_price"), 2).alias("taken_value"))


# --- queue, sales, conversion ------------------------------------------------
def queue_status(queue_estimate):
    """Latest estimate per lane; every row of a tied instant is kept.

    The maximum is formed per lane first and joined back, so no lane is ever
    sorted as a whole.
    """
    last = queue_estimate.groupBy(RUN, "lane").agg(F.max("t").alias("t"))
    return queue_estimate.select(RUN, "lane", "t", "count", "pred_wait_s").join(
        last, [RUN, "lane", "t"], "left_semi")


def wait_pred_vs_actual(queue_truth, queue_estimate, t0=None, t1=None, by_lane=False,
                        chunk_s="auto"):
    """Each truth row with the prediction of its run that is nearest in time.

    A truth row's `clip` is the run that it was labelled for. By default the lane is ignored; `by_lane` matches
    within it.
    """
    keys = ["clip", "lane"] if by_lane else ["clip"]
    pred = between(queue_estimate, t0, t1).select(F.col(RUN).alias("clip"), "lane", "t", "seq", "pred_wait_s")
    if not by_lane:
        pred = pred.drop("lane")
    m = nearest(between(queue_truth, t0, t1), pred, keys, right_seq="seq", chunk_s=chunk_s)
    m = m.where(F.col("near").isNotNull())
    return m.select("clip", "t", "lane", F.col("near.pred_wait_s").alias("pred_wait_s"), "actual_wait_s",
                    (F.col("near.pred_wait_s") - F.col("actual_wait_s")).alias("error_s"))


def wait_mae(rows):
    return rows.agg(F.round(F.avg(F.abs("error_s")), 6).alias("mae_s"), F.count("*").alias("n"))


def revenue(pos_txn):
    return pos_txn.groupBy(RUN).agg(F.count("*").alias("transactions"),
                                    F.round(F.sum("amount"), 2).alias("revenue"))


def convert_by_txn(visit, pos_txn, mapping=None, chunk_s="auto"):
    """Visits of 5 s or more, `converted` when a sale of their zone follows.

    The sale must lie between entry and 15 minutes after exit. `mapping`
    (source, zone) turns a hint into a zone first.
    """
    v = visit.where(F.col("dwell_s") >= 5).withColumn("__hi", F.col("t_exit") + 900.0)
    store = [c for c in ("store_id",) if mapping is not None and c in mapping.columns]
    x = pos_txn.select(RUN, *store, "t", F.col("zone_hint").alias("zone"))
    if mapping is not None:
        on = store_keys(x, mapping, "source")
        x = x.withColumnRenamed("zone", "source").join(mapping.select(*on, "zone"), on, "left")
    x = x.where(F.col("zone").isNotNull()).select(RUN, "t", "zone")
    return exists_within(v, x, [RUN, "zone"], "t_enter", "__hi", flag="converted",
                         chunk_s=chunk_s).drop("__hi")


def convert_by_shelf(visit, shelf_fill, mapping, max_fill=30.0, drop=None, chunk_s="auto"):
    """Visits of 5 s or more, `converted` when a low reading of their zone is near.

    Near is from 60 s before entry to 60 s after exit. With `drop`, a fall of at
    least that much since the facing's previous reading counts instead.
    """
    on = store_keys(shelf_fill, mapping, "roi")
    f = shelf_fill.join(mapping.withColumn("roi", F.col("source")).select(*on, "zone"), on).select(
        RUN, "roi", "zone", "t", "seq", "fill")
    if drop is None:
        f = f.where(F.col("fill") <= max_fill)
    else:
        keys = [RUN, "roi"]
        f = scan(f, keys, ["t", "seq"], {"__p": Prev(F.col("fill"))}, resolve(chunk_s, f, keys))
        f = f.where(F.col("__p") - F.col("fill") >= drop)
    v = visit.where(F.col("dwell_s") >= 5).withColumns({
        "__lo": F.col("t_enter") - 60.0, "__hi": F.col("t_exit") + 60.0})
    return exists_within(v, f.select(RUN, "zone", "t"), [RUN, "zone"], "__lo", "__hi",
                         flag="converted", chunk_s=chunk_s).drop("__lo", "__hi")


def classify_visits(visit, pos_txn, shelf_fill=None, mapping=None, chunk_s="auto"):
    """Counted visits with the conversion flag of either source and a label."""
    v = convert_by_txn(visit, pos_txn, mapping, chunk_s)
    if shelf_fill is not None and mapping is not None:
        v = convert_by_shelf(v.withColumnRenamed("converted", "__by_txn"), shelf_fill, mapping,
                             chunk_s=chunk_s)
        v = v.withColumn("converted", F.col("converted") | F.col("__by_txn")).drop("__by_txn")
    return v.withColumn("label", L.engagement_label(F.col("dwell_s"), F.col("converted")))


def conversion_by_zone(classified):
    return classified.groupBy(RUN, "zone").agg(
        F.count("*").alias("visits"), F.count_if("converted").alias("conversions"),
        F.round(F.avg(F.col("converted").cast("int")), 6).alias("rate"))


def conversion_overall(classified):
    return classified.groupBy(RUN).agg(
        F.round(F.avg(F.col("converted").cast("int")), 6).alias("rate"))


def funnel(runs, tripwire, visit, occupancy, pos_txn):
    """Footfall, browsed, engaged, picked up; percentages capped at 100."""
    j = (footfall_totals(runs, tripwire).join(live_summary(runs, occupancy), RUN, "left")
         .join(shopper_totals(visit), RUN, "left").join(revenue(pos_txn), RUN, "left"))
    foot = F.greatest("entries", F.coalesce("shoppers", F.lit(0)), F.col("occupancy"))
    j = j.select(RUN, foot.alias("footfall"), F.coalesce("browsed", F.lit(0)).alias("browsed"),
                 F.coalesce("engaged", F.lit(0)).alias("engaged"),
                 F.coalesce("transactions", F.lit(0)).alias("picked_up"))
    steps = ("footfall", "browsed", "engaged", "picked_up")
    names = dict(zip(steps, ("Footfall", "Browsed", "Engaged", "Picked up")))
    rows = F.explode(F.array(*[F.struct(
        F.lit(i).cast("bigint").alias("step"), F.lit(names[s]).alias("label"),
        F.col(s).cast("bigint").alias("value"),
        (F.lit(100.0) if i == 0 else L.pct_capped(F.col(s), F.col("footfall"))).alias("pct"))
        for i, s in enumerate(steps)]))
    return j.select(RUN, rows.alias("r")).select(RUN, "r.*")


# --- alerts, stores, rollups -------------------------------------------------
def alerts(alert, open_only=True, n=None):
    """Newest first; `n` keeps the newest of each run."""
    a = alert.where(F.col("acked") == 0) if open_only else alert
    if n is None:
        return a
    w = Window.partitionBy(RUN).orderBy(F.col("t").desc(), F.col("seq").desc())
    return a.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def stores(runs):
    return runs.select("store_id").distinct()


def store_rollup(runs, tripwire, visit, pos_txn, stockout):
    """The same counters by run, by store and overall (NULL marks a total)."""
    per = (runs.select("store_id", RUN)
           .join(tripwire.groupBy(RUN).agg(F.count_if(F.col("dir") == "in").alias("entries"),
                                           F.count_if(F.col("dir") == "out").alias("exits")), RUN, "left")
           .join(visit.groupBy(RUN).agg(F.count("*").alias("visits")), RUN, "left")
           .join(pos_txn.groupBy(RUN).agg(F.count("*").alias("sales"),
                                          F.sum("amount").alias("amount")), RUN, "left")
           .join(stockout.groupBy(RUN).agg(F.count("*").alias("stockouts")), RUN, "left"))
    cols = ("entries", "exits", "visits", "sales", "stockouts")
    return per.rollup("store_id", RUN).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cols],
        F.round(F.coalesce(F.sum("amount"), F.lit(0.0)), 2).alias("amount"))


def kpi_15m(tripwire, occupancy, pos_txn, queue_estimate):
    """Long table of 15-minute figures: run_id, t_bucket, key, value."""
    def part(df, key, value):
        return df.groupBy(RUN, TB.quarter_start(F.col("t")).alias("t_bucket")).agg(
            F.round(value, 6).cast("double").alias("value")).withColumn("key", F.lit(key))

    parts = [part(tripwire.where(F.col("dir") == "in"), "entries", F.count("*")),
             part(tripwire.where(F.col("dir") == "out"), "exits", F.count("*")),
             part(occupancy, "occupancy_avg", F.avg("count")),
             part(pos_txn, "sales", F.count("*")),
             part(pos_txn, "revenue", F.sum("amount")),
             part(queue_estimate, "wait_max_s", F.max("pred_wait_s"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(RUN, "t_bucket", "key", "value")


def littles_law_dwell(occupancy, tripwire, window_s=3600):
    """Mean stay per window: mean occupancy over the arrival rate."""
    b = (F.floor(F.col("t") / window_s) * window_s).cast("bigint").alias("t_bucket")
    occ = occupancy.groupBy(RUN, b).agg(F.avg("count").alias("__l"))
    arr = tripwire.where(F.col("dir") == "in").groupBy(RUN, b).agg(F.count("*").alias("__n"))
    return occ.join(arr, [RUN, "t_bucket"]).select(
        RUN, "t_bucket", F.round(F.try_divide(F.col("__l") * window_s, F.col("__n")), 6).alias("dwell_s"))


def fit_count_regression(pairs, x="x", y="y", keys=(RUN,)):
    """Least squares count ~ a*x + b, with r2 and MAE.

    A constant x gives a = 0 and b = mean; a constant y gives r2 = 1.
    """
    keys = list(keys)
    p = pairs.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    f = p.groupBy(*keys).agg(
        F.regr_sxx("y", "x").alias("sxx"), F.regr_sxy("y", "x").alias("sxy"),
        F.regr_syy("y", "x").alias("syy"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    a = F.when(F.col("sxx") == 0, F.lit(0.0)).otherwise(F.try_divide("sxy", "sxx"))
    f = f.select(*keys, a.alias("a"), "mx", "my", "sxx", "sxy", "syy").withColumn(
        "b", F.when(F.col("sxx") == 0, F.col("my")).otherwise(F.col("my") - F.col("a") * F.col("mx")))
    rest = F.col("syy") - F.col("a") * F.col("sxy")
    f = f.withColumn("r2", F.when(F.col("syy") == 0, 1.0).otherwise(1.0 - F.try_divide(rest, F.col("syy"))))
    e = p.join(f.select(*keys, "a", "b"), keys)
    mae = e.groupBy(*keys).agg(F.avg(F.abs(F.col("y") - (F.col("a") * F.col("x") + F.col("b")))).alias("mae"))
    full = f.join(mae, keys)
    return full.select(*keys, *[F.round(c, 6).alias(c) for c in ("a", "b", "r2", "mae")])
