"""Ordered per-entity analytics in batch form.

Every function takes rows ordered by `(t, seq)` within its key and is built from
the balanced scans in `ordered`. `chunk_s` is "auto" (measure), a number of
seconds, or None (each key fits one task).
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aislemetry.functions import geometry as G
from aislemetry.functions import queueing as Q
from aislemetry.operators.ordered import (First, LastValid, Next, NextValid, Prev, RunMin, RunSum,
                                          Tail, WholeMax, WholeSum, ema, key_changes, resolve, scan)
from aislemetry.operators.thinning import throttle
from aislemetry.schema import dealt_join, store_keys
from aislemetry.session import cut

ORDER = ("t", "seq")

# Rule table (severity, cooldown seconds).
ALERT_RULES = {
    "stockout": ("warning", 60.0),
    "stockout_long": ("critical", 300.0),
    "wait_over": ("warning", 60.0),
    "occupancy_over": ("info", 60.0),
    "clock_unsynced": ("info", 3600.0),
}


def visits(obs: DataFrame, debounce=1.0, min_visit=2.0, keys=("run_id", "track_id"),
           track_end: DataFrame | None = None, chunk_s="auto") -> DataFrame:
    """Hysteresis sessions: a zone is believed after `debounce` seconds in a row.

    Runs of one zone (NULL is a zone of its own) shorter than the debounce change
    nothing; neighbouring believed runs of one zone merge; a visit ends when the
    next believed run starts, else at the end of the track (its last row, or
    `t_end` of `track_end` for deleted tracks).
    """
    keys = list(keys)
    chunk_s = resolve(chunk_s, obs, keys)
    zone = F.struct(F.col("zone").alias("z"))

    def changed(prev):
        return F.col(prev).isNull() | ~F.col(prev)["z"].eqNullSafe(F.col("zone"))

    rows = scan(obs.select(*keys, "t", "seq", "zone"), keys, ORDER, {"__p": Prev(zone)}, chunk_s)
    rows = rows.withColumn("__new", changed("__p").cast("bigint"))
    rows = scan(rows, keys, ORDER, {"__g": RunSum(F.col("__new"))}, chunk_s)
    islands = rows.groupBy(*keys, "__g").agg(
        F.first(zone).alias("__z"), F.min("t").alias("a"), F.max("t").alias("b"),
        F.count("*").alias("__rows"))
    islands = islands.select(*keys, F.col("__z.z").alias("zone"), "a", "b", "__rows")
    islands = scan(islands, keys, ["a"], {"__end": WholeMax(F.col("b"))}, chunk_s)
    # A second sight is needed even without a debounce.
    sure = islands.where((F.col("b") - F.col("a") >= debounce) & (F.col("__rows") > 1))
    sure = scan(sure, keys, ["a"], {"__p": Prev(zone)}, chunk_s).where(changed("__p"))
    out = scan(sure, keys, ["a"], {"__n": Next(F.col("a"))}, chunk_s)
    end = F.col("__end")
    if track_end is not None:
        out = out.join(track_end.select(*keys, "t_end"), keys, "left")
        end = F.coalesce("t_end", end)
    return (out.select(*keys, "zone", F.col("a").alias("t_enter"),
                       F.coalesce("__n", end).alias("t_exit"))
            .withColumn("dwell_s", F.col("t_exit") - F.col("t_enter"))
            .where(F.col("zone").isNotNull() & (F.col("dwell_s") >= min_visit)))


def crossings(points: DataFrame, wires: DataFrame, band=12.0, debounce=2.0,
              keys=("run_id", "track_id"), chunk_s="auto") -> DataFrame:
    """Line crossings with a dead band on both sides of each wire.

    points: keys, stream, t, seq, u, v and optionally `t_emit`, the time at which
    a replayed birth point is judged. wires: wire_id, stream, q1, q2 (arrays),
    in_dir, and store_id where stores have their own. The first point fixes a side for free; the other side commits only
    outside the band; the segment from the last point on the old side must
    properly cross the wire; then one crossing per key and wire per `debounce`.
    """
    keys = list(keys)
    chunk_s = resolve(chunk_s, points, keys)
    emit = F.col("t_emit") if "t_emit" in points.columns else F.col("t")
    p = dealt_join(points.withColumn("t_emit", emit), wires, store_keys(points, wires, "stream"), [*keys, *ORDER])
    q1 = (F.col("q1")[0], F.col("q1")[1])
    q2 = (F.col("q2")[0], F.col("q2")[1])
    keys = [*keys, "wire_id"]
    p = (p.withColumn("__d", G.signed_distance(q1, q2, F.col("u"), F.col("v")))
         .withColumn("__s", F.when(F.col("__d") > 0, 1).otherwise(-1)))
    p = scan(p, keys, ORDER, {"__seen": Prev(F.lit(1))}, chunk_s)
    mark = F.when(F.col("__seen").isNull() | (F.abs("__d") >= band), F.col("__s"))
    p = p.withColumn("__m", mark)
    p = scan(p, keys, ORDER, {"__before": LastValid(F.col("__m"))}, chunk_s)
    p = p.withColumn("__after", F.coalesce("__m", "__before"))
    anchor = F.when(F.col("__s") == F.col("__after"), F.struct("u", "v"))
    p = scan(p, keys, ORDER, {"__a": LastValid(anchor)}, chunk_s)
    a, b = (F.col("__a.u"), F.col("__a.v")), (F.col("u"), F.col("v"))
    hit = (F.col("__before").isNotNull() & F.col("__m").isNotNull()
           & (F.col("__m") != F.col("__before")) & G.segments_cross(a, b, q1, q2))
    hits = p.where(hit).select(
        *keys, F.col("t_emit").alias("t"), "seq",
        G.crossing_direction(q1, q2, F.col("in_dir"),
                             G.side_of(q1, q2, F.col("u"), F.col("v")) > 0).alias("dir"))
    return throttle(hits, keys, ORDER, debounce)


def close_stockouts(events: DataFrame, keys=("run_id", "roi", "sku"), chunk_s="auto") -> DataFrame:
    """Pair starts and ends: an end closes the latest start that is still open.

    A running depth matches them like parentheses; ends without an open start
    are ignored, starts without an end stay open.
    """
    keys = list(keys)
    chunk_s = resolve(chunk_s, events, keys)
    step = F.when(F.col("kind") == "start", 1).otherwise(-1)
    e = events.select(*keys, "t", "seq", "kind", step.alias("__st"))
    e = scan(e, keys, ORDER, {"__run": RunSum(F.col("__st"))}, chunk_s)
    e = scan(e, keys, ORDER, {"__low": RunMin(F.col("__run"), False)}, chunk_s)
    low = F.least(F.lit(0), F.coalesce("__low", F.lit(0)))
    e = e.withColumn("__floor", low).where((F.col("kind") == "start")
                                           | (F.col("__run") >= F.col("__floor")))
    depth = F.col("__run") - F.col("__floor") + F.when(F.col("kind") == "end", 1).otherwise(0)
    e = scan(e.withColumn("__depth", depth), [*keys, "__depth"], ORDER,
             {"__n": Next(F.struct("kind", "t"))}, chunk_s)
    return e.where(F.col("kind") == "start").select(
        *keys, F.col("t").alias("t_start"),
        F.when(F.col("__n.kind") == "end", F.col("__n.t")).alias("t_end"))


def fill_status(fills: DataFrame, rois: DataFrame | None = None, alpha=0.35, hist=5,
                empty_below=60, low_below=110, keys=("run_id", "roi"), chunk_s="auto") -> DataFrame:
    """Smoothed fill, majority status over the last readings and its confidence.

    Thresholds come from `rois` (roi, empty_below, low_below, by store with store_id) when given.
    """
    keys = list(keys)
    chunk_s = resolve(chunk_s, fills, keys)
    raw = F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor("fill").cast("double")))
    f = fills.withColumn("raw_fill", raw)
    if rois is not None:
        on = store_keys(f, rois, "roi")
        f = f.join(rois.select(*on, "empty_below", "low_below"), on)
    else:
        f = f.withColumns({"empty_below": F.lit(empty_below), "low_below": F.lit(low_below)})
    f = ema(f, keys, ORDER, "raw_fill", alpha, "__smooth", chunk_s, blend_first=True)
    instant = (F.when(F.col("__smooth") <= F.col("empty_below"), "empty")
               .when(F.col("__smooth") <= F.col("low_below"), "low").otherwise("normal"))
    f = f.withColumn("__i", instant)
    f = scan(f, keys, ORDER, {"__h": Tail(F.col("__i"), hist)}, chunk_s)

    def votes(status):
        return F.size(F.filter("__h", lambda s: s == status))

    n, lo, em = votes("normal"), votes("low"), votes("empty")
    top = F.greatest(n, lo, em)
    leader = F.when(n == top, "normal").when(lo == top, "low").otherwise("empty")
    size = F.size("__h")
    f = f.withColumn("__m", F.when(top >= F.floor(size / 2) + 1, leader)).withColumn(
        "confidence", F.round(top / size, 2))
    f = scan(f, keys, ORDER, {"__c": LastValid(F.col("__m"), True)}, chunk_s)
    extra = [c for c in ("store_id",) if c in fills.columns and c not in keys]
    return f.select(*keys, *extra, "t", "seq", "raw_fill",
                    F.round("__smooth", 1).alias("smoothed_fill"),
                    F.coalesce("__c", F.lit("normal")).alias("status"), "confidence")


def shelf_incidents(status: DataFrame, keys=("run_id", "roi"), chunk_s="auto") -> DataFrame:
    """Stock-out start and end events plus the critical and low-stock alerts.

    `kind` is start, end, alert_out or alert_low. The low alert is latched until
    the facing is normal again; being empty does not re-arm it.
    """
    keys = list(keys)
    chunk_s = resolve(chunk_s, status, keys, measure=False)
    st = F.col("status")
    s = scan(status, keys, ORDER, {
        "__p": Prev(st), "__latch": LastValid(F.when(st.isin("low", "normal"), st))}, chunk_s)
    was_out = F.coalesce(F.col("__p") == "empty", F.lit(False))
    kinds = F.array_compact(F.array(
        F.when((st == "empty") & ~was_out, "start"),
        F.when((st == "empty") & ~was_out, "alert_out"),
        F.when((st != "empty") & was_out, "end"),
        F.when((st == "low") & ~F.coalesce(F.col("__latch") == "low", F.lit(False)), "alert_low")))
    return s.withColumn("kind", F.explode(kinds)).drop("__p", "__latch")


def incident_alerts(incidents: DataFrame, planogram: DataFrame) -> DataFrame:
    """Message rows for the two alert kinds of `shelf_incidents`."""
    plan = planogram.withColumn("roi", F.col("facing"))
    on = store_keys(incidents, plan, "roi")
    a = incidents.where(F.col("kind").isin("alert_out", "alert_low")).join(plan.select(*on, "sku", "name"), on)
    out = F.col("kind") == "alert_out"
    where = F.concat(F.col("name"), F.lit(" ("), F.col("sku").cast("string"),
                     F.lit(") at facing "), F.col("roi"))
    return a.select(
        "run_id", "t", F.when(out, "critical").otherwise("warning").alias("severity"),
        F.when(out, "stockout_detected").otherwise("low_stock_detected").alias("rule"),
        F.when(out, F.concat(F.lit("OUT OF STOCK: "), where))
        .otherwise(F.concat(F.lit("LOW STOCK: "), where, F.lit(" (fill "),
                            F.col("smoothed_fill").cast("string"), F.lit(")"))).alias("message"))


def planogram_violations(status: DataFrame, expected: DataFrame | None = None,
                         keys=("run_id", "roi"), chunk_s="auto") -> DataFrame:
    """A row each time a facing's problem changes; `ok` readings reset it.

    With `expected` (roi, sku) and a `sku` column on the readings, a wrong item on
    a normal facing counts as unknown.
    """
    keys = list(keys)
    chunk_s = resolve(chunk_s, status, keys, measure=False)
    wrong = F.lit(False)
    s = status
    if expected is not None:
        on = store_keys(s, expected, "roi")
        s = s.join(expected.select(*on, F.col("sku").alias("expected_sku")), on)
        if "sku" in status.columns:
            wrong = F.coalesce(F.col("sku") != F.col("expected_sku"), F.lit(False))
    observed = (F.when(F.col("status").isin("empty", "low"), F.col("status"))
                .when(wrong, "unknown").otherwise("ok"))
    s = s.where(F.col("status").isNotNull()).withColumn("observed", observed)
    s = scan(s, keys, ORDER, {"__p": Prev(F.col("observed"))}, chunk_s)
    keep = [*keys, "t", "seq", "observed"] + (["expected_sku"] if expected is not None else [])
    return s.where((F.col("observed") != "ok")
                   & ~F.col("observed").eqNullSafe(F.col("__p"))).select(*keep)


def one_incident(events: DataFrame, keys=("run_id", "roi"), chunk_s="auto") -> DataFrame:
    """Merge the start/end rows of two detectors into alternating incidents."""
    keys = list(keys)
    chunk_s = resolve(chunk_s, events, keys)
    e = scan(events, keys, ORDER, {"__p": Prev(F.col("kind"))}, chunk_s)
    return e.where(F.col("kind") != F.coalesce("__p", F.lit("end"))).drop("__p")


def one_alert(alerts: DataFrame, status: DataFrame, keys=("run_id", "roi"),
              rules=("stockout_detected", "low_stock_detected"), chunk_s="auto") -> DataFrame:
    """Stock alerts once per facing and rule until the facing reads normal."""
    keys = list(keys)
    names = F.array(*map(F.lit, rules))
    resets = (status.where(F.col("status") == "normal").select(*keys, "t")
              .distinct().withColumn("rule", F.explode(names))
              .withColumns({"seq": F.lit(-1).cast("bigint"), "__reset": F.lit(True)}))
    stock = alerts.where(F.col("rule").isin(*rules))
    both = stock.withColumn("__reset", F.lit(False)).unionByName(resets, allowMissingColumns=True)
    k = [*keys, "rule"]
    both = scan(both, k, ORDER, {"__p": Prev(F.col("__reset"))}, resolve(chunk_s, both, k, measure=False))
    kept = both.where(~F.col("__reset") & F.coalesce("__p", F.lit(True))).drop("__p", "__reset")
    return kept.unionByName(alerts.where(~F.col("rule").isin(*rules)))


def alert_candidates(stockouts, queue, occupancy, clock=None, target_wait_s=180.0, capacity=50,
                     long_s=300.0, chunk_s="auto") -> DataFrame:
    """Rule hits before cooldown: store_id, t, seq, rule, severity, message."""
    s = stockouts.select("store_id", "roi", "t", "seq", "kind")
    keys = ["store_id", "roi"]
    s = scan(s, keys, ORDER, {"__p": Prev(F.struct("kind", "t"))}, resolve(chunk_s, s, keys))
    length = F.col("t") - F.col("__p.t")

    def rows(df, rule, message):
        return df.select("store_id", "t", "seq", F.lit(rule).alias("rule"),
                         F.lit(ALERT_RULES[rule][0]).alias("severity"), message.alias("message"))

    parts = [
        rows(s.where(F.col("kind") == "start"), "stockout", F.concat("roi", F.lit(" empty"))),
        rows(s.where((F.col("kind") == "end") & (F.col("__p.kind") == "start") & (length > long_s)),
             "stockout_long", F.concat(F.col("roi"), F.lit(" empty for "),
                                       F.floor(length).cast("string"), F.lit("s"))),
        rows(queue.where(F.col("pred_wait_s") > target_wait_s), "wait_over", F.concat(
            F.lit("lane "), F.col("lane").cast("string"), F.lit(" predicted wait "),
            F.bround("pred_wait_s", 0).cast("bigint").cast("string"),
            F.lit(f"s > {float(target_wait_s)}s"))),
        rows(occupancy.where(F.col("count") > capacity), "occupancy_over", F.concat(
            F.lit("occupancy "), F.col("count").cast("string"), F.lit(f" > {capacity}"))),
    ]
    if clock is not None:
        parts.append(rows(clock, "clock_unsynced", F.lit("system clock is unsynced")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def alerts_from_events(stockouts, queue, occupancy, clock=None, target_wait_s=180.0, capacity=50,
                       rules=None, extra_keys=(), chunk_s="auto") -> DataFrame:
    """Alerts after each rule's cooldown, which holds for the whole store."""
    hits = alert_candidates(stockouts, queue, occupancy, clock, target_wait_s, capacity,
                            chunk_s=chunk_s)
    cooldown = {r: c for r, (_, c) in ALERT_RULES.items()} | dict(rules or {})
    seconds = F.element_at(F.create_map(*[F.lit(x) for r, c in cooldown.items() for x in (r, float(c))]), F.col("rule"))
    return throttle(hits.withColumn("__period", seconds), ["store_id", "rule", *extra_keys], ORDER, "__period").drop(
        "__period")


def arrival_rate(entries: DataFrame, probes: DataFrame, window=300.0, keys=("run_id",),
                 chunk_s="auto") -> DataFrame:
    """Entries per second in `(t - window, t]` at every probe row.

    Differences of one running count, so a busy door is no bigger a task than a
    quiet one. probes: keys, t, seq.
    """
    keys = list(keys)
    line = entries.select(*keys, "t", F.lit(0).alias("__o"), F.lit(1).alias("__n"),
                          F.lit(None).cast("bigint").alias("seq"))
    p = probes.select(*keys, "t", "seq")
    now = p.select(*keys, "t", F.lit(2).alias("__o"), F.lit(0).alias("__n"), "seq")
    then = p.select(*keys, (F.col("t") - window).alias("t"), F.lit(1).alias("__o"),
                    F.lit(0).alias("__n"), "seq")
    line = line.unionByName(now).unionByName(then)
    line = scan(line, keys, ["t", "__o"], {
        "__c": RunSum(F.col("__n")),
        "__f": NextValid(F.when(F.col("__n") == 1, F.col("t")))}, resolve(chunk_s, line, keys))
    is_now = F.col("__o") == 2
    got = line.where(F.col("__o") > 0).groupBy(*keys, "seq").agg(
        F.max(F.when(is_now, F.col("t"))).alias("t"),
        F.max(F.when(is_now, F.col("__c"))).alias("__c1"),
        F.max(F.when(~is_now, F.col("__c"))).alias("__c0"),
        F.max(F.when(~is_now, F.col("__f"))).alias("__f"))
    n = (F.col("__c1") - F.col("__c0")).cast("bigint")
    rate = F.when(n > 0, n / F.greatest(F.col("t") - F.col("__f"), F.lit(1.0))).otherwise(0.0)
    return got.select(*keys, "seq", "t", n.alias("arrivals"), rate.alias("lambda_per_s"))


def queue_estimates(lanes: DataFrame, service_s=45.0, alpha=0.3, period=None,
                    keys=("run_id", "lane"), chunk_s="auto") -> DataFrame:
    """Smoothed headcount and predicted wait per lane reading.

    `period` first thins the readings to one per that many seconds and lane.
    """
    keys = list(keys)
    chunk_s = resolve(chunk_s, lanes, keys)
    q = lanes.select(*keys, "t", "seq", Q.naive_count(F.slice("cells", 1, 16)).alias("__raw"))
    if period:
        q = throttle(q, keys, ORDER, period)
    q = ema(q, keys, ORDER, "__raw", alpha, "__c", chunk_s)
    return q.select(*keys, "t", "seq", F.round("__c", 2).alias("count"),
                    F.round(F.col("__c") * service_s, 1).alias("pred_wait_s"))


def staffing_alerts(entries, probes, counters=2, service_s=45.0, target_wait_s=180.0,
                    period=30.0, window=300.0, keys=("run_id",), chunk_s="auto") -> DataFrame:
    """Advice to open counters, judged at most once per `period`."""
    keys = list(keys)
    chunk_s = resolve(chunk_s, probes, keys)
    ticks = throttle(probes.select(*keys, "t", "seq"), keys, ORDER, period)
    rate = arrival_rate(entries, ticks, window, keys, chunk_s)
    advice = Q.staffing_advice(F.lit(counters), F.col("lambda_per_s"), F.lit(1.0 / service_s),
                               F.lit(float(target_wait_s)))
    a = rate.withColumn("__a", advice).where(F.col("__a").isNotNull())
    return a.select(*keys, "t", "seq", F.lit("warning").alias("severity"),
                    F.lit("open_counter").alias("rule"), F.col("__a.open").alias("open"),
                    F.col("__a.lambda_per_min").alias("lambda_per_min"),
                    F.round("__a.projected_wait_s", 0).alias("projected_wait_s"))


def _power_factor(alpha, beta, k):
    """p(k) with M^k = p(k) M - det(M) p(k - 1) I, for the smoothing step's matrix M and k >= 1."""
    import math
    trace, det = 2 - alpha - alpha * beta, 1 - alpha
    spread = trace * trace - 4 * det
    if abs(spread) < 1e-12:
        return k * F.pow(F.lit(trace / 2), k - 1)
    if spread < 0:
        angle = math.acos(trace / (2 * math.sqrt(det)))
        return F.pow(F.lit(math.sqrt(det)), k - 1) * F.sin(k * angle) / math.sin(angle)
    high, low = (trace + math.sqrt(spread)) / 2, (trace - math.sqrt(spread)) / 2
    return (F.pow(F.lit(high), k) - F.pow(F.lit(low), k)) / (high - low)


def holt(series: DataFrame, keys=("run_id",), order="bucket", value="value", alpha=0.3, beta=0.1,
         horizon=1, chunk_s="auto") -> DataFrame:
    """Level, trend and forecast of each key's series by linear double smoothing.

    The step is linear, state' = M state + value * gain, so the final state is a sum over all values, each weighted
    by a power of M that only depends on its age: ranks by a balanced scan, then one ordinary aggregate.
    """
    keys = list(keys)
    det = 1 - alpha
    move = ((1 - alpha, 1 - alpha), (-alpha * beta, 1 - alpha * beta))
    rows = series.select(*keys, F.col(order).cast("double").alias("__at"), F.col(value).cast("double").alias("__v"))
    rows = scan(rows, keys, ["__at"], {"__i": RunSum(F.lit(1)), "__n": WholeSum(F.lit(1))},
                resolve(chunk_s, rows, keys, "__at"))
    v, i, n = F.col("__v"), F.col("__i"), F.col("__n")

    def aged(level, trend, age):
        """(level, trend) after `age` further steps without input."""
        p, q = _power_factor(alpha, beta, age), _power_factor(alpha, beta, age - 1)
        return [F.when(age == 0, own).otherwise(p * (row[0] * level + row[1] * trend) - det * q * own)
                for row, own in zip(move, (level, trend))]

    # The series starts at its first value with the first difference as trend; later values enter through the gain.
    start = aged(F.when(i == 1, v).otherwise(0.0),
                 F.when(n == 1, 0.0).when(i == 1, -v).when(i == 2, v).otherwise(0.0), n - 1)
    later = aged(v * alpha, v * (alpha * beta), n - i)
    total = [F.sum(F.when(i <= 2, s).otherwise(0.0) + F.when(i >= 2, x).otherwise(0.0)) for s, x in zip(start, later)]
    return (rows.groupBy(*keys).agg(total[0].alias("level"), total[1].alias("trend"))
            .withColumn("forecast", F.col("level") + F.col("trend") * horizon))


def checkout_sales(visit: DataFrame, zone="checkout", min_dwell=5.0) -> DataFrame:
    """One sale per long enough stay at the till."""
    return visit.where((F.col("zone") == zone)
                       & (F.col("t_exit") - F.col("t_enter") >= min_dwell)).select(
        "run_id", F.col("t_exit").alias("t"), F.lit(1).cast("bigint").alias("lane"))


def reach_events(motion: DataFrame, min_ratio=0.05, peak=120, strong_ratio=0.12, min_frames=3,
                 cooldown=1.5, keys=("run_id", "roi"), chunk_s="auto") -> DataFrame:
    """Picks: a reach of `min_frames` active rows that ends, outside the cooldown.

    motion: keys, t, seq, ratio, peak and optionally pick_monitor.
    """
    keys = list(keys)
    chunk_s = resolve(chunk_s, motion, keys)
    active = ((F.col("ratio") >= min_ratio) & (F.col("peak") > peak)) | (F.col("ratio") > strong_ratio)
    m = motion.withColumn("__on", active)
    m = scan(m, keys, ORDER, {"__g": RunSum((~F.col("__on")).cast("bigint"), False)}, chunk_s)
    rest = F.when(~F.col("__on"), F.struct("t", "seq"))
    watch = F.coalesce("pick_monitor", F.lit(True)) if "pick_monitor" in motion.columns else F.lit(True)
    r = m.groupBy(*keys, "__g").agg(F.count_if("__on").alias("frames"), F.max(rest).alias("__e"),
                                    F.bool_and(watch).alias("__w"))
    r = r.where(F.col("__e").isNotNull() & (F.col("frames") >= min_frames) & F.col("__w"))
    picks = r.select(*keys, F.col("__e.t").alias("t"), F.col("__e.seq").alias("seq"), "frames")
    return throttle(picks, keys, ORDER, cooldown, strict=True)


def _count_of(array, value):
    return F.size(F.filter(array, lambda v: v == value))


def inventory(status: DataFrame, stock: DataFrame, confirm=15, agreement=0.85,
              keys=("run_id", "roi"), chunk_s="auto") -> DataFrame:
    """Committed stock drops from shelf statuses.

    stock: roi, initial_stock, low_threshold, unit_price. An empty reading means
    0 items, a low one 30 % of the initial stock, any other the initial stock. A
    value is committed when it fills `agreement` of the last `confirm` readings
    and is below the current stock; the window then counts as that value. Only
    three values occur and stock only falls, so two commit rounds are complete.
    Returns one row per commit with the removed quantity and the alert it raises.
    """
    keys = list(keys)
    chunk_s = resolve(chunk_s, status, keys, measure=False)
    init = F.col("initial_stock")
    qty = (F.when(F.col("status") == "empty", F.lit(0))
           .when(F.col("status") == "low", F.floor(init * 0.3).cast("int")).otherwise(init))
    rows = status.join(stock, store_keys(status, stock, "roi")).withColumns({
        "__q": qty, "__stock": init, "__since": F.lit(None).cast("struct<t:double,seq:bigint>")})
    keep = [*keys, *ORDER, "__q", "__stock", "__since", "initial_stock", "low_threshold", "unit_price"]
    # Both rounds read the readings, which are dear to compute.
    rows = cut(rows.select(*keep))
    out = None
    for _ in range(2):
        # Readings up to the last commit were rewritten to the committed stock.
        past = F.coalesce(F.struct("t", "seq") <= F.col("__since"), F.lit(False))
        seen = rows.withColumn("__x", F.when(past, F.col("__stock")).otherwise(F.col("__q")))
        seen = scan(seen, keys, ORDER, {"__h": Tail(F.col("__x"), confirm)}, chunk_s)
        hits = [_count_of("__h", c) for c in (F.lit(0), F.floor(init * 0.3).cast("int"))]
        full = F.size("__h") >= confirm
        need = confirm * agreement
        mode = (F.when(hits[0] >= need, F.lit(0))
                .when(hits[1] >= need, F.floor(init * 0.3).cast("int")))
        seen = seen.withColumn("__mode", F.when(full & ~past, mode)).where(
            F.col("__mode") < F.col("__stock"))
        first = seen.groupBy(*keys).agg(
            F.min_by(F.struct("t", "seq", F.col("__mode").alias("stock"),
                              (F.col("__stock") - F.col("__mode")).alias("removed"),
                              "initial_stock", "low_threshold", "unit_price"),
                     F.struct("t", "seq")).alias("c"))
        step = first.select(*keys, "c.*")
        out = step if out is None else out.unionByName(step)
        mark = first.select(*keys, F.struct("c.t", "c.seq").alias("__s2"), F.col("c.stock").alias("__k2"))
        rows = rows.join(mark, keys, "left").withColumns({
            "__since": F.coalesce("__s2", "__since"), "__stock": F.coalesce("__k2", "__stock")}
        ).select(*keep)
    threshold = F.greatest(F.lit(1), F.coalesce(
        F.col("low_threshold"), F.floor(F.col("initial_stock") * 0.3).cast("int")))
    rule = (F.when(F.col("stock") == 0, "stockout_detected")
            .when(F.col("stock") <= threshold, "low_stock_detected"))
    return out.select(*keys, "t", "seq", "removed", F.col("stock").alias("remaining"),
                      (F.col("removed") * F.col("unit_price")).alias("revenue"), rule.alias("rule"))


def inventory_with_removals(status: DataFrame, removals: DataFrame, stock: DataFrame, confirm=15, agreement=0.85,
                            keys=("run_id", "roi")) -> DataFrame:
    """`inventory` where items are also taken out directly, by hand or as detected picks.

    removals: keys, t, seq, quantity. A removal lowers the stock at once, by no more than there is, and makes every
    earlier reading neutral, so the two sources do not count one item twice. As each step depends on the stock that the
    last one left, a facing is folded in order, by the same step as the stream (`folds.inventory_step`); its state is
    one number and one mark per reading of the window, and rows pass in Arrow batches.
    """
    from aislemetry.streaming.folds import inventory_step
    keys = list(keys)
    store = [c for c in ("store_id",) if c in stock.columns and c not in keys]
    lines = status.select(*keys, *store, "t", "seq", "status").unionByName(
        removals.select(*keys, *store, "t", "seq", F.col("quantity").cast("int").alias("removal")), allowMissingColumns=True)
    floor = F.greatest(F.lit(1), F.coalesce(F.col("low_threshold"), F.floor(F.col("initial_stock") * 0.3).cast("int")))
    rows = lines.join(stock, store_keys(lines, stock, "roi")).select(
        *keys, "t", "seq", "status", "removal", F.col("initial_stock").cast("int").alias("initial_stock"),
        floor.alias("threshold"), F.col("unit_price").cast("double").alias("unit_price"))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "t", "seq")
    fields = [rows.schema[c] for c in (*keys, "t", "seq")]
    schema = T.StructType(fields + [T.StructField(c, T.IntegerType()) for c in ("removed", "remaining")] + [
        T.StructField("revenue", T.DoubleType()), T.StructField("rule", T.StringType())])
    cells = ("t", "seq", "status", "removal", "initial_stock", "threshold", "unit_price")

    def run(batches):
        step, state, last = inventory_step(confirm, agreement), (None, None), None
        for batch in batches:
            new = key_changes(batch, keys)
            columns = {c: batch.column(c).to_pylist() for c in cells}
            at, found = [], []
            for n in range(batch.num_rows):
                if n == 0 or new[n]:
                    key = tuple(batch.column(k)[n].as_py() for k in keys)
                    state, last = state if key == last else (None, None), key
                row = {c: v[n] for c, v in columns.items()}
                state, out = step(state, row)
                for o in out:
                    at.append(n)
                    found.append((o["removed"], o["remaining"], o["removed"] * row["unit_price"], o["rule"]))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(pa.array(at)) for c in (*keys, "t", "seq")]
                    + [pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int32(), pa.float64(), pa.string()))],
                    names=schema.names)

    return rows.mapInArrow(run, schema)


def inventory_incidents(commits: DataFrame, keys=("run_id", "roi")) -> DataFrame:
    """Stock-out starts of facings that inventory has counted down to nothing."""
    return commits.where(F.col("remaining") == 0).select(*keys, "t", "seq", F.lit("start").alias("kind"))
