"""Streaming queries, run to the end of the available data."""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from aislemetry.plans.catalog_sequence import CROSS_SQL, HOURS6, wires
from aislemetry.plans.catalog_tables import CHECK
from aislemetry.plans.registry import query
from aislemetry.plans.views import EMPTY_BELOW, LOW_BELOW, VISIT_DEBOUNCE, VISIT_MIN, Views
from aislemetry.session import STATE_STORE, shared_dir
from aislemetry.streaming import flows, folds

STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
DAY = 86400.0
PARTS = 5


class StreamViews(Views):
    """The same views over `events` read as a stream."""

    def table(self, name):
        # Keyed state needs a store with column families; set it where the
        # session was built without one.
        if self.spark.conf.get(STORE_CONF) != STATE_STORE:
            self.spark.conf.set(STORE_CONF, STATE_STORE)
        path = f"{self.dir}/{name}.parquet"
        schema = self.spark.read.parquet(path).schema
        # As a glob the path may be one file or a folder of files.
        return self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(
            f"{self.dir}/{name}.parque[t]")


class ShuffledViews(StreamViews):
    """`events` in five micro-batches of six days each, with every third row a day and every third two days late."""

    @cached_property
    def _events(self):
        super().table("events")                     # sets the state store
        rows = Views.table(self, "events")
        shown = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 + F.pmod("event_id", F.lit(3)) * DAY
        first = F.lit(1704067200.0)                 # 2024-01-01
        part = F.least(F.lit(PARTS - 1), F.greatest(F.lit(0), F.floor((shown - first) / (6 * DAY))))
        return flows.replayed(rows, part, PARTS)

    def table(self, name):
        return self._events if name == "events" else super().table(name)


def live(v):
    return StreamViews(v.spark, v.dir)


def shuffled(v):
    return ShuffledViews(v.spark, v.dir)


def closed(stream, name):
    """Run a fold to the end and close what it still holds."""
    return flows.run_available(stream, name=name, closing=lambda spark, state: folds.held(
        spark, state, stream.fold, stream.schema))


@query("stream_visits", "SELECT * FROM v_visit")
def _(v):
    return closed(folds.stream_visits(live(v).observation, VISIT_DEBOUNCE, VISIT_MIN, idle_s=None), "visits")


@query("stream_visits_shuffled", "SELECT * FROM v_visit")
def _(v):
    obs = folds.with_event_time(shuffled(v).observation, "3 days")
    return closed(folds.stream_visits(obs, VISIT_DEBOUNCE, VISIT_MIN, idle_s=None, reorder=True), "visits")


@query("stream_throttle", """WITH RECURSIVE src AS (SELECT run_id AS k, * FROM v_occupancy),
    kept(k, t) AS (SELECT k, min(t) FROM src GROUP BY k UNION ALL SELECT kept.k, (SELECT min(s.t) FROM src s
      WHERE s.k = kept.k AND s.t - kept.t >= 21600) FROM kept WHERE kept.t IS NOT NULL)
    SELECT s.run_id, s.t, s.seq, s.count FROM src s JOIN kept ON kept.k = s.k AND kept.t = s.t""")
def _(v):
    s = folds.stream_throttle(live(v).occupancy, 21600.0, ["run_id"], "run_id string", ["count"], "count bigint")
    return flows.run_available(s, name="throttle")


EMA_SQL = """SELECT run_id, lane, t, seq, round(list_reduce(list(pred_wait_s) OVER (
    PARTITION BY run_id, lane ORDER BY t ROWS UNBOUNDED PRECEDING), lambda a, x: 0.3 * x + 0.7 * a), 6) AS smooth
    FROM v_queue_estimate"""


@query("stream_ema", EMA_SQL)
def _(v):
    s = folds.stream_ema(live(v).queue_estimate, "pred_wait_s", 0.3, ["run_id", "lane"], "run_id string, lane bigint")
    return flows.run_available(s.withColumn("smooth", F.round("smooth", 6)), name="ema")


@query("stream_ema_shuffled", EMA_SQL)
def _(v):
    q = folds.with_event_time(shuffled(v).queue_estimate, "3 days")
    s = folds.stream_ema(q, "pred_wait_s", 0.3, ["run_id", "lane"], "run_id string, lane bigint", reorder=True)
    return closed(s, "ema").withColumn("smooth", F.round("smooth", 6))


@query("stream_crossings", CROSS_SQL)
def _(v):
    return flows.run_available(folds.stream_crossings(live(v).point, wires(v), 12.0, HOURS6), name="crossings")


@query("stream_crossings_shuffled", CROSS_SQL)
def _(v):
    points = folds.with_event_time(shuffled(v).point, "3 days")
    return closed(folds.stream_crossings(points, wires(v), 12.0, HOURS6, reorder=True), "crossings")


@query("stream_one_incident", """SELECT run_id, roi, t, seq, kind FROM (SELECT *, lag(kind) OVER (
    PARTITION BY run_id, roi ORDER BY t, seq) AS p FROM v_stockout_event) WHERE kind <> coalesce(p, 'end')""")
def _(v):
    s = folds.stream_one_incident(live(v).stockout_event, ["run_id", "roi"], "run_id string, roi string")
    return flows.run_available(s, name="incident")


INSTANT = {"v_instant": f"""SELECT run_id, roi, t, seq, CASE WHEN fill <= {EMPTY_BELOW} THEN 'empty'
    WHEN fill <= {LOW_BELOW} THEN 'low' ELSE 'normal' END AS status FROM v_shelf_fill"""}


@query("stream_shelf_incidents", """SELECT run_id, roi, t, seq, status, unnest(list_filter([
        CASE WHEN status = 'empty' AND p IS DISTINCT FROM 'empty' THEN 'start' END,
        CASE WHEN status = 'empty' AND p IS DISTINCT FROM 'empty' THEN 'alert_out' END,
        CASE WHEN status <> 'empty' AND p = 'empty' THEN 'end' END,
        CASE WHEN status = 'low' AND latch IS DISTINCT FROM 'low' THEN 'alert_low' END],
        lambda k: k IS NOT NULL)) AS kind FROM (
      SELECT *, lag(status) OVER w AS p, last_value(CASE WHEN status IN ('low', 'normal') THEN status END IGNORE NULLS)
        OVER (PARTITION BY run_id, roi ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latch
      FROM v_instant WINDOW w AS (PARTITION BY run_id, roi ORDER BY t, seq))""", INSTANT)
def _(v):
    fill = F.col("fill")
    s = live(v).shelf_fill.select("run_id", "roi", "t", "seq", F.when(fill <= EMPTY_BELOW, "empty").when(
        fill <= LOW_BELOW, "low").otherwise("normal").alias("status"))
    return flows.run_available(folds.stream_shelf_incidents(s), name="shelf")


@query("stream_windowed_kpis", """SELECT run_id, CAST(floor(t / 900) * 900 AS BIGINT) AS t_bucket, event_type,
    count(*) AS n, round(sum(value), 4) AS total FROM v_ev GROUP BY ALL""")
def _(v):
    e = live(v).ev.select("run_id", "t", "event_type", F.col("value").alias("amount"))
    k = flows.run_upserts(flows.windowed_kpis(e), ["run_id", "t_bucket", "event_type"], "kpi")
    return k.withColumn("total", F.round("total", 4))


# Batches of six days; a delay of a week keeps every row that comes two days late.
@query("stream_windows_shuffled", """SELECT run_id, CAST(floor(t / 900) * 900 AS BIGINT) AS t_bucket, event_type,
    count(*) AS n, round(sum(value), 4) AS total FROM v_ev GROUP BY ALL""")
def _(v):
    e = shuffled(v).ev.select("run_id", "t", "event_type", F.col("value").alias("amount"))
    k = flows.run_upserts(flows.windowed_kpis(e, "7 days"), ["run_id", "t_bucket", "event_type"], "kpi")
    return k.withColumn("total", F.round("total", 4))


@query("stream_sliding_arrivals", """SELECT run_id, CAST(floor(t / 60) * 60 + 60 * k AS BIGINT) AS t, count(*) AS arrivals,
    count(*) / 300.0::DOUBLE AS lambda_per_s FROM v_tripwire, range(1, 6) r(k) WHERE dir = 'in' GROUP BY ALL""")
def _(v):
    entries = live(v).tripwire.where("dir = 'in'").select("run_id", "t")
    return flows.run_upserts(flows.sliding_arrivals(entries), ["run_id", "t"], "arrivals")


# Each part is late by the watermark that the parts before it have set.
@query("stream_late_rows", f"""WITH p AS (SELECT run_id, t, least({PARTS - 1}, greatest(0, CAST(floor(
        (t + event_id % 3 * 86400 - 1704067200) / (6 * 86400)) AS BIGINT))) AS part FROM v_ev),
    w AS (SELECT part, max(max(t)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
      FROM p GROUP BY part)
    SELECT run_id, CASE WHEN t < top - 43200 THEN 'late' ELSE 'on_time' END AS side, count(*) AS n, min(t) AS first,
      max(t) AS last FROM p JOIN w USING (part) GROUP BY ALL""")
def _(v):
    base, state = shared_dir(v.spark, "late"), shared_dir(v.spark, "late-state")
    flows.split_late(shuffled(v).ev.select("run_id", "t"), base, state, DAY / 2, {"availableNow": True}).awaitTermination()
    sides = [v.spark.read.parquet(f"{base}/{side}").select("run_id", "t", F.lit(side).alias("side"))
             for side in ("on_time", "late")]
    return sides[0].unionByName(sides[1]).groupBy("run_id", "side").agg(
        F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


@query("stream_heartbeat", """WITH r AS (SELECT run_id, CAST(floor(t / 3600) AS BIGINT) AS tick, t, seq, count FROM v_occupancy),
    l AS (SELECT run_id, tick, arg_max(count, (t, seq)) AS count FROM r GROUP BY ALL),
    s AS (SELECT run_id, unnest(range(min(tick), max(tick) + 1)) AS tick FROM l GROUP BY run_id)
    SELECT run_id, tick, coalesce(count, 0) AS count FROM s LEFT JOIN l USING (run_id, tick)
    WHERE tick <= (SELECT max(tick) FROM l)""")
def _(v):
    readings = folds.with_event_time(shuffled(v).occupancy, "3 days").select("run_id", "t", "seq", "count", "ts")
    s = folds.stream_heartbeat(readings, 3600.0)
    return flows.run_available(s, name="beat", closing=lambda spark, state: folds.held_ticks(spark, state, s.fold))


@query("stream_deduplicated", "SELECT DISTINCT store_id, event_type, t, user FROM (SELECT store_id, event_type, t, track_id AS user FROM v_ev)")
def _(v):
    twice = live(v).ev.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        "store_id", "event_type", "t", F.col("track_id").alias("user"))
    once = flows.deduplicated(twice, keys=("store_id", "event_type", "t", "user"))
    return flows.run_available(once.drop("ts"), name="once")


@query("stream_sink_occupancy", """SELECT run_id, t, CAST(floor(value) AS BIGINT) % 60 AS count FROM v_check
    WHERE reason IS NULL AND event_type = 'occupancy'""", CHECK)
def _(v):
    base, state = shared_dir(v.spark, "sunk"), shared_dir(v.spark, "sink-state")
    e = live(v).envelope.withColumn("run_id", F.concat(F.lit("run"), F.expr("substring(store_id, 6)")))
    q = flows.sink_events(e, base, state, min_time=None, trigger={"availableNow": True})
    q.awaitTermination()
    return flows.read_sunk(v.spark, base, "occupancy").select("run_id", "t", "count")
