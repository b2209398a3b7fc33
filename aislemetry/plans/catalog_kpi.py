"""KPI queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from aislemetry.plans import kpis as K
from aislemetry.plans.registry import query
from aislemetry.plans.views import HOMOGRAPHY, ZONES

NOW = 791_200_000.0            # a fixed clock for incidents that are still open
BOUNDS = K.floor_bounds(ZONES)


@query("live_summary", """
    SELECT r.run_id, coalesce(arg_max(o.count, o.t), 0) AS occupancy, max(o.t) AS occupancy_t
    FROM v_run r LEFT JOIN v_occupancy o ON r.run_id = o.run_id GROUP BY r.run_id""")
def _(v):
    return K.live_summary(v.run, v.occupancy)


HOUR_SQL = """SELECT run_id, CAST(floor((t + 19800) / 86400) * 86400 - 19800 AS DOUBLE) AS day_start,
    CAST(floor((t + 19800 - floor((t + 19800) / 86400) * 86400) / 3600) AS BIGINT) AS hour,
    count(*) AS entries FROM v_tripwire WHERE dir = 'in' GROUP BY ALL"""
FULL_HOUR_SQL = """SELECT d.run_id, d.day_start, h.hour, coalesce(x.entries, 0) AS entries
    FROM (SELECT DISTINCT run_id, day_start FROM v_hour) d
    CROSS JOIN (SELECT range AS hour FROM range(24)) h
    LEFT JOIN v_hour x ON x.run_id = d.run_id AND x.day_start = d.day_start AND x.hour = h.hour"""


@query("footfall_by_hour", HOUR_SQL)
def _(v):
    return K.footfall_by_hour(v.tripwire, tz="Asia/Kolkata")


@query("footfall_hours_of_day", FULL_HOUR_SQL, {"v_hour": HOUR_SQL})
def _(v):
    return K.footfall_by_hour(v.tripwire, tz="Asia/Kolkata", zero_fill=True)


@query("footfall_peak_hour", """SELECT run_id, day_start,
    arg_max(hour, entries * 100 - hour) AS peak_hour, max(entries) AS peak_entries,
    round(sum(entries) / 24, 1) AS avg_per_hour FROM v_full GROUP BY ALL""",
       {"v_hour": HOUR_SQL, "v_full": FULL_HOUR_SQL})
def _(v):
    return K.footfall_peak(v.tripwire, tz="Asia/Kolkata")


@query("footfall_by_day", """SELECT run_id, day, entries FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY day DESC) AS r FROM (
      SELECT run_id, CAST(floor(t / 86400) AS BIGINT) AS day, count(*) AS entries
      FROM v_tripwire WHERE dir = 'in' GROUP BY ALL)) WHERE r <= 7""")
def _(v):
    return K.footfall_by_day(v.tripwire, 7)


@query("footfall_totals", """SELECT run_id, entries, exits, entries - exits AS net FROM (
    SELECT run_id, count(*) FILTER (dir = 'in') AS entries, count(*) FILTER (dir = 'out') AS exits
    FROM v_tripwire GROUP BY run_id)""")
def _(v):
    return K.footfall_totals(v.run, v.tripwire)


def window_of(v):
    return K.run_window(v.run, v.occupancy, v.tripwire, v.shelf_fill, v.visit)


@query("run_window", "SELECT run_id, t0, t1 FROM v_window")
def _(v):
    return window_of(v)


@query("footfall_spark", """SELECT w.run_id, b.range AS bucket, coalesce(n.entries, 0) AS entries
    FROM v_window w CROSS JOIN range(12) b LEFT JOIN (
      SELECT x.run_id, least(11, CAST(floor((x.t - w.t0) / greatest((w.t1 + 1 - w.t0) / 12, 1e-6)) AS BIGINT)) AS bucket,
        count(*) AS entries FROM v_tripwire x JOIN v_window w ON x.run_id = w.run_id
      WHERE dir = 'in' GROUP BY ALL) n ON n.run_id = w.run_id AND n.bucket = b.range""")
def _(v):
    return K.footfall_spark(v.tripwire, window_of(v))


@query("dwell_by_zone", """SELECT run_id, zone, len(d) AS visits, d[len(d) // 2 + 1] AS median_dwell_s,
    d[CAST(ceil(len(d) * 9 / 10) AS BIGINT)] AS p90_dwell_s
    FROM (SELECT run_id, zone, list_sort(list(dwell_s)) AS d FROM v_visit GROUP BY ALL)""")
def _(v):
    return K.dwell_by_zone(v.visit)


@query("shopper_totals", """SELECT run_id, count(*) AS shoppers, round(avg(longest), 1) AS avg_dwell_s,
    count(*) FILTER (longest >= 5) AS browsed, count(*) FILTER (total >= 30) AS engaged
    FROM (SELECT run_id, track_id, max(dwell_s) AS longest, sum(dwell_s) AS total FROM v_visit
      GROUP BY ALL) GROUP BY run_id""")
def _(v):
    return K.shopper_totals(v.visit)


def cells(v):
    return K.heatmap_points(v.point, HOMOGRAPHY)


@query("heatmap_accumulate", "SELECT run_id, t_bucket, gx, gy, count FROM v_heatmap")
def _(v):
    return K.heatmap_accumulate(cells(v))


# One publish per six hours keeps the driver's sparse clock meaningful.
@query("heatmap_published", """WITH RECURSIVE fr AS (
      SELECT run_id, t, row_number() OVER (PARTITION BY run_id ORDER BY t) AS rn
      FROM (SELECT DISTINCT run_id, t FROM v_point)),
    tick(run_id, t, first) AS (SELECT run_id, t, true FROM fr WHERE rn = 1 UNION ALL
      SELECT k.run_id, (SELECT min(f.t) FROM fr f WHERE f.run_id = k.run_id AND f.t - k.t >= 21600), false
      FROM tick k WHERE k.t IS NOT NULL),
    ticks AS (SELECT run_id, t FROM tick WHERE NOT first AND t IS NOT NULL),
    c AS (SELECT run_id, t, CAST(floor(fx / 0.25) AS BIGINT) AS gx, CAST(floor(fy / 0.25) AS BIGINT) AS gy
      FROM v_point)
    SELECT k.run_id, k.t_bucket, c.gx, c.gy, count(*) AS count FROM (
      SELECT run_id, CAST(floor(t / 60) AS BIGINT) AS t_bucket, max(t) AS t FROM ticks GROUP BY ALL) k
    JOIN c ON c.run_id = k.run_id AND c.t <= k.t GROUP BY ALL""")
def _(v):
    return K.heatmap_accumulate(cells(v), publish_s=21600.0)


@query("heatmap", "SELECT run_id, gx, gy, max(count) AS count FROM v_heatmap GROUP BY ALL")
def _(v):
    return K.heatmap(K.heatmap_accumulate(cells(v)))


@query("heatmap_live", """SELECT run_id, gx, gy, round(s, 3) AS value FROM (
    SELECT p.run_id, CAST(floor(fx / 0.25) AS BIGINT) AS gx, CAST(floor(fy / 0.25) AS BIGINT) AS gy,
      sum(pow(0.99999, m.now - coalesce(f.pt, p.t))) AS s FROM v_point p
    JOIN (SELECT run_id, max(t) AS now FROM v_point GROUP BY ALL) m ON m.run_id = p.run_id
    JOIN (SELECT run_id, t, lag(t) OVER (PARTITION BY run_id ORDER BY t) AS pt FROM
      (SELECT DISTINCT run_id, t FROM v_point)) f ON f.run_id = p.run_id AND f.t = p.t
    GROUP BY ALL) WHERE s > 0.01""")
def _(v):
    return K.heatmap_live(cells(v), decay=0.99999)


GRID_SQL = """SELECT r.run_id, y.range AS row, x.range AS col,
    round(sqrt(coalesce(n, 0) / max(coalesce(n, 0)) OVER (PARTITION BY r.run_id)), 3) AS heat
    FROM v_run r CROSS JOIN range(12) y CROSS JOIN range(16) x LEFT JOIN (
      SELECT run_id, least(11, greatest(0, CAST(round_even(11 - (gy - {y0}) / greatest({y1} - {y0}, 1e-9) * 11, 0) AS BIGINT))) AS r,
        least(15, greatest(0, CAST(round_even((gx - {x0}) / greatest({x1} - {x0}, 1e-9) * 15, 0) AS BIGINT))) AS c,
        sum(count) AS n FROM (SELECT run_id, gx, gy, max(count) AS count FROM v_heatmap GROUP BY ALL){j}
      GROUP BY ALL) g ON g.run_id = r.run_id AND g.r = y.range AND g.c = x.range"""


@query("heatmap_grid", GRID_SQL.format(x0="0.0", x1="32.0", y0="0.0", y1="18.0", j=""))
def _(v):
    return K.heatmap_grid(K.heatmap(K.heatmap_accumulate(cells(v))), BOUNDS)


@query("heatmap_grid_auto", GRID_SQL.format(x0="b.x0", x1="b.x1", y0="b.y0", y1="b.y1", j="""
    JOIN (SELECT run_id, CAST(min(gx) AS DOUBLE) AS x0, CAST(max(gx) AS DOUBLE) AS x1,
      CAST(min(gy) AS DOUBLE) AS y0, CAST(max(gy) AS DOUBLE) AS y1 FROM v_heatmap GROUP BY ALL) b
    USING (run_id)"""))
def _(v):
    return K.heatmap_grid(K.heatmap(K.heatmap_accumulate(cells(v))))


@query("stockout_durations", """SELECT run_id, roi, sku, t_start, t_end, t_end - t_start AS duration_s
    FROM v_stockout WHERE t_end IS NOT NULL""")
def _(v):
    return K.stockout_durations(v.stockout)


@query("recent_stockouts", f"""SELECT run_id, roi AS facing, s.sku, round(e - t_start, 1) AS duration_s,
    round(greatest(0, e - t_start) / 3600 * coalesce(p.rate, 0), 2) AS lost,
    CASE WHEN t_end IS NULL THEN 'active' ELSE 'resolved' END AS status FROM (
      SELECT *, coalesce(t_end, {NOW}) AS e, row_number() OVER (PARTITION BY run_id
        ORDER BY t_start DESC, roi, sku, t_end NULLS FIRST) AS r FROM v_stockout) s
    LEFT JOIN v_planogram p ON p.sku = s.sku WHERE r <= 20""")
def _(v):
    return K.recent_stockouts(v.stockout, v.planogram, NOW)


@query("shelf_latest", """SELECT f.run_id, f.roi, f.t, f.fill, EXISTS (SELECT 1 FROM v_so_closed o
      WHERE o.run_id = f.run_id AND o.roi = f.roi AND o.t_end IS NULL) AS stockout
    FROM (SELECT run_id, roi, max(t) AS t, arg_max(fill, t) AS fill FROM v_shelf_fill GROUP BY ALL) f""",
       {"v_so_closed": "SELECT run_id, roi, NULL AS t_end FROM v_stockout_event WHERE kind = 'start'"})
def _(v):
    incidents = v.stockout_event.where(F.col("kind") == "start").withColumn(
        "t_end", F.lit(None).cast("double"))
    return K.shelf_latest(v.shelf_fill, incidents)


@query("shelf_board", """SELECT run_id, roi, CAST(floor(fill) AS BIGINT) AS fill,
    CASE WHEN fill < 60 THEN 'empty' WHEN fill < 110 THEN 'low' WHEN fill < 180 THEN 'partial'
      ELSE 'full' END AS state
    FROM (SELECT run_id, roi, arg_max(fill, t) AS fill FROM v_shelf_fill GROUP BY ALL)""")
def _(v):
    return K.shelf_board(v.shelf_fill, v.stockout)


@query("open_stockout_flag", """SELECT DISTINCT s.run_id, s.roi, EXISTS (SELECT 1 FROM v_stockout o
      WHERE o.run_id = s.run_id AND o.roi = s.roi AND o.t_end IS NULL) AS stockout FROM v_stockout s""")
def _(v):
    return K.open_stockout_flag(v.stockout.select("run_id", "roi").distinct(), v.stockout)


@query("planogram_lookup", """SELECT s.run_id, s.roi, s.sku, s.t_start, s.t_end,
    coalesce(p.rate, 0) AS rate FROM v_stockout s LEFT JOIN v_planogram p ON p.sku = s.sku""")
def _(v):
    return K.planogram_lookup(v.stockout, v.planogram)


LOST = f"""SELECT {{k}}, round(fsum(greatest(0, coalesce(t_end, {NOW}) - t_start) / 3600
    * coalesce(p.rate, 0)), 2) AS lost_revenue FROM v_stockout s
    LEFT JOIN v_planogram p ON p.sku = s.sku GROUP BY ALL"""


@query("lost_revenue", LOST.format(k="run_id"))
def _(v):
    return K.lost_revenue(v.stockout, v.planogram, NOW)


@query("lost_revenue_by_facing", LOST.format(k="run_id, roi"))
def _(v):
    return K.lost_revenue_by_facing(v.stockout, v.planogram, NOW)


@query("replenishment_list", """SELECT run_id, roi, s.sku, t_start, coalesce(p.rate, 0) AS revenue_rate
    FROM v_stockout s LEFT JOIN v_planogram p ON p.sku = s.sku WHERE t_end IS NULL""")
def _(v):
    return K.replenishment_list(v.stockout, v.planogram)


@query("replenishment_top", """SELECT * FROM (SELECT run_id, roi, s.sku, t_start,
    coalesce(p.rate, 0) AS revenue_rate, CAST(row_number() OVER (PARTITION BY run_id
      ORDER BY coalesce(p.rate, 0) DESC, t_start, roi, s.sku) AS INTEGER) AS rank
    FROM v_stockout s LEFT JOIN v_planogram p ON p.sku = s.sku WHERE t_end IS NULL) WHERE rank <= 5""")
def _(v):
    return K.replenishment_list(v.stockout, v.planogram, 5)


@query("queue_status", """SELECT q.run_id, q.lane, q.t, q.count, q.pred_wait_s FROM v_queue_estimate q
    WHERE q.t = (SELECT max(t) FROM v_queue_estimate x WHERE x.run_id = q.run_id AND x.lane = q.lane)""")
def _(v):
    return K.queue_status(v.queue_estimate)


NEAR_SQL = """SELECT clip, t, lane, pred_wait_s, actual_wait_s, pred_wait_s - actual_wait_s AS error_s FROM (
    SELECT q.clip, q.t, q.lane, q.actual_wait_s, CASE WHEN b.t IS NOT NULL AND (a.t IS NULL OR q.t - b.t <= a.t - q.t)
      THEN b.pred_wait_s ELSE a.pred_wait_s END AS pred_wait_s
    FROM v_queue_truth q ASOF LEFT JOIN v_queue_estimate b ON {bl} q.t >= b.t
    ASOF LEFT JOIN v_queue_estimate a ON {al} q.t < a.t) WHERE pred_wait_s IS NOT NULL"""
ANY_LANE = NEAR_SQL.format(bl="q.clip = b.run_id AND", al="q.clip = a.run_id AND")
BY_LANE = NEAR_SQL.format(bl="q.clip = b.run_id AND q.lane = b.lane AND", al="q.clip = a.run_id AND q.lane = a.lane AND")


@query("wait_pred_vs_actual", ANY_LANE)
def _(v):
    return K.wait_pred_vs_actual(v.queue_truth, v.queue_estimate)


@query("wait_pred_vs_actual_by_lane", BY_LANE)
def _(v):
    return K.wait_pred_vs_actual(v.queue_truth, v.queue_estimate, by_lane=True)


@query("wait_mae", "SELECT round(avg(abs(error_s)), 6) AS mae_s, count(*) AS n FROM v_near",
       {"v_near": ANY_LANE})
def _(v):
    return K.wait_mae(K.wait_pred_vs_actual(v.queue_truth, v.queue_estimate))


@query("revenue", """SELECT run_id, count(*) AS transactions, round(sum(amount), 2) AS revenue
    FROM v_pos_txn GROUP BY ALL""")
def _(v):
    return K.revenue(v.pos_txn)


BY_TXN = """SELECT v.*, EXISTS (SELECT 1 FROM v_pos_txn x WHERE x.run_id = v.run_id
    AND x.zone_hint = v.zone AND x.t BETWEEN v.t_enter AND v.t_exit + 900) AS converted
    FROM v_visit v WHERE dwell_s >= 5"""
SHELF_ZONES = (("A1", "entrance"), ("A2", "aisle_a"), ("A3", "aisle_b"), ("A4", "checkout"),
               ("A5", "aisle_a"), ("A6", "aisle_b"))
ZONE_CASE = "CASE roi " + " ".join(f"WHEN '{r}' THEN '{z}'" for r, z in SHELF_ZONES) + " END"
BY_SHELF = f"""SELECT v.*, EXISTS (SELECT 1 FROM (SELECT run_id, t, fill, {ZONE_CASE} AS zone
      FROM v_shelf_fill) f WHERE f.run_id = v.run_id AND f.zone = v.zone AND f.fill <= 2
      AND f.t BETWEEN v.t_enter - 60 AND v.t_exit + 60) AS converted FROM v_visit v WHERE dwell_s >= 5"""
BY_DROP = f"""SELECT v.*, EXISTS (SELECT 1 FROM (SELECT run_id, t, fill, {ZONE_CASE} AS zone,
        lag(fill) OVER (PARTITION BY run_id, roi ORDER BY t, seq) AS p FROM v_shelf_fill) f
      WHERE f.run_id = v.run_id AND f.zone = v.zone AND f.p - f.fill >= 200
      AND f.t BETWEEN v.t_enter - 60 AND v.t_exit + 60) AS converted FROM v_visit v WHERE dwell_s >= 5"""


def shelf_zones(v):
    return v.spark.createDataFrame(SHELF_ZONES, "source string, zone string")


@query("convert_by_txn", BY_TXN)
def _(v):
    return K.convert_by_txn(v.visit, v.pos_txn)


@query("convert_by_shelf", BY_SHELF)
def _(v):
    return K.convert_by_shelf(v.visit, v.shelf_fill, shelf_zones(v), max_fill=2.0)


@query("convert_by_shelf_drop", BY_DROP)
def _(v):
    return K.convert_by_shelf(v.visit, v.shelf_fill, shelf_zones(v), drop=200.0)


@query("classify_visits", """SELECT *, CASE WHEN converted THEN 'engaged' WHEN dwell_s >= 120
    THEN 'confused' ELSE 'ignored' END AS label FROM v_by_txn""", {"v_by_txn": BY_TXN})
def _(v):
    return K.classify_visits(v.visit, v.pos_txn)


@query("conversion_by_zone", """SELECT run_id, zone, count(*) AS visits,
    count(*) FILTER (converted) AS conversions, round(avg(CAST(converted AS INTEGER)), 6) AS rate
    FROM v_by_txn GROUP BY ALL""", {"v_by_txn": BY_TXN})
def _(v):
    return K.conversion_by_zone(K.classify_visits(v.visit, v.pos_txn))


@query("conversion_overall", """SELECT run_id, round(avg(CAST(converted AS INTEGER)), 6) AS rate
    FROM v_by_txn GROUP BY ALL""", {"v_by_txn": BY_TXN})
def _(v):
    return K.conversion_overall(K.classify_visits(v.visit, v.pos_txn))


@query("funnel", """WITH j AS (SELECT r.run_id, (SELECT count(*) FROM v_tripwire x
        WHERE x.run_id = r.run_id AND dir = 'in') AS entries,
      (SELECT count(DISTINCT track_id) FROM v_visit x WHERE x.run_id = r.run_id) AS shoppers,
      (SELECT arg_max(count, t) FROM v_occupancy x WHERE x.run_id = r.run_id) AS occ,
      (SELECT count(*) FROM (SELECT track_id FROM v_visit x WHERE x.run_id = r.run_id
        GROUP BY track_id HAVING max(dwell_s) >= 5)) AS browsed,
      (SELECT count(*) FROM (SELECT track_id FROM v_visit x WHERE x.run_id = r.run_id
        GROUP BY track_id HAVING sum(dwell_s) >= 30)) AS engaged,
      (SELECT count(*) FROM v_pos_txn x WHERE x.run_id = r.run_id) AS sold FROM v_run r),
    k AS (SELECT *, greatest(entries, shoppers, occ) AS foot FROM j),
    u AS (SELECT run_id, foot, CAST(0 AS BIGINT) AS step, 'Footfall' AS label, foot AS value FROM k
      UNION ALL SELECT run_id, foot, 1, 'Browsed', browsed FROM k
      UNION ALL SELECT run_id, foot, 2, 'Engaged', engaged FROM k
      UNION ALL SELECT run_id, foot, 3, 'Picked up', sold FROM k)
    SELECT run_id, step, label, value, CASE WHEN step = 0 THEN 100.0::DOUBLE
      ELSE round(least(100.0, value * 100.0::DOUBLE / foot), 1) END AS pct FROM u""")
def _(v):
    return K.funnel(v.run, v.tripwire, v.visit, v.occupancy, v.pos_txn)


@query("alerts_open", "SELECT * FROM v_alert WHERE acked = 0")
def _(v):
    return K.alerts(v.alert)


@query("alerts_recent", """SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY run_id
    ORDER BY t DESC, seq DESC) AS r FROM v_alert) WHERE r <= 12""")
def _(v):
    return K.alerts(v.alert, open_only=False, n=12)


@query("stores", "SELECT DISTINCT store_id FROM v_run")
def _(v):
    return K.stores(v.run)


@query("store_rollup", """WITH p AS (SELECT r.store_id, r.run_id,
      (SELECT count(*) FROM v_tripwire x WHERE x.run_id = r.run_id AND dir = 'in') AS entries,
      (SELECT count(*) FROM v_tripwire x WHERE x.run_id = r.run_id AND dir = 'out') AS exits,
      (SELECT count(*) FROM v_visit x WHERE x.run_id = r.run_id) AS visits,
      (SELECT count(*) FROM v_pos_txn x WHERE x.run_id = r.run_id) AS sales,
      (SELECT sum(amount) FROM v_pos_txn x WHERE x.run_id = r.run_id) AS amount,
      (SELECT count(*) FROM v_stockout x WHERE x.run_id = r.run_id) AS stockouts FROM v_run r)
    SELECT store_id, run_id, CAST(sum(entries) AS BIGINT) AS entries, CAST(sum(exits) AS BIGINT) AS exits,
      CAST(sum(visits) AS BIGINT) AS visits, CAST(sum(sales) AS BIGINT) AS sales,
      CAST(sum(stockouts) AS BIGINT) AS stockouts, round(sum(amount), 2) AS amount
    FROM p GROUP BY ROLLUP (store_id, run_id)""")
def _(v):
    return K.store_rollup(v.run, v.tripwire, v.visit, v.pos_txn, v.stockout)


KPI_SQL = """SELECT run_id, CAST(floor(t / 900) AS BIGINT) * 900 AS t_bucket, key,
    round(CAST(CASE agg WHEN 'n' THEN count(*) WHEN 'avg' THEN avg(val) WHEN 'sum' THEN sum(val)
      ELSE max(val) END AS DOUBLE), 6) AS value FROM (
    SELECT run_id, t, CASE dir WHEN 'in' THEN 'entries' ELSE 'exits' END AS key, 'n' AS agg, 0.0::DOUBLE AS val FROM v_tripwire
    UNION ALL SELECT run_id, t, 'occupancy_avg', 'avg', count FROM v_occupancy
    UNION ALL SELECT run_id, t, 'sales', 'n', 0 FROM v_pos_txn
    UNION ALL SELECT run_id, t, 'revenue', 'sum', amount FROM v_pos_txn
    UNION ALL SELECT run_id, t, 'wait_max_s', 'max', pred_wait_s FROM v_queue_estimate)
    GROUP BY run_id, t_bucket, key, agg"""


@query("kpi_15m", KPI_SQL)
def _(v):
    return K.kpi_15m(v.tripwire, v.occupancy, v.pos_txn, v.queue_estimate)


@query("littles_law_dwell", """SELECT o.run_id, o.b AS t_bucket, round(o.l * 3600 / a.n, 6) AS dwell_s
    FROM (SELECT run_id, CAST(floor(t / 3600) AS BIGINT) * 3600 AS b, avg(count) AS l FROM v_occupancy GROUP BY ALL) o
    JOIN (SELECT run_id, CAST(floor(t / 3600) AS BIGINT) * 3600 AS b, count(*) AS n FROM v_tripwire
      WHERE dir = 'in' GROUP BY ALL) a ON a.run_id = o.run_id AND a.b = o.b""")
def _(v):
    return K.littles_law_dwell(v.occupancy, v.tripwire)


@query("fit_count_regression", """WITH p AS (SELECT l.run_id, CAST(list_sum(cells) AS DOUBLE) AS x,
      e.value AS y FROM v_lane_occ l JOIN v_ev e ON e.event_id = l.seq),
    f AS (SELECT run_id, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, regr_r2(y, x) AS r2
      FROM p GROUP BY ALL)
    SELECT f.run_id, round(f.a, 6) AS a, round(f.b, 6) AS b, round(f.r2, 6) AS r2,
      round(avg(abs(y - (f.a * x + f.b))), 6) AS mae FROM p JOIN f ON f.run_id = p.run_id
    GROUP BY f.run_id, f.a, f.b, f.r2""")
def _(v):
    total = F.aggregate("cells", F.lit(0).cast("bigint"), lambda s, c: s + c)
    y = v.ev.select(F.col("event_id").alias("seq"), F.col("value").alias("y"))
    pairs = v.lane_occ.select("run_id", "seq", total.alias("x")).join(y, "seq")
    return K.fit_count_regression(pairs, keys=["run_id"])
