"""Queries of the ordered, stateful operators."""
from __future__ import annotations

from pyspark.sql import functions as F

from aislemetry.functions import timebuckets as TB
from aislemetry.operators import sequence as S
from aislemetry.operators.ordered import ema, resolve
from aislemetry.operators.thinning import throttle
from aislemetry.plans import kpis as K
from aislemetry.plans.registry import query
from aislemetry.plans.views import EMPTY_BELOW, LOW_BELOW, WIRES

# The driver's events are minutes apart, so periods are hours here.
HOURS2, HOURS6, DAY = 7200.0, 21600.0, 86400.0


def kept(source, period, op=">="):
    """Recursive CTE text: the greedily kept times of `source(k, t)`."""
    return f"""kept(k, t) AS (SELECT k, min(t) FROM {source} GROUP BY k UNION ALL
      SELECT kept.k, (SELECT min(s.t) FROM {source} s WHERE s.k = kept.k AND s.t - kept.t {op} {period})
      FROM kept WHERE kept.t IS NOT NULL)"""


@query("throttle_occupancy", f"""WITH RECURSIVE src AS (SELECT run_id AS k, * FROM v_occupancy),
    {kept('src', HOURS6)} SELECT s.run_id, s.t, s.seq, s.count FROM src s JOIN kept ON kept.k = s.k
    AND kept.t = s.t""")
def _(v):
    occ = v.occupancy.select("run_id", "t", "seq", "count")
    return throttle(occ, ["run_id"], ["t", "seq"], HOURS6)


@query("visits", "SELECT * FROM v_visit")
def _(v):
    return v.visit


@query("checkout_sales", """SELECT run_id, t_exit AS t, CAST(1 AS BIGINT) AS lane FROM v_visit
    WHERE zone = 'checkout' AND t_exit - t_enter >= 50000""")
def _(v):
    return S.checkout_sales(v.visit, min_dwell=50000.0)


def wires(v):
    rows = [(i, s, list(a), list(b), d) for i, s, a, b, d in WIRES]
    return v.spark.createDataFrame(
        rows, "wire_id string, stream string, q1 array<double>, q2 array<double>, in_dir string")


WIRE_VALUES = ", ".join(f"('{i}', {a[0]}, {a[1]}, {b[0]}, {b[1]}, '{d}')" for i, _, a, b, d in WIRES)
CROSS_SQL = f"""WITH RECURSIVE w(wire_id, x1, y1, x2, y2, in_dir) AS (VALUES {WIRE_VALUES}),
    p AS (SELECT p.*, w.*, ((x2 - x1) * (v - y1) - (y2 - y1) * (u - x1))
        / sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS d,
      row_number() OVER (PARTITION BY run_id, track_id, wire_id ORDER BY t) AS rn FROM v_point p CROSS JOIN w),
    m AS (SELECT *, CASE WHEN d > 0 THEN 1 ELSE -1 END AS side,
      CASE WHEN rn = 1 OR abs(d) >= 12 THEN CASE WHEN d > 0 THEN 1 ELSE -1 END END AS mark FROM p),
    c AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY run_id, track_id, wire_id ORDER BY t
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m),
    a AS (SELECT *, last_value(CASE WHEN side = coalesce(mark, before) THEN {{'u': u, 'v': v}} END IGNORE NULLS)
      OVER (PARTITION BY run_id, track_id, wire_id ORDER BY t
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM c),
    h AS (SELECT *, (x2 - x1) * (anchor.v - y1) - (y2 - y1) * (anchor.u - x1) AS d1,
      (x2 - x1) * (v - y1) - (y2 - y1) * (u - x1) AS d2,
      (u - anchor.u) * (y1 - anchor.v) - (v - anchor.v) * (x1 - anchor.u) AS d3,
      (u - anchor.u) * (y2 - anchor.v) - (v - anchor.v) * (x2 - anchor.u) AS d4
      FROM a WHERE before IS NOT NULL AND mark <> before),
    src AS (SELECT run_id || '/' || track_id || '/' || wire_id AS k, * FROM h
      WHERE (d1 > 0) <> (d2 > 0) AND (d3 > 0) <> (d4 > 0)),
    {kept('src', HOURS6)}
    SELECT s.run_id, s.track_id, s.wire_id, s.t, s.seq, CASE WHEN (d2 > 0) = (CASE in_dir
      WHEN 'up' THEN -(x2 - x1) WHEN 'down' THEN x2 - x1 WHEN 'left' THEN y2 - y1 ELSE -(y2 - y1) END > 0)
      THEN 'in' ELSE 'out' END AS dir
    FROM src s JOIN kept ON kept.k = s.k AND kept.t = s.t"""


@query("crossings", CROSS_SQL)
def _(v):
    return S.crossings(v.point, wires(v), band=12.0, debounce=HOURS6)


# Independent model: the stack of open starts per key, folded in event order.
@query("close_stockouts", """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY run_id, roi, sku
        ORDER BY t, seq) AS rn FROM v_stockout_event),
    f(run_id, roi, sku, rn, stack, closed) AS (
      SELECT DISTINCT run_id, roi, sku, CAST(0 AS BIGINT), CAST([] AS DOUBLE[]), CAST(NULL AS DOUBLE) FROM e
      UNION ALL SELECT f.run_id, f.roi, f.sku, e.rn,
        CASE WHEN e.kind = 'start' THEN list_append(f.stack, e.t) ELSE f.stack[:-2] END,
        CASE WHEN e.kind = 'end' THEN f.stack[-1] END
      FROM f JOIN e ON e.run_id = f.run_id AND e.roi = f.roi AND e.sku = f.sku AND e.rn = f.rn + 1)
    SELECT s.run_id, s.roi, s.sku, s.t AS t_start, x.t AS t_end FROM e s
    LEFT JOIN (SELECT f.run_id, f.roi, f.sku, f.closed, e.t FROM f JOIN e ON e.run_id = f.run_id
        AND e.roi = f.roi AND e.sku = f.sku AND e.rn = f.rn WHERE f.closed IS NOT NULL) x
      ON x.run_id = s.run_id AND x.roi = s.roi AND x.sku = s.sku AND x.closed = s.t
    WHERE s.kind = 'start'""")
def _(v):
    return S.close_stockouts(v.stockout_event)


@query("one_incident", """SELECT * EXCLUDE (p) FROM (SELECT *, lag(kind) OVER (PARTITION BY run_id, roi
    ORDER BY t, seq) AS p FROM v_stockout_event) WHERE kind <> coalesce(p, 'end')""")
def _(v):
    return S.one_incident(v.stockout_event)


@query("ema", """SELECT run_id, lane, t, seq, round(list_reduce(list(pred_wait_s) OVER (
    PARTITION BY run_id, lane ORDER BY t ROWS UNBOUNDED PRECEDING), lambda a, x: 0.3 * x + 0.7 * a), 6) AS smooth
    FROM v_queue_estimate""")
def _(v):
    q, keys = v.queue_estimate, ["run_id", "lane"]
    q = ema(q, keys, ["t", "seq"], "pred_wait_s", 0.3, "smooth", resolve("auto", q, keys))
    return q.select("run_id", "lane", "t", "seq", F.round("smooth", 6).alias("smooth"))


STATUS_SQL = f"""SELECT run_id, store_id, roi, t, seq, fill AS raw_fill, round(smooth, 1) AS smoothed_fill,
      coalesce(last_value(CASE WHEN votes >= len(h) // 2 + 1 THEN lead END IGNORE NULLS) OVER (
        PARTITION BY run_id, roi ORDER BY t ROWS UNBOUNDED PRECEDING), 'normal') AS status,
      round(votes / len(h), 2) AS confidence FROM (
    SELECT *, greatest(n, l, e) AS votes, CASE WHEN n = greatest(n, l, e) THEN 'normal'
        WHEN l = greatest(n, l, e) THEN 'low' ELSE 'empty' END AS lead FROM (
      SELECT *, len(list_filter(h, lambda s: s = 'normal')) AS n, len(list_filter(h, lambda s: s = 'low')) AS l,
        len(list_filter(h, lambda s: s = 'empty')) AS e FROM (
        SELECT *, list(CASE WHEN smooth <= {EMPTY_BELOW} THEN 'empty' WHEN smooth <= {LOW_BELOW} THEN 'low'
            ELSE 'normal' END) OVER (PARTITION BY run_id, roi ORDER BY t ROWS 4 PRECEDING) AS h FROM (
          SELECT *, list_reduce(list_prepend(arr[1], arr), lambda a, x: 0.35 * x + 0.65 * a) AS smooth FROM (
            SELECT *, list(fill) OVER (PARTITION BY run_id, roi ORDER BY t ROWS UNBOUNDED PRECEDING) AS arr
            FROM v_shelf_fill)))))"""
STATUS = {"v_status": STATUS_SQL}


def status(v):
    return S.fill_status(v.shelf_fill, empty_below=EMPTY_BELOW, low_below=LOW_BELOW)


@query("fill_status", "SELECT * FROM v_status", STATUS)
def _(v):
    return status(v)


INCIDENT_SQL = """SELECT * EXCLUDE (p, latch) FROM (
      SELECT *, unnest(list_filter([CASE WHEN status = 'empty' AND p IS DISTINCT FROM 'empty' THEN 'start' END,
        CASE WHEN status = 'empty' AND p IS DISTINCT FROM 'empty' THEN 'alert_out' END,
        CASE WHEN status <> 'empty' AND p = 'empty' THEN 'end' END,
        CASE WHEN status = 'low' AND latch IS DISTINCT FROM 'low' THEN 'alert_low' END],
        lambda k: k IS NOT NULL)) AS kind FROM (
        SELECT *, lag(status) OVER (PARTITION BY run_id, roi ORDER BY t) AS p,
          last_value(CASE WHEN status IN ('low', 'normal') THEN status END IGNORE NULLS) OVER (
            PARTITION BY run_id, roi ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latch
        FROM v_status))"""


@query("shelf_incidents", INCIDENT_SQL, STATUS)
def _(v):
    return S.shelf_incidents(status(v))


@query("incident_alerts", """SELECT i.run_id, i.t,
      CASE kind WHEN 'alert_out' THEN 'critical' ELSE 'warning' END AS severity,
      CASE kind WHEN 'alert_out' THEN 'stockout_detected' ELSE 'low_stock_detected' END AS rule,
      CASE kind WHEN 'alert_out' THEN 'OUT OF STOCK: ' || p.name || ' (' || p.sku || ') at facing ' || i.roi
        ELSE 'LOW STOCK: ' || p.name || ' (' || p.sku || ') at facing ' || i.roi || ' (fill ' || smoothed_fill || ')'
      END AS message
    FROM v_incident i JOIN (SELECT 'A' || (sku + 1) AS roi, sku, name FROM v_planogram) p ON p.roi = i.roi
    WHERE kind IN ('alert_out', 'alert_low')""", {**STATUS, "v_incident": INCIDENT_SQL})
def _(v):
    plan = v.planogram.withColumn("facing", F.concat(F.lit("A"), (F.col("sku") + 1).cast("string")))
    return S.incident_alerts(S.shelf_incidents(status(v)), plan)


VIOLATION_SQL = """SELECT run_id, roi, t, seq, observed FROM (
      SELECT *, lag(observed) OVER (PARTITION BY run_id, roi ORDER BY t) AS p FROM (
        SELECT *, CASE WHEN status IN ('empty', 'low') THEN status ELSE 'ok' END AS observed FROM v_status))
    WHERE observed <> 'ok' AND observed IS DISTINCT FROM p"""


@query("planogram_violations", VIOLATION_SQL, STATUS)
def _(v):
    return S.planogram_violations(status(v))


@query("one_alert", """SELECT * EXCLUDE (p, reset) FROM (
      SELECT *, lag(reset) OVER (PARTITION BY run_id, roi, rule ORDER BY t, seq) AS p FROM (
        SELECT run_id, roi, t, seq, CASE kind WHEN 'start' THEN 'stockout_detected' ELSE 'low_stock_detected' END AS rule,
          false AS reset FROM v_stockout_event
        UNION ALL SELECT run_id, roi, t, -1, r, true FROM v_status, unnest(['stockout_detected', 'low_stock_detected']) u(r)
          WHERE status = 'normal')) WHERE NOT reset AND coalesce(p, true)""", STATUS)
def _(v):
    raised = v.stockout_event.select("run_id", "roi", "t", "seq", F.when(
        F.col("kind") == "start", "stockout_detected").otherwise("low_stock_detected").alias("rule"))
    return S.one_alert(raised, status(v))


@query("compliance_score", """SELECT run_id, round(count(*) FILTER (s = 'normal' AND p.facing IS NOT NULL) * 100.0::DOUBLE
      / (SELECT count(DISTINCT 'A' || (sku + 1)) FROM v_planogram), 1) AS compliance
    FROM (SELECT run_id, roi, arg_max(status, t) AS s FROM v_status GROUP BY ALL)
    LEFT JOIN (SELECT DISTINCT 'A' || (sku + 1) AS facing FROM v_planogram) p ON p.facing = roi GROUP BY run_id""",
       STATUS)
def _(v):
    plan = v.planogram.withColumn("facing", F.concat(F.lit("A"), (F.col("sku") + 1).cast("string")))
    return K.compliance_score(status(v), plan)


ALERT_SQL = """SELECT store_id, t, seq, 'stockout' AS rule, 'warning' AS severity, roi || ' empty' AS message
      FROM v_stockout_event WHERE kind = 'start'
    UNION ALL SELECT store_id, t, seq, 'stockout_long', 'critical',
        roi || ' empty for ' || CAST(floor(t - pt) AS BIGINT) || 's' FROM (
      SELECT *, lag(kind) OVER w AS pk, lag(t) OVER w AS pt FROM v_stockout_event
      WINDOW w AS (PARTITION BY store_id, roi ORDER BY t, seq))
      WHERE kind = 'end' AND pk = 'start' AND t - pt > 300
    UNION ALL SELECT store_id, t, seq, 'wait_over', 'warning', 'lane ' || lane || ' predicted wait '
        || CAST(round_even(pred_wait_s, 0) AS BIGINT) || 's > 60.0s' FROM v_queue_estimate WHERE pred_wait_s > 60
    UNION ALL SELECT store_id, t, seq, 'occupancy_over', 'info', 'occupancy ' || count || ' > 50'
      FROM v_occupancy WHERE count > 50"""
COOLDOWN = {"stockout": HOURS2, "stockout_long": HOURS6, "wait_over": HOURS2,
            "occupancy_over": HOURS2, "clock_unsynced": DAY}


def alert_inputs(v):
    return (v.stockout_event, v.queue_estimate, v.occupancy)


@query("alert_candidates", "SELECT * FROM v_hit", {"v_hit": ALERT_SQL})
def _(v):
    return S.alert_candidates(*alert_inputs(v), target_wait_s=60.0)


@query("alerts_from_events", f"""WITH RECURSIVE src AS (SELECT store_id || rule AS k, * FROM v_hit),
    kept(k, t) AS (SELECT k, min(t) FROM src GROUP BY k UNION ALL
      SELECT kept.k, (SELECT min(s.t) FROM src s WHERE s.k = kept.k
        AND s.t - kept.t >= CASE WHEN s.rule = 'stockout_long' THEN {HOURS6} ELSE {HOURS2} END)
      FROM kept WHERE kept.t IS NOT NULL)
    SELECT s.* EXCLUDE (k) FROM src s JOIN kept ON kept.k = s.k AND kept.t = s.t""", {"v_hit": ALERT_SQL})
def _(v):
    return S.alerts_from_events(*alert_inputs(v), target_wait_s=60.0, rules=COOLDOWN)


RATE_SQL = """SELECT run_id, seq, t, n AS arrivals, CASE WHEN n > 0 THEN n / greatest(t - first, 1.0) ELSE 0.0 END
      AS lambda_per_s FROM (
    SELECT p.run_id, p.seq, p.t, count(e.t) AS n, min(e.t) AS first FROM {probes} p
    LEFT JOIN v_tripwire e ON e.run_id = p.run_id AND e.dir = 'in' AND e.t > p.t - 86400 AND e.t <= p.t
    GROUP BY p.run_id, p.seq, p.t)"""


def entries(v):
    return v.tripwire.where(F.col("dir") == "in")


@query("arrival_rate", RATE_SQL.format(probes="v_occupancy"))
def _(v):
    return S.arrival_rate(entries(v), v.occupancy, DAY)


ESTIMATE_SQL = """SELECT run_id, lane, t, seq, round(c, 2) AS count, round(c * 45.0::DOUBLE, 1) AS pred_wait_s FROM (
    SELECT *, list_reduce(list(n) OVER (PARTITION BY run_id, lane ORDER BY t ROWS UNBOUNDED PRECEDING),
      lambda a, x: 0.3::DOUBLE * x + 0.7::DOUBLE * a) AS c FROM (
      SELECT *, len(list_filter(cells, lambda c: c > 40)) * 0.8::DOUBLE AS n FROM v_lane_occ))"""


@query("queue_estimates", ESTIMATE_SQL)
def _(v):
    return S.queue_estimates(v.lane_occ)


@query("staffing_alerts", f"""WITH RECURSIVE src AS (SELECT run_id AS k, run_id, t, seq FROM v_occupancy),
    {kept('src', HOURS6)},
    tick AS (SELECT s.* FROM src s JOIN kept ON kept.k = s.k AND kept.t = s.t),
    r AS ({RATE_SQL.format(probes='tick')}),
    w AS (SELECT r.*, c, lambda_per_s * 7200 AS rho, pow(lambda_per_s * 7200, c) / factorial(CAST(c AS INTEGER))
        / (1 - lambda_per_s * 7200 / c) AS tail FROM r CROSS JOIN (SELECT range AS c FROM range(1, 17))
      WHERE lambda_per_s * 7200 < c),
    x AS (SELECT *, tail / (list_sum(list_transform(range(c), lambda k: pow(rho, k) / factorial(CAST(k AS INTEGER)))) + tail)
        / (c / 7200 - rho / 7200) AS wq FROM w)
    SELECT run_id, t, seq, 'warning' AS severity, 'open_counter' AS rule, CAST(min(c) AS INTEGER) AS open,
      round(lambda_per_s * 60, 2) AS lambda_per_min, round(arg_min(wq, c), 0) AS projected_wait_s
    FROM x WHERE wq <= 600 AND lambda_per_s > 0 GROUP BY run_id, t, seq, lambda_per_s HAVING min(c) > 2""")
def _(v):
    return S.staffing_alerts(entries(v), v.occupancy, counters=2, service_s=7200.0,
                             target_wait_s=600.0, period=HOURS6, window=DAY)


@query("holt_arrivals", """SELECT run_id, round(s.level, 6) AS level, round(s.trend, 6) AS trend,
      round(s.level + 3 * s.trend, 6) AS forecast FROM (
    SELECT run_id, list_reduce(list_prepend({'level': v[1], 'trend': v[2] - v[1]},
      list_transform(v[2:], lambda x: {'level': x, 'trend': 0.0::DOUBLE})), lambda a, x: {
        'level': 0.3::DOUBLE * x.level + 0.7::DOUBLE * (a.level + a.trend),
        'trend': 0.1::DOUBLE * (0.3::DOUBLE * x.level + 0.7::DOUBLE * (a.level + a.trend) - a.level) + 0.9::DOUBLE * a.trend}) AS s
    FROM (SELECT run_id, list(n ORDER BY b) AS v FROM (
      SELECT run_id, floor(t / 900) AS b, CAST(count(*) AS DOUBLE) AS n FROM v_tripwire WHERE dir = 'in'
      GROUP BY ALL) GROUP BY run_id))""")
def _(v):
    s = entries(v).groupBy("run_id", TB.quarter_start(F.col("t")).alias("bucket")).agg(
        F.count("*").alias("value"))
    h = S.holt(s, horizon=3)
    return h.select("run_id", *[F.round(c, 6).alias(c) for c in ("level", "trend", "forecast")])


@query("reach_events", f"""WITH RECURSIVE m AS (SELECT run_id, roi, t, seq, fill,
      (fill / 500 >= 0.05 AND seq * 7 % 256 > 120) OR fill / 500 > 0.12 AS act FROM v_shelf_fill),
    g AS (SELECT *, coalesce(sum(CASE WHEN act THEN 0 ELSE 1 END) OVER (PARTITION BY run_id, roi ORDER BY t
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM m),
    src AS (SELECT run_id || roi AS k, run_id, roi, max(t) FILTER (NOT act) AS t,
        max(seq) FILTER (NOT act) AS seq, count(*) FILTER (act) AS frames FROM g GROUP BY run_id, roi, g
      HAVING count(*) FILTER (act) >= 3 AND count(*) FILTER (NOT act) = 1),
    {kept('src', HOURS2, '>')}
    SELECT s.run_id, s.roi, s.t, s.seq, s.frames FROM src s JOIN kept ON kept.k = s.k AND kept.t = s.t""")
def _(v):
    motion = v.shelf_fill.select("run_id", "roi", "t", "seq", (F.col("fill") / 500).alias("ratio"),
                                 (F.col("seq") * 7 % 256).alias("peak"))
    return S.reach_events(motion, cooldown=HOURS2)


def stock(v):
    rows = v.planogram.select(
        F.concat(F.lit("A"), (F.col("sku") + 1).cast("string")).alias("roi"), F.lit(10).alias("initial_stock"),
        F.lit(None).cast("int").alias("low_threshold"), "unit_price")
    return rows


def wide_status(v):
    return S.fill_status(v.shelf_fill, empty_below=55, low_below=90)


WIDE = {"v_wide": STATUS_SQL.replace(f"smooth <= {EMPTY_BELOW}", "smooth <= 55").replace(
    f"smooth <= {LOW_BELOW}", "smooth <= 90")}
# Independent model: stock and window of each facing, folded in event order.
COMMIT_SQL = """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY run_id, roi ORDER BY t) AS rn,
      CASE status WHEN 'empty' THEN 0 WHEN 'low' THEN 3 ELSE 10 END AS q FROM v_wide),
    f(run_id, roi, rn, t, seq, stock, win, removed) AS (
      SELECT DISTINCT run_id, roi, CAST(0 AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT), 10,
        CAST([] AS INTEGER[]), 0 FROM e
      UNION ALL SELECT run_id, roi, rn, t, seq, coalesce(hit, stock),
        CASE WHEN hit IS NULL THEN w ELSE list_transform(w, lambda x: hit) END, CASE WHEN hit IS NULL THEN 0 ELSE stock - hit END
      FROM (SELECT *, CASE WHEN len(w) >= 15 AND len(list_filter(w, lambda x: x = 0)) >= 12.75 AND 0 < stock THEN 0
          WHEN len(w) >= 15 AND len(list_filter(w, lambda x: x = 3)) >= 12.75 AND 3 < stock THEN 3 END AS hit FROM (
        SELECT e.run_id, e.roi, e.rn, e.t, e.seq, f.stock, list_append(f.win, e.q)[-15:] AS w
        FROM f JOIN e ON e.run_id = f.run_id AND e.roi = f.roi AND e.rn = f.rn + 1)))
    SELECT f.run_id, f.roi, f.t, f.seq, f.removed, f.stock AS remaining, f.removed * p.unit_price AS revenue,
      CASE WHEN f.stock = 0 THEN 'stockout_detected' WHEN f.stock <= 3 THEN 'low_stock_detected' END AS rule
    FROM f JOIN v_planogram p ON 'A' || (p.sku + 1) = f.roi WHERE removed > 0"""


@query("inventory", COMMIT_SQL, WIDE)
def _(v):
    return S.inventory(wide_status(v), stock(v))


@query("inventory_summary", f"""WITH RECURSIVE c AS (SELECT * FROM ({COMMIT_SQL}))
    SELECT x.run_id, x.roi, 10 AS initial, 10 - coalesce(g, 0) AS current, coalesce(g, 0) AS removed,
      round(coalesce(g, 0) * p.unit_price, 2) AS taken_value
    FROM (SELECT DISTINCT run_id, roi FROM v_wide) x JOIN v_planogram p ON 'A' || (p.sku + 1) = x.roi
    LEFT JOIN (SELECT run_id, roi, CAST(sum(removed) AS BIGINT) AS g FROM c GROUP BY ALL) y
      ON y.run_id = x.run_id AND y.roi = x.roi""", WIDE)
def _(v):
    s = wide_status(v)
    return K.inventory_summary(S.inventory(s, stock(v)), s, stock(v))


# Independent model: as above, with picks of one or two items in the place of every eleventh reading.
PICK_SQL = COMMIT_SQL.replace("CASE status WHEN 'empty' THEN 0 WHEN 'low' THEN 3 ELSE 10 END AS q FROM v_wide",
    "CASE status WHEN 'empty' THEN 0 WHEN 'low' THEN 3 ELSE 10 END AS q, CASE WHEN seq % 11 = 0 THEN 1 + seq % 2 END AS pick FROM v_wide").replace(
    "SELECT *, CASE WHEN len(w) >= 15", "SELECT *, CASE WHEN pick IS NOT NULL THEN CASE WHEN stock > 0 THEN greatest(0, stock - pick) END WHEN len(w) >= 15").replace(
    "f.stock, list_append(f.win, e.q)[-15:] AS w", "f.stock, e.pick, CASE WHEN e.pick IS NULL THEN list_append(f.win, e.q)[-15:] ELSE f.win END AS w").replace(
    "CASE WHEN hit IS NULL THEN 0 ELSE stock - hit END", "CAST(CASE WHEN hit IS NULL THEN 0 ELSE stock - hit END AS INTEGER)").replace(
    "coalesce(hit, stock),", "CAST(coalesce(hit, stock) AS INTEGER),").replace("lambda x: hit)", "lambda x: CAST(hit AS INTEGER))")


def picked(v):
    s = wide_status(v).select("run_id", "roi", "t", "seq", "status")
    pick = F.col("seq") % 11 == 0
    removals = s.where(pick).select("run_id", "roi", "t", "seq", (F.col("seq") % 2 + 1).alias("quantity"))
    return S.inventory_with_removals(s.where(~pick), removals, stock(v))


@query("inventory_with_removals", PICK_SQL, WIDE)
def _(v):
    return picked(v)


@query("inventory_incidents", f"""WITH RECURSIVE c AS (SELECT * FROM ({PICK_SQL}))
    SELECT run_id, roi, t, seq, 'start' AS kind FROM c WHERE remaining = 0""", WIDE)
def _(v):
    return S.inventory_incidents(picked(v))
