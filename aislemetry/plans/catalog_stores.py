"""Queries over several stores, each with dimensions of its own."""
from __future__ import annotations

from pyspark.sql import functions as F

from aislemetry.operators import sequence as S
from aislemetry.plans import kpis as K
from aislemetry.plans.catalog_sequence import CROSS_SQL, HOURS6, STATUS_SQL
from aislemetry.plans.catalog_kpi import SHELF_ZONES
from aislemetry.plans.registry import query
from aislemetry.plans.views import EMPTY_BELOW, LOW_BELOW, WIRES
from aislemetry.schema import with_store

STORES = 3
STEP = 12                    # thresholds of store n lie n steps higher


def of_stores(df, *columns):
    """Rows of a dimension once per store, with columns that depend on the store's number `n`."""
    each = df.withColumn("n", F.explode(F.array(*[F.lit(n) for n in range(STORES)])))
    named = each.withColumn("store_id", F.concat(F.lit("store-"), F.col("n").cast("string")))
    return named.withColumns(dict(columns)).drop("n")


def rois(v):
    rows = [(f"A{k}",) for k in range(1, 7)]
    return of_stores(v.spark.createDataFrame(rows, "roi string"),
                     ("empty_below", F.lit(EMPTY_BELOW) + F.col("n") * STEP), ("low_below", F.lit(LOW_BELOW) + F.col("n") * STEP))


def planogram(v):
    return of_stores(v.planogram.withColumn("facing", F.concat(F.lit("A"), (F.col("sku") + 1).cast("string"))),
                     ("unit_price", F.col("unit_price") * (F.col("n") + 1)))


def status(v):
    return S.fill_status(v.shelf_fill, rois(v))


N = "CAST(right(store_id, 1) AS INTEGER)"
STORE_STATUS = {"v_status": STATUS_SQL.replace(f"smooth <= {EMPTY_BELOW}", f"smooth <= {EMPTY_BELOW} + {STEP} * {N}").replace(
    f"smooth <= {LOW_BELOW}", f"smooth <= {LOW_BELOW} + {STEP} * {N}")}


@query("fill_status_by_store", "SELECT * EXCLUDE (smoothed_fill) FROM v_status", STORE_STATUS)
def _(v):
    return status(v).drop("smoothed_fill")


@query("incident_alerts_by_store", """WITH i AS (SELECT *, lag(status) OVER (PARTITION BY run_id, roi ORDER BY t) AS p FROM v_status)
    SELECT run_id, t, 'critical' AS severity, 'stockout_detected' AS rule,
      'OUT OF STOCK: ' || p.name || ' (' || p.sku || ') at facing ' || i.roi AS message
    FROM i JOIN (SELECT 'A' || (sku + 1) AS roi, sku, name FROM v_planogram) p ON p.roi = i.roi
    WHERE status = 'empty' AND i.p IS DISTINCT FROM 'empty'""", STORE_STATUS)
def _(v):
    alerts = S.incident_alerts(S.shelf_incidents(status(v)), planogram(v))
    return alerts.where(F.col("rule") == "stockout_detected")


@query("compliance_by_store", """SELECT run_id, round(count(*) FILTER (s = 'normal' AND p.facing IS NOT NULL) * 100.0::DOUBLE
      / (SELECT count(DISTINCT 'A' || (sku + 1)) FROM v_planogram), 1) AS compliance
    FROM (SELECT run_id, roi, arg_max(status, t) AS s FROM v_status GROUP BY ALL)
    LEFT JOIN (SELECT DISTINCT 'A' || (sku + 1) AS facing FROM v_planogram) p ON p.facing = roi GROUP BY run_id""", STORE_STATUS)
def _(v):
    return K.compliance_score(status(v), planogram(v))


WIRE_ROWS = [(f"store-{n}", i, s, [a[0], a[1] + 10.0 * n], [b[0], b[1] + 10.0 * n], d)
             for n in range(STORES) for i, s, a, b, d in WIRES]
WIRE_VALUES = ", ".join(f"('{st}', '{i}', {a[0]}, {a[1]}, {b[0]}, {b[1]}, '{d}')" for st, i, _, a, b, d in WIRE_ROWS)
STORE_CROSS = CROSS_SQL.replace("w(wire_id,", "w(w_store, wire_id,").replace(
    CROSS_SQL[CROSS_SQL.index("VALUES ") + 7:CROSS_SQL.index("),\n")], WIRE_VALUES).replace(
    "FROM v_point p CROSS JOIN w", "FROM v_point p JOIN w ON w.w_store = 'store-' || substr(p.run_id, 5)")


@query("crossings_by_store", STORE_CROSS)
def _(v):
    wires = v.spark.createDataFrame(WIRE_ROWS, "store_id string, wire_id string, stream string, q1 array<double>, "
                                               "q2 array<double>, in_dir string")
    points = v.point.withColumn("store_id", F.concat(F.lit("store-"), F.substring("run_id", 5, 9)))
    return S.crossings(points, wires, band=12.0, debounce=HOURS6)


# Open incidents count up to one second past the last event of their own run.
NOWS = """SELECT w.run_id, t1 + 1 AS now, CAST(substr(w.run_id, 5) AS INTEGER) AS n FROM v_window w"""


def incidents(v):
    window = K.run_window(v.run, v.occupancy, v.tripwire, v.shelf_fill, v.visit)
    return K.with_now(with_store(v.stockout, v.run), window)


def prices(v):
    return of_stores(v.planogram, ("unit_price", F.col("unit_price") * (F.col("n") + 1)))


@query("lost_revenue_by_store", f"""SELECT s.run_id, round(fsum(greatest(0, coalesce(t_end, now) - t_start) / 3600
      * coalesce(p.rate * (n + 1), 0)), 2) AS lost_revenue FROM v_stockout s JOIN ({NOWS}) w ON w.run_id = s.run_id
    LEFT JOIN v_planogram p ON p.sku = s.sku GROUP BY ALL""")
def _(v):
    return K.lost_revenue(incidents(v), prices(v), "now")


@query("recent_stockouts_by_store", f"""SELECT run_id, roi AS facing, sku, round(e - t_start, 1) AS duration_s,
      round(greatest(0, e - t_start) / 3600 * coalesce(rate, 0), 2) AS lost, CASE WHEN t_end IS NULL THEN 'active' ELSE 'resolved'
      END AS status FROM (
    SELECT s.*, coalesce(t_end, now) AS e, p.rate * (n + 1) AS rate,
      row_number() OVER (PARTITION BY s.run_id ORDER BY t_start DESC, roi, s.sku, t_end NULLS FIRST) AS r
    FROM v_stockout s JOIN ({NOWS}) w ON w.run_id = s.run_id LEFT JOIN v_planogram p ON p.sku = s.sku) WHERE r <= 20""")
def _(v):
    return K.recent_stockouts(incidents(v), prices(v), "now")


# Store n calls facing k what store 0 calls facing k + n.
CASES = " ".join(f"WHEN '{r}' THEN {k}" for k, (r, _) in enumerate(SHELF_ZONES))
ZONE_LIST = "[" + ", ".join(f"'{z}'" for _, z in SHELF_ZONES) + "]"


@query("convert_by_shelf_by_store", f"""SELECT v.*, EXISTS (SELECT 1 FROM (SELECT *, {ZONE_LIST}[((CASE roi {CASES} END) + {N}) % 6 + 1]
        AS zone FROM v_shelf_fill WHERE fill <= 2) x WHERE x.run_id = v.run_id AND x.zone = v.zone
      AND x.t BETWEEN v.t_enter - 60 AND v.t_exit + 60) AS converted FROM v_visit v WHERE dwell_s >= 5""")
def _(v):
    rows = [(f"store-{n}", r, SHELF_ZONES[(k + n) % 6][1]) for n in range(STORES) for k, (r, _) in enumerate(SHELF_ZONES)]
    mapping = v.spark.createDataFrame(rows, "store_id string, source string, zone string")
    return K.convert_by_shelf(v.visit, v.shelf_fill, mapping, max_fill=2.0)
