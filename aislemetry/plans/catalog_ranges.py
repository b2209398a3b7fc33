"""Queries of readers and labels over files that Spark derives, the metric cards, and figures of a time range."""
from __future__ import annotations

from pyspark.sql import functions as F

from aislemetry.plans import dashboard as DB
from aislemetry.plans import kpis as K
from aislemetry.plans.catalog_kpi import BOUNDS, cells
from aislemetry.plans.catalog_tables import tables
from aislemetry.plans.registry import ORACLES, query
from aislemetry.session import shared_dir
from aislemetry.sources import readers as RD

# Two weeks in the middle of the driver's month, half-open.
T0, T1 = 1704672000.0, 1705881600.0


# --- dimension and label files -----------------------------------------------
def json_list(df, path):
    """One JSON list in one file, as a dimension is kept."""
    rows = df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*df.columns)))).alias("value"))
    rows.coalesce(1).write.mode("overwrite").text(path)


@query("read_dimensions", """SELECT 'store-7' AS store_id, CAST(row_number() OVER (ORDER BY 'F' || lpad(CAST(p_partkey AS VARCHAR), 9, '0')) - 1
      AS INTEGER) AS position, 'F' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS facing, 'S' || p_partkey AS sku, p_name AS name,
    p_retailprice AS unit_price, CAST(p_size AS DOUBLE) AS expected_sales_per_hour, p_size % 20 AS initial_stock,
    CAST(NULL AS INTEGER) AS low_threshold FROM part""")
def _(v):
    """The planogram of one store, written as its JSON list with an extra key and read back."""
    key = F.col("p_partkey").cast("string")
    folder = shared_dir(v.spark, "dimensions")
    json_list(v.table("part").select(
        F.concat(F.lit("F"), F.lpad(key, 9, "0")).alias("facing"), F.concat(F.lit("S"), key).alias("sku"),
        F.col("p_name").alias("name"), F.col("p_retailprice").alias("unit_price"),
        F.col("p_size").cast("double").alias("expected_sales_per_hour"), (F.col("p_size") % 20).alias("initial_stock"),
        F.lit("ignored").alias("remark")), f"{folder}/planogram.json")
    for name in ("zones", "rois", "lanes", "tripwires"):
        json_list(v.table("part").limit(0).select(F.lit("x").alias("id")), f"{folder}/{name}.json")
    return RD.read_dimensions(v.spark, folder, "store-7")["planogram"]


LABELS_PER_FILE = 10000        # event numbers


@query("read_ground_truth", """SELECT 'entries' AS part, run_id AS clip, count(*) AS n, round(sum(t), 3) AS total FROM v_tripwire
      WHERE dir = 'in' GROUP BY ALL
    UNION ALL SELECT 'exits', run_id, count(*), round(sum(t), 3) FROM v_tripwire WHERE dir = 'out' GROUP BY ALL
    UNION ALL SELECT 'occupancy', run_id, count(*), round(CAST(sum(count) AS DOUBLE), 3) FROM v_occupancy GROUP BY ALL
    UNION ALL SELECT 'stockouts', run_id, count(*), round(sum(t), 3) FROM v_stockout_event WHERE kind = 'start' GROUP BY ALL""")
def _(v):
    """Label files of every run: entries as objects, occupancy as pairs, stock-outs with open ends.

    A file is read by one task, so a run's labels are spread over files of a bounded number of events.
    """
    part = [F.col("run_id").alias("clip"), F.floor(F.col("seq") / LABELS_PER_FILE).alias("part")]
    door = v.tripwire.groupBy(*part).agg(F.collect_list(F.struct("t", "dir")).alias("entries"))
    seen = v.occupancy.groupBy(*part).agg(F.collect_list(F.array(
        F.col("t"), F.col("count").cast("double"))).alias("occupancy"))
    out = v.stockout_event.where("kind = 'start'").groupBy(*part).agg(F.collect_list(F.struct(
        F.col("roi").alias("facing"), F.col("t").alias("t_start"))).alias("stockouts"))
    # As before, a clip is labelled if it has events of all three kinds.
    clips = door.select("clip").distinct().join(seen.select("clip").distinct(), "clip").join(
        out.select("clip").distinct(), "clip")
    files = door.join(seen, ["clip", "part"], "full").join(out, ["clip", "part"], "full").join(clips, "clip", "left_semi")
    folder = shared_dir(v.spark, "labels")
    files.drop("part").write.option("maxRecordsPerFile", 1).json(folder)
    got = RD.read_ground_truth(v.spark, folder)

    def total(df, part, value):
        return df.groupBy("clip").agg(F.count("*").alias("n"), F.round(F.sum(value).cast("double"), 3).alias("total")).select(
            F.lit(part).alias("part"), "clip", "n", "total")

    return (total(got["entries"].where("dir = 'in'"), "entries", "t")
            .unionByName(total(got["entries"].where("dir = 'out'"), "exits", "t"))
            .unionByName(total(got["occupancy"], "occupancy", "count"))
            .unionByName(total(got["stockouts"], "stockouts", "t_start")))


@query("zone_labels", """SELECT name, round(least(92, greatest(2, (cx - 0) / 40 * 15 / 15 * 100)), 1) AS "left",
    round(least(92, greatest(2, (11 - cy / 32 * 11) / 11 * 100)), 1) AS top FROM (
    SELECT 'zone-' || p_partkey AS name, (p_partkey % 90 / 11.3::DOUBLE + p_size / 21.7::DOUBLE / 2) / 0.25 AS cx,
      (p_partkey % 70 / 10.7::DOUBLE + p_size / 15.9::DOUBLE / 2) / 0.25 AS cy FROM part)""")
def _(v):
    """Every part as a rectangular zone on a floor of 10 m x 8 m."""
    x, y = F.col("p_partkey") % 90 / 11.3, F.col("p_partkey") % 70 / 10.7
    w, h = F.col("p_size") / 21.7, F.col("p_size") / 15.9
    zones = v.table("part").select(F.concat(F.lit("zone-"), F.col("p_partkey").cast("string")).alias("id"), F.array(
        F.array(x, y), F.array(x + w, y), F.array(x + w, y + h), F.array(x, y + h)).alias("polygon"))
    return K.zone_labels(zones, (0.0, 40.0, 0.0, 32.0))


# --- metric cards --------------------------------------------------------------
def part(name):
    return f"({ORACLES[name]})"


@query("dashboard_headline", f"""SELECT run_id, occupancy, occupancy_t, entries, exits, net, shoppers, avg_dwell_s, browsed, engaged,
      transactions, revenue, conversion_rate, CASE WHEN occupancy >= 22 THEN 'amber' ELSE '' END AS occupancy_status,
      CASE WHEN net >= 22 THEN 'amber' ELSE '' END AS footfall_status,
      CASE WHEN avg_dwell_s / 60 >= 6.8 THEN 'red' WHEN avg_dwell_s / 60 >= 5.5 THEN 'amber' ELSE '' END AS dwell_status,
      CASE WHEN conversion_rate < 9.5 THEN 'red' WHEN conversion_rate < 11 THEN 'amber' ELSE '' END AS conversion_status,
      CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm'
        ELSE (s // 60) || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' END AS avg_dwell
    FROM (SELECT *, CAST(greatest(0, floor(coalesce(avg_dwell_s, 0) + 0.5)) AS BIGINT) AS s FROM {part('live_summary')}
      LEFT JOIN {part('footfall_totals')} USING (run_id) LEFT JOIN {part('shopper_totals')} USING (run_id)
      LEFT JOIN {part('revenue')} USING (run_id)
      LEFT JOIN (SELECT run_id, pct AS conversion_rate FROM {part('funnel')} WHERE step = 3) USING (run_id))""")
def _(v):
    return DB.headline(tables(v))


# --- the whole dashboard -----------------------------------------------------------
def figures(tile, source, item, measures, label="CAST(NULL AS VARCHAR)"):
    return " UNION ALL ".join(f"""SELECT run_id, '{tile}' AS tile, {item} AS item, {label} AS label, '{m}' AS measure,
      CAST({m} AS DOUBLE) AS value FROM {source}""" for m in measures)


BOARD_SQL = f"""WITH w AS (SELECT run_id, t0, t1, t1 + 1 AS now FROM v_window),
    shop AS (SELECT s.*, coalesce(t_end, now) AS e, coalesce(p.rate, 0) AS rate FROM v_stockout s
      JOIN w ON w.run_id = s.run_id LEFT JOIN v_planogram p ON p.sku = s.sku),
    recent AS (SELECT run_id, roi || ':' || sku AS item, round(e - t_start, 1) AS duration_s,
        round(greatest(0, e - t_start) / 3600 * rate, 2) AS lost,
        CASE WHEN t_end IS NULL THEN 'active' ELSE 'resolved' END AS status
      FROM shop QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY t_start DESC, roi, sku, t_end NULLS FIRST) <= 20),
    lost AS (SELECT run_id, round(fsum(greatest(0, e - t_start) / 3600 * rate), 2) AS lost_revenue FROM shop GROUP BY ALL),
    board AS (SELECT b.*, i.sku, i.name FROM (SELECT f.run_id, f.roi, CAST(floor(fill) AS BIGINT) AS fill,
          CASE WHEN fill < 60 THEN 'empty' WHEN fill < 110 THEN 'low' WHEN fill < 180 THEN 'partial' ELSE 'full' END AS state
        FROM (SELECT run_id, roi, arg_max(fill, t) AS fill FROM v_shelf_fill GROUP BY ALL) f) b
      LEFT JOIN (SELECT 'A' || (p_partkey % 6 + 1) AS roi, max(p_partkey) AS sku, arg_max(p_name, p_partkey) AS name
        FROM part GROUP BY ALL) i ON i.roi = b.roi),
    hours AS (SELECT w.run_id, h.range AS hour, count(x.t) AS entries FROM w CROSS JOIN range(24) h
      LEFT JOIN v_tripwire x ON x.run_id = w.run_id AND x.dir = 'in' AND floor(x.t / 86400) = floor(w.now / 86400)
        AND CAST(floor((x.t - floor(x.t / 86400) * 86400) / 3600) AS BIGINT) = h.range GROUP BY ALL)
    """ + " UNION ALL ".join([
    figures("window", "w", "''", ["t0", "t1"]),
    figures("live", part("live_summary"), "''", ["occupancy", "occupancy_t"]),
    figures("totals", part("footfall_totals"), "''", ["entries", "exits", "net"]),
    figures("shoppers", part("shopper_totals"), "''", ["shoppers", "avg_dwell_s", "browsed", "engaged"]),
    figures("zones", part("dwell_by_zone"), "zone", ["visits", "median_dwell_s", "p90_dwell_s"]),
    figures("queue", part("queue_status"), "CAST(lane AS VARCHAR)", ["count", "pred_wait_s"]),
    figures("shelf", "board", "roi", ["fill"], "concat_ws(' | ', state, sku, name)"),
    figures("stockouts", "recent", "item", ["duration_s", "lost"], "status"),
    figures("lost_revenue", "lost", "''", ["lost_revenue"]),
    figures("replenishment", part("replenishment_top"), "CAST(rank AS VARCHAR)", ["revenue_rate"], "roi || ' | ' || sku"),
    figures("alerts", part("alerts_recent"), "rule", ["t"], "severity || ' | ' || message"),
    figures("heatmap", part("heatmap_grid"), "row || ':' || col", ["heat"]),
    figures("footfall_hourly", "hours", "CAST(hour AS VARCHAR)", ["entries"]),
    figures("footfall_spark", part("footfall_spark"), "CAST(bucket AS VARCHAR)", ["entries"]),
    figures("revenue", part("revenue"), "''", ["transactions", "revenue"]),
    figures("funnel", part("funnel"), "label", ["value", "pct"])])


def dashboard_tables(v):
    """The driver's tables with its heat cells, and its parts on the shelves that are watched."""
    return {**tables(v), "heatmap": K.heatmap_accumulate(cells(v)), "planogram": v.planogram.withColumn(
        "facing", F.concat(F.lit("A"), (F.col("sku") % 6 + 1).cast("string")))}


@query("dashboard_board", BOARD_SQL)
def _(v):
    return DB.board(dashboard_tables(v), bounds=BOUNDS)


@query("dashboard_documents", f"""SELECT run_id, {", ".join(f"CAST(count(*) FILTER (tile = '{tile}') AS INTEGER) AS n_{tile}"
    for tile in DB.TILES)}, count(*) AS n FROM ({BOARD_SQL}) GROUP BY run_id""")
def _(v):
    """The figures of every tile in the one document of each run."""
    d = DB.documents(dashboard_tables(v), bounds=BOUNDS)
    sizes = {f"n_{tile}": F.size(tile) for tile in DB.TILES}
    return d.select("run_id", *[n.alias(k) for k, n in sizes.items()]).withColumn(
        "n", sum(F.col(k) for k in sizes).cast("bigint"))


# --- figures of a time range -----------------------------------------------------
RANGE = f"t_enter >= {T0} AND t_enter < {T1}"


@query("dwell_by_zone_range", f"""SELECT run_id, zone, len(d) AS visits, d[len(d) // 2 + 1] AS median_dwell_s,
    d[CAST(ceil(len(d) * 9 / 10) AS BIGINT)] AS p90_dwell_s
    FROM (SELECT run_id, zone, list_sort(list(dwell_s)) AS d FROM v_visit WHERE {RANGE} GROUP BY ALL)""")
def _(v):
    return K.dwell_by_zone(v.visit, T0, T1)


@query("stockout_durations_range", """SELECT run_id, roi, sku, t_start, t_end, t_end - t_start AS duration_s FROM v_stockout
    WHERE t_end IS NOT NULL AND t_start >= 757382400 AND t_start < 820454400""")
def _(v):
    return K.stockout_durations(v.stockout, 757382400.0, 820454400.0)


@query("wait_pred_vs_actual_range", f"""WITH q AS (SELECT * FROM v_queue_truth WHERE t >= {T0} AND t < {T1}),
    e AS (SELECT * FROM v_queue_estimate WHERE t >= {T0} AND t < {T1})
    SELECT clip, t, lane, pred_wait_s, actual_wait_s, pred_wait_s - actual_wait_s AS error_s FROM (
      SELECT q.clip, q.t, q.lane, q.actual_wait_s, CASE WHEN b.t IS NOT NULL AND (a.t IS NULL OR q.t - b.t <= a.t - q.t)
        THEN b.pred_wait_s ELSE a.pred_wait_s END AS pred_wait_s
      FROM q ASOF LEFT JOIN e b ON q.clip = b.run_id AND q.t >= b.t ASOF LEFT JOIN e a ON q.clip = a.run_id AND q.t < a.t)
    WHERE pred_wait_s IS NOT NULL""")
def _(v):
    return K.wait_pred_vs_actual(v.queue_truth, v.queue_estimate, T0, T1)
