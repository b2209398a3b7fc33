"""Queries of sources, checks, routing, maintenance and scalar functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from aislemetry.functions import labels as L
from aislemetry.functions import queueing as Q
from aislemetry.functions import timebuckets as TB
from aislemetry.plans import kpis as K
from aislemetry.plans.catalog_kpi import KPI_SQL
from aislemetry.plans.registry import query
from aislemetry.session import shared_dir
from aislemetry.sources import maintain as M
from aislemetry.sources import readers as RD
from aislemetry.sources import sinks as SK
from aislemetry.sources import validate as V

NOW = 1706745600.0             # the hour after the last driver event

# --- envelopes ---------------------------------------------------------------
ENV = {"v_env": """SELECT *, CASE event_type WHEN 'tripwire' THEN ['dir', 'tripwire_id']
      WHEN 'queue_estimate' THEN ['count', 'lane', 'pred_wait_s'] WHEN 'occupancy' THEN ['count']
      WHEN 'pos_txn' THEN ['amount', 'items', 'lane', 'zone_hint'] WHEN 'stockout_start' THEN ['facing', 'sku'] END AS want,
    CASE src WHEN 'view' THEN ['dir', 'tripwire_id'] WHEN 'click' THEN ['count', 'lane', 'pred_wait_s']
      WHEN 'signup' THEN ['count'] WHEN 'purchase' THEN ['amount', 'items', 'lane'] ELSE ['facing', 'sku'] END AS got FROM (
    SELECT event_id AS seq, t, store_id, run_id, track_id, value, event_type AS src,
      CASE WHEN event_id % 11 = 0 THEN 'cellar' ELSE 'overhead' END AS stream,
      CASE event_type WHEN 'view' THEN 'tripwire' WHEN 'click' THEN 'queue_estimate' WHEN 'signup' THEN 'occupancy'
        WHEN 'purchase' THEN 'pos_txn' ELSE CASE WHEN event_id % 7 = 0 THEN 'mystery' ELSE 'stockout_start' END
      END AS event_type FROM v_ev)"""}
CHECK = {**ENV, "v_check": """SELECT *, CASE WHEN want IS NULL THEN 'unknown event_type' WHEN stream = 'cellar'
      THEN 'unknown stream' WHEN want <> got THEN 'payload mismatch' END AS reason FROM v_env"""}


def good(v):
    ok, _ = V.validate_events(v.envelope)
    return ok.withColumn("run_id", F.concat(F.lit("run"), F.expr("substring(store_id, 6)")))


@query("validate_events_good", "SELECT seq, t, store_id, event_type FROM v_check WHERE reason IS NULL", CHECK)
def _(v):
    return V.validate_events(v.envelope)[0].select("seq", "t", "store_id", "event_type")


@query("validate_events_quarantine", """SELECT seq, event_type, stream, reason, array_to_string(list_sort(list_filter(want,
      lambda k: NOT list_contains(got, k))), ',') AS missing FROM v_check WHERE reason IS NOT NULL""", CHECK)
def _(v):
    q = V.validate_events(v.envelope)[1]
    miss = F.when(F.col("missing").isNotNull(), F.array_join("missing", ","))
    return q.select("seq", "event_type", "stream", "reason", miss.alias("missing"))


@query("route_tripwire", "SELECT run_id, t, 'in' AS dir FROM v_check WHERE reason IS NULL AND event_type = 'tripwire'", CHECK)
def _(v):
    return SK.route_events(good(v))["tripwire"]


@query("route_occupancy", """SELECT run_id, t, CAST(floor(value) AS BIGINT) % 60 AS count FROM v_check
    WHERE reason IS NULL AND event_type = 'occupancy'""", CHECK)
def _(v):
    return SK.route_events(good(v))["occupancy"]


@query("route_queue_estimate", """SELECT run_id, t, track_id % 4 + 1 AS lane, value / 50 AS count,
    value AS pred_wait_s FROM v_check WHERE reason IS NULL AND event_type = 'queue_estimate'""", CHECK)
def _(v):
    return SK.route_events(good(v))["queue_estimate"]


@query("route_stockout", """SELECT run_id, 'A' || (track_id % 6 + 1) AS roi, 'SA' || (track_id % 6 + 1) AS sku,
    t AS t_start, CAST(NULL AS DOUBLE) AS t_end FROM v_check WHERE reason IS NULL AND event_type = 'stockout_start'""", CHECK)
def _(v):
    return SK.route_events(good(v))["stockout"]


# --- the other event types ---------------------------------------------------
KINDS = ("visit", "heatmap", "shelf_fill", "planogram_violation", "lane_occ", "alert", "stockout_end", "pos_txn")


def other_envelope(v):
    """Every driver event as one of the types that `envelope` does not make or not make whole; some lanes are too long."""
    e, roi = v.ev, v._roi
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("event_id") % len(KINDS) + 1).cast("int"))
    i = F.col("event_id")
    size = F.when(i % 5 == 0, 17).otherwise(16)
    payload = {
        "visit": F.struct(F.col("track_id"), F.col("t").alias("t_enter"), (F.col("t") + i % 90).alias("t_exit")),
        "heatmap": F.struct(F.floor(F.col("t") / 86400).alias("t_bucket"), F.array(
            F.array(i % 4, i % 3, i % 50), F.array(i % 4 + 4, i % 3, i % 40)).alias("tiles")),
        "shelf_fill": F.struct((F.floor("value") % 256).alias("fill")),
        "planogram_violation": F.struct(F.concat(F.lit("S"), roi).alias("expected_sku"), F.lit("low").alias("observed")),
        "lane_occ": F.struct((F.col("track_id") % 2 + 1).alias("lane"), F.transform(
            F.sequence(F.lit(1), size), lambda k: (i + k * 31) % 300).alias("cells")),
        "alert": F.struct(F.lit("info").alias("severity"), F.lit("wait_over").alias("rule"),
                          F.concat(F.lit("user "), F.col("track_id").cast("string")).alias("message")),
        "stockout_end": F.struct(F.concat(F.lit("S"), roi).alias("sku"), roi.alias("facing")),
        "pos_txn": F.struct((F.col("track_id") % 4 + 1).alias("lane"), (i % 8 + 1).alias("items"),
                            F.col("value").alias("amount"), F.lit("aisle_a").alias("zone_hint")),
    }
    text = F.lit(None).cast("string")
    for name, body in payload.items():
        text = F.when(kind == name, F.to_json(body)).otherwise(text)
    return e.select("run_id", "t", "store_id", F.lit("overhead").alias("stream"), roi.alias("zone_id"),
                    kind.alias("event_type"), text.alias("payload"), i.alias("seq"))


def routed(v):
    ok, _ = V.validate_events(other_envelope(v))
    return SK.route_events(ok)


OTHER = """SELECT run_id, t, track_id, event_id AS i, value, 'A' || (track_id % 6 + 1) AS zone_id, event_id % 8 AS kind FROM v_ev"""


@query("route_visit", """SELECT run_id, track_id, zone_id AS zone, t AS t_enter, t + i % 90 AS t_exit, (t + i % 90) - t AS dwell_s
    FROM v_other WHERE kind = 0""", {"v_other": OTHER})
def _(v):
    return routed(v)["visit"]


@query("route_heatmap", """SELECT run_id, t_bucket, gx, gy, arg_max(count, (t, i)) AS count FROM (
    SELECT run_id, t, i, CAST(floor(t / 86400) AS BIGINT) AS t_bucket, unnest([i % 4, i % 4 + 4]) AS gx, i % 3 AS gy,
      unnest([i % 50, i % 40]) AS count FROM v_other WHERE kind = 1) GROUP BY ALL""", {"v_other": OTHER})
def _(v):
    return routed(v)["heatmap"]


@query("route_shelf_fill", """SELECT run_id, t, zone_id AS roi, CAST(CAST(floor(value) AS BIGINT) % 256 AS DOUBLE) AS fill
    FROM v_other WHERE kind = 2""", {"v_other": OTHER})
def _(v):
    return routed(v)["shelf_fill"]


@query("route_planogram_violation", """SELECT run_id, t, zone_id AS roi, 'S' || zone_id AS expected, 'low' AS observed
    FROM v_other WHERE kind = 3""", {"v_other": OTHER})
def _(v):
    return routed(v)["planogram_violation"]


@query("route_lane_occ", """SELECT run_id, t, track_id % 2 + 1 AS lane, array_to_string(list_transform(range(1, 17),
      lambda k: ((i + k * 31) % 300) & 255), ',') AS cells FROM v_other WHERE kind = 4 AND i % 5 <> 0""", {"v_other": OTHER})
def _(v):
    return routed(v)["lane_occ"].withColumn("cells", F.array_join("cells", ","))


@query("route_quarantine", """SELECT run_id, i AS seq, 'lane_occ' AS event_type, 'more than 16 cells' AS reason
    FROM v_other WHERE kind = 4 AND i % 5 = 0""", {"v_other": OTHER})
def _(v):
    return routed(v)["quarantine"].select("run_id", "seq", "event_type", "reason")


@query("route_alert", """SELECT run_id, t, 'info' AS severity, 'wait_over' AS rule, 'user ' || track_id AS message,
    CAST(0 AS BIGINT) AS acked FROM v_other WHERE kind = 5""", {"v_other": OTHER})
def _(v):
    return routed(v)["alert"]


@query("route_pos_txn", """SELECT run_id, t, track_id % 4 + 1 AS lane, i % 8 + 1 AS items, value AS amount,
    'aisle_a' AS zone_hint FROM v_other WHERE kind = 7""", {"v_other": OTHER})
def _(v):
    return routed(v)["pos_txn"]


@query("load_all_types", """SELECT 'visit' AS name, count(*) AS n FROM v_other WHERE kind = 0
    UNION ALL SELECT 'shelf_fill', count(*) FROM v_other WHERE kind = 2
    UNION ALL SELECT 'planogram_violation', count(*) FROM v_other WHERE kind = 3
    UNION ALL SELECT 'lane_occ', count(*) FROM v_other WHERE kind = 4 AND i % 5 <> 0
    UNION ALL SELECT 'quarantine', count(*) FROM v_other WHERE kind = 4 AND i % 5 = 0
    UNION ALL SELECT 'alert', count(*) FROM v_other WHERE kind = 5""", {"v_other": OTHER})
def _(v):
    """Everything in one pass, then again; counts of the tables that were left."""
    base = shared_dir(v.spark, "all-types")
    ok, _ = V.validate_events(other_envelope(v))
    for _ in range(2):
        SK.load_history(v.spark, ok, base)
    names = ("visit", "shelf_fill", "planogram_violation", "lane_occ", "quarantine", "alert")
    out = None
    for name in names:
        n = v.spark.read.parquet(f"{base}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("read_events", "SELECT t, store_id, stream, event_type, seq FROM v_env", ENV)
def _(v):
    """Envelopes written as JSON lines and read back."""
    path = shared_dir(v.spark, "events-json")
    # The order column rides in zone_id, which these events do not use.
    e = v.envelope.withColumn("zone_id", F.col("seq").cast("string"))
    e.select("t", "store_id", "stream", "zone_id", "event_type", "payload").write.json(path)
    r = RD.read_events(v.spark, path)
    return r.select("t", "store_id", "stream", "event_type", F.col("zone_id").cast("bigint").alias("seq"))


@query("read_pos_csv", """SELECT t, lane, items, amount, zone_hint FROM v_pos_txn""")
def _(v):
    path = shared_dir(v.spark, "pos-csv")
    v.pos_txn.select("t", "lane", "items", "amount", "zone_hint").write.option("header", True).csv(path)
    e = RD.read_pos_csv(v.spark, path, "store-0")
    p = F.from_json("payload", "lane bigint, items bigint, amount double, zone_hint string")
    return e.select("t", p.alias("p")).select("t", "p.*")


@query("frame_detections", """SELECT frame_id, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY x, y, w, h) - 1 AS INTEGER)
      AS k, x, y, w, h, w * h AS area FROM (SELECT DISTINCT frame_id, x, y, w, h FROM v_box)
    QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY x, y, w, h) <= 64""")
def _(v):
    """Boxes packed to frame records (64 slots) and unpacked again."""
    from pyspark.sql import Window
    ints = [F.col(c).cast("int").alias(c) for c in ("x", "y", "w", "h")]
    b = v.box.select("frame_id", *ints).distinct()
    w = Window.partitionBy("frame_id").orderBy("x", "y", "w", "h")
    b = b.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 64)
    blob = F.struct("x", "y", "w", "h", (F.col("w") * F.col("h")).cast("bigint").alias("area"))
    f = b.groupBy("frame_id").agg(F.array_sort(F.collect_list(blob)).alias("blobs"))
    f = f.withColumn("num_blobs", F.size("blobs"))
    return RD.detections(f).select("frame_id", "k", "x", "y", "w", "h", "area")


@query("pack_cells", """SELECT seq, true AS cells_ok, array_to_string(list_concat(list_transform(cells, lambda c: (c * 5) & 255),
    CAST([] AS BIGINT[])), ',') AS cells FROM v_lane_occ""")
def _(v):
    short = v.lane_occ.withColumn("cells", F.transform("cells", lambda c: c * 5))
    return V.pack_cells(short).select("seq", "cells_ok", F.array_join("cells", ",").alias("cells"))


@query("event_time", """SELECT frame_id, 1000.0::DOUBLE + (frame_id * 66666667 - min(frame_id * 66666667) OVER ()) / 1e9 AS t
    FROM (SELECT DISTINCT frame_id FROM v_box)""")
def _(v):
    f = v.box.select("run_id", "stream", "frame_id").distinct().withColumn("t_ns", F.col("frame_id") * 66666667)
    return V.event_time(f, 1000.0).select("frame_id", "t")


def dimension_tables(v):
    """Dimension lists built from the part table, with the faults it implies."""
    p = v.table("part")
    store = F.concat(F.lit("store-"), (F.col("p_partkey") % 3).cast("string")).alias("store_id")
    key = F.concat(F.lit("R"), F.floor(F.col("p_partkey") / 2).cast("string"))
    stream = F.when(F.col("p_partkey") % 17 == 0, "attic").otherwise("shelf").alias("stream")
    box = [(F.col("p_partkey") % 300).cast("int").alias("x"), (F.col("p_partkey") % 220).cast("int").alias("y"),
           F.col("p_size").alias("w"), F.col("p_size").alias("h")]
    rois = p.select(store, key.alias("id"), stream, *box, (F.col("p_size") * 2).alias("empty_below"),
                    (F.col("p_size") + 30).alias("low_below"))
    lanes = p.select(store, key.alias("id"), (F.col("p_partkey") % 4).cast("int").alias("lane"),
                     F.lit(0).alias("cell"), *box)
    corner = F.array(F.col("p_size").cast("double"), F.lit(0.0))
    zones = p.select(store, key.alias("id"), F.array_repeat(corner, F.col("p_size") % 6).alias("polygon"))
    point = F.array(F.lit(0.0), F.col("p_size").cast("double"))
    wires = p.select(store, key.alias("id"), stream, point.alias("p1"), point.alias("p2"),
                     F.when(F.col("p_size") > 45, "sideways").otherwise("up").alias("in_dir"))
    plan = p.select(store, F.concat(F.lit("R"), F.col("p_partkey").cast("string")).alias("facing"),
                    F.col("p_partkey").cast("string").alias("sku"), F.col("p_name").alias("name"),
                    F.col("p_retailprice").alias("unit_price"),
                    F.col("p_size").cast("double").alias("expected_sales_per_hour"))
    return {"rois": rois, "lanes": lanes, "zones": zones, "tripwires": wires, "planogram": plan}


DIM = {"v_dim": """SELECT 'store-' || (p_partkey % 3) AS store_id, 'R' || (p_partkey // 2) AS id,
    CASE WHEN p_partkey % 17 = 0 THEN 'attic' ELSE 'shelf' END AS stream, p_partkey % 300 AS x, p_partkey % 220 AS y,
    p_size AS s, 'R' || p_partkey AS facing FROM part"""}


@query("validate_dimensions", """WITH dup AS (SELECT store_id, id FROM v_dim GROUP BY ALL HAVING count(*) > 1),
    big AS (SELECT store_id, count(*) AS n FROM v_dim GROUP BY ALL)
    SELECT store_id, t AS "table", id AS entry, 'duplicate id' AS problem FROM dup,
      unnest(['rois', 'lanes', 'zones', 'tripwires']) u(t)
    UNION ALL SELECT store_id, t, id, 'box outside the frame' FROM v_dim, unnest(['rois', 'lanes']) u(t)
      WHERE s <= 0 OR x + s > 320 OR y + s > 240
    UNION ALL SELECT store_id, 'rois', CAST(n AS VARCHAR), 'more than 64 entries' FROM big WHERE n > 64
    UNION ALL SELECT store_id, 'lanes', CAST(n AS VARCHAR), 'more than 16 entries' FROM big WHERE n > 16
    UNION ALL SELECT store_id, t, id, 'unknown stream' FROM v_dim, unnest(['rois', 'tripwires']) u(t) WHERE stream = 'attic'
    UNION ALL SELECT store_id, 'rois', id, 'bad fill thresholds' FROM v_dim
      WHERE NOT (s * 2 >= 0 AND s * 2 < s + 30 AND s + 30 <= 255)
    UNION ALL SELECT store_id, 'zones', id, 'polygon needs 3 points' FROM v_dim WHERE s % 6 < 3
    UNION ALL SELECT store_id, 'tripwires', id, 'bad in_dir' FROM v_dim WHERE s > 45
    UNION ALL SELECT store_id, 'planogram', facing, 'facing has no roi' FROM v_dim d WHERE NOT EXISTS (
      SELECT 1 FROM v_dim r WHERE r.store_id = d.store_id AND r.id = d.facing)""", DIM)
def _(v):
    return V.validate_dimensions(dimension_tables(v))


@query("orphan_facings", """SELECT store_id, facing FROM v_dim d WHERE NOT EXISTS (
    SELECT 1 FROM v_dim r WHERE r.store_id = d.store_id AND r.id = d.facing)""", DIM)
def _(v):
    d = dimension_tables(v)
    return V.orphan_facings(d["planogram"], d["rois"]).select("store_id", "facing")


# --- runs and maintenance ----------------------------------------------------
@query("list_runs", "SELECT * FROM v_run")
def _(v):
    return SK.list_runs(v.run)


@query("latest_run", "SELECT arg_max(run_id, started) AS run_id FROM v_run")
def _(v):
    return SK.latest_run(v.run)


@query("delete_run", "SELECT run_id, t, dir FROM v_tripwire WHERE run_id <> 'run-1'")
def _(v):
    """Write the door table by run, drop one run's partition, read the rest."""
    base = shared_dir(v.spark, "tables")
    SK.write_tables({"tripwire": v.tripwire.select("run_id", "t", "dir")}, base)
    SK.delete_run(v.spark, base, "run-1")
    return SK.read_table(v.spark, base, "tripwire").select("run_id", "t", "dir")


@query("without_run", "SELECT run_id, t, dir FROM v_tripwire WHERE run_id <> 'run-1'")
def _(v):
    return SK.without_run(v.tripwire.select("run_id", "t", "dir"), "run-1")


@query("load_history", """SELECT run_id, t, CAST(floor(value) AS BIGINT) % 60 AS count FROM v_check
    WHERE reason IS NULL AND event_type = 'occupancy'""", CHECK)
def _(v):
    base = shared_dir(v.spark, "history")
    for _ in range(2):                     # a repeated load leaves the same rows
        SK.load_history(v.spark, good(v), base)
    return SK.read_table(v.spark, base, "occupancy").select("run_id", "t", "count")


@query("upsert_heatmap", """SELECT run_id, t_bucket, gx, gy, arg_max(count, seq) AS count FROM (
    SELECT run_id, CAST(floor(t / 60) AS BIGINT) // 1440 AS t_bucket, seq, seq % 8 AS gx, seq % 6 AS gy,
      seq % 100 AS count FROM v_point) GROUP BY ALL""")
def _(v):
    rows = v.point.select("run_id", "t", "seq", F.floor(TB.minute_index(F.col("t")) / 1440).alias("t_bucket"),
                          (F.col("seq") % 8).alias("gx"), (F.col("seq") % 6).alias("gy"),
                          (F.col("seq") % 100).alias("count"))
    return SK.upsert_heatmap(rows)


@query("retention", f"SELECT run_id, t, roi, fill FROM v_shelf_fill WHERE t >= {NOW} - 604800")
def _(v):
    return M.retention(v.shelf_fill.select("run_id", "t", "roi", "fill"), NOW)


OLD = f"t >= {NOW} - 604800 AND t < {NOW} - 3600"


@query("rollup_fills", f"""SELECT run_id, CAST(floor(t / 60) * 60 AS DOUBLE) AS t, roi, avg(fill) AS fill
    FROM v_shelf_fill WHERE {OLD} GROUP BY ALL
    UNION ALL SELECT run_id, t, roi, fill FROM v_shelf_fill WHERE NOT ({OLD})""")
def _(v):
    return M.rollup_fills(v.shelf_fill, NOW)


@query("rollup_lanes", f"""SELECT run_id, t, lane, array_to_string(cells, ',') AS cells FROM (
    SELECT run_id, t, lane, list_transform(list_zip(s, [n]), lambda z: 0) AS z,
      list_transform(s, lambda x: x // n) AS cells FROM (
      SELECT run_id, CAST(floor(t / 60) * 60 AS DOUBLE) AS t, lane, count(*) AS n,
        [{', '.join(f'CAST(sum(cells[{i}]) AS BIGINT)' for i in range(1, 17))}] AS s
      FROM v_lane_occ WHERE {OLD} GROUP BY ALL))
    UNION ALL SELECT run_id, t, lane, array_to_string(cells, ',') FROM v_lane_occ WHERE NOT ({OLD})""")
def _(v):
    r = M.rollup_lanes(v.lane_occ, NOW)
    return r.select("run_id", "t", "lane", F.array_join("cells", ",").alias("cells"))


CURSOR = 1705276800


@query("sync_increment", f"SELECT * FROM v_kpi WHERE t_bucket > {CURSOR}", {"v_kpi": KPI_SQL})
def _(v):
    return M.sync_increment(K.kpi_15m(v.tripwire, v.occupancy, v.pos_txn, v.queue_estimate), CURSOR)


@query("sync_cursor", f"SELECT coalesce(max(t_bucket), {CURSOR}) AS last_bucket FROM v_kpi WHERE t_bucket > {CURSOR}",
       {"v_kpi": KPI_SQL})
def _(v):
    return M.next_cursor(K.kpi_15m(v.tripwire, v.occupancy, v.pos_txn, v.queue_estimate), CURSOR)


@query("write_report", "SELECT run_id, entries, exits FROM (SELECT run_id, count(*) FILTER (dir = 'in') AS entries, "
       "count(*) FILTER (dir = 'out') AS exits FROM v_tripwire GROUP BY ALL)")
def _(v):
    folder = shared_dir(v.spark, "report")
    totals = K.footfall_totals(v.run, v.tripwire).select("run_id", "entries", "exits")
    SK.write_report({"entries_exits": totals}, None, folder)
    return v.spark.read.schema("run_id string, entries bigint, exits bigint").option(
        "header", True).csv(f"{folder}/entries_exits")


# --- scalar functions over whole tables --------------------------------------
@query("time_buckets", """SELECT seq, CAST(floor(t / 60) AS BIGINT) AS minute, CAST(floor(t / 60) * 60 AS BIGINT) AS minute_start,
    CAST(floor(t / 900) * 900 AS BIGINT) AS quarter, CAST(floor(t / 86400) AS BIGINT) AS day,
    CAST(floor((t + 19800) / 86400) * 86400 - 19800 AS DOUBLE) AS midnight, seq // 150 AS frame_bucket FROM v_shelf_fill""")
def _(v):
    t = F.col("t")
    return v.shelf_fill.select(
        "seq", TB.minute_index(t).alias("minute"), TB.minute_start(t).alias("minute_start"),
        TB.quarter_start(t).alias("quarter"), TB.utc_day(t).alias("day"),
        TB.local_midnight(t, "Asia/Kolkata").alias("midnight"),
        TB.frame_bucket(F.col("seq"), 15.0, 10.0).alias("frame_bucket"))


@query("cell_counts", """SELECT seq, len(list_filter(cells, lambda c: c > 40)) * 0.8::DOUBLE AS naive,
    greatest(0.0::DOUBLE, list_sum(cells) * 0.01::DOUBLE - 5) AS fitted FROM v_lane_occ""")
def _(v):
    return v.lane_occ.select("seq", Q.naive_count(F.col("cells")).alias("naive"),
                             Q.predict_count(F.col("cells"), 0.01, -5.0).alias("fitted"))


ERLANG = {"v_er": """SELECT *, CASE WHEN rho >= c THEN 1.0::DOUBLE ELSE tail / (base + tail) END AS p FROM (
    SELECT *, list_sum(list_transform(range(c), lambda k: pow(rho, k) / factorial(CAST(k AS INTEGER)))) AS base,
      pow(rho, c) / factorial(CAST(c AS INTEGER)) / CASE WHEN rho = c THEN NULL ELSE 1 - rho / c END AS tail FROM (
      SELECT p_partkey, p_size / 5.0::DOUBLE AS rho, p_partkey % 16 + 1 AS c, 1 / 45.0::DOUBLE AS mu FROM part))"""}


def servers(v):
    return v.table("part").select("p_partkey", (F.col("p_size") / 5.0).alias("rho"),
                                  (F.col("p_partkey") % 16 + 1).alias("c"), F.lit(1 / 45.0).alias("mu"))


@query("erlang", """SELECT p_partkey, round(p, 9) AS p_wait,
    CASE WHEN rho >= c THEN NULL ELSE round(p / (c * mu - rho * mu), 6) END AS wait_s,
    rho >= c AS saturated FROM v_er""", ERLANG)
def _(v):
    s = servers(v)
    wait = Q.erlang_wait(F.col("rho"), F.col("c"), F.col("mu"))
    return s.select("p_partkey", F.round(Q.erlang_c(F.col("rho"), F.col("c")), 9).alias("p_wait"),
                    F.when(F.col("rho") < F.col("c"), F.round(wait, 6)).alias("wait_s"),
                    (wait == float("inf")).alias("saturated"))


@query("forecast_wait", """SELECT p_partkey, CASE WHEN rho >= c THEN NULL
    ELSE round(greatest(p / (c * mu - rho * mu), 30.0), 6) END AS wait_s FROM v_er""", ERLANG)
def _(v):
    s = servers(v)
    wait = Q.forecast_wait(F.col("rho"), F.col("c"), F.col("mu"), F.lit(30.0))
    return s.select("p_partkey", F.when(wait < float("inf"), F.round(wait, 6)).alias("wait_s"))


@query("required_servers", """SELECT p_partkey, CAST(coalesce(min(c), 16) AS INTEGER) AS need FROM (
    SELECT p.p_partkey, x.c FROM (SELECT p_partkey, p_size / 5.0::DOUBLE AS rho FROM part) p
    LEFT JOIN (SELECT DISTINCT rho, c, wq FROM (SELECT rho, c, tail / (list_sum(list_transform(range(c),
        lambda k: pow(rho, k) / factorial(CAST(k AS INTEGER)))) + tail) / (c / 45 - rho / 45) AS wq FROM (
        SELECT rho, c, pow(rho, c) / factorial(CAST(c AS INTEGER)) / (1 - rho / c) AS tail FROM (
          SELECT DISTINCT p_size / 5.0::DOUBLE AS rho FROM part), (SELECT range AS c FROM range(1, 17)) WHERE rho < c))) x
      ON x.rho = p.rho AND x.wq <= 20) GROUP BY p_partkey""")
def _(v):
    s = servers(v)
    return s.select("p_partkey", Q.required_servers(F.col("rho") * F.col("mu"), F.col("mu"), F.lit(20.0)).alias("need"))


@query("shelf_state", """SELECT seq, CASE WHEN fill * 2 < 60 THEN 'empty' WHEN fill * 2 < 110 THEN 'low'
    WHEN fill * 2 < 180 THEN 'partial' ELSE 'full' END AS state FROM v_shelf_fill""")
def _(v):
    return v.shelf_fill.select("seq", L.shelf_state(F.col("fill") * 2).alias("state"))


@query("display_text", """SELECT seq, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm'
      ELSE (s // 60) || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' END AS duration,
    CAST(floor(x / 60) AS BIGINT) || ':' || lpad(CAST(CAST(floor(x - floor(x / 60) * 60 + 0.5) AS BIGINT) AS VARCHAR), 2, '0') AS wait,
    round(least(100.0, s * 100.0::DOUBLE / 7200), 1) AS pct
    FROM (SELECT seq, CAST(floor(pred_wait_s * 100 + 0.5) AS BIGINT) AS s, floor(pred_wait_s * 100) AS x FROM v_queue_estimate)""")
def _(v):
    x = F.col("pred_wait_s") * 100
    whole = F.floor(x + 0.5)
    return v.queue_estimate.select(
        "seq", L.format_duration(x).alias("duration"), L.format_wait(F.floor(x).cast("double")).alias("wait"),
        L.pct_capped(whole, F.lit(7200)).alias("pct"))


@query("engagement_label", """SELECT run_id, track_id, t_enter, CASE WHEN dwell_s >= 120 AND track_id % 2 = 0 THEN 'confused'
    WHEN track_id % 2 = 1 THEN 'engaged' ELSE 'ignored' END AS label FROM v_visit""")
def _(v):
    return v.visit.select("run_id", "track_id", "t_enter",
                          L.engagement_label(F.col("dwell_s"), F.col("track_id") % 2 == 1).alias("label"))


# --- dashboard ---------------------------------------------------------------
def tables(v):
    return {"run": v.run, "occupancy": v.occupancy, "tripwire": v.tripwire, "shelf_fill": v.shelf_fill,
            "visit": v.visit, "queue_estimate": v.queue_estimate, "pos_txn": v.pos_txn,
            "stockout": v.stockout, "planogram": v.planogram, "alert": v.alert}
