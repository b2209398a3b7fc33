"""The driver's tables seen as store-event tables, for Spark and for the oracle.

Each view is defined twice with the same expressions: as a DataFrame here and as
DuckDB text in `VIEW_SQL`. Nothing is filtered away or sampled.
"""
from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislemetry.functions.timebuckets import epoch_seconds
from aislemetry.operators import sequence

# Floor is 8 m x 6 m at 80 px per metre with v pointing down.
HOMOGRAPHY = ((1 / 80, 0.0, 0.0), (0.0, -1 / 80, 6.0), (0.0, 0.0, 1.0))
ZONES = (
    ("entrance", ((0.0, 0.0), (3.0, 0.0), (3.0, 2.0), (0.0, 2.0))),
    ("aisle_a", ((0.0, 2.0), (3.5, 2.0), (3.5, 4.5), (0.0, 4.5))),
    ("aisle_b", ((3.5, 2.0), (8.0, 2.0), (8.0, 4.5), (3.5, 4.5))),
    ("checkout", ((3.0, 0.0), (8.0, 0.0), (8.0, 2.0), (3.0, 2.0))),
)
WIRES = (("door", "overhead", (40.0, 240.0), (600.0, 240.0), "up"),
         ("side", "overhead", (320.0, 40.0), (320.0, 440.0), "left"))
EMPTY_BELOW, LOW_BELOW = 40, 70
VISIT_DEBOUNCE, VISIT_MIN = 21600.0, 43200.0


def frame_run(frame):
    """A run of frames: the driver's frame numbers all lie in the first billion."""
    return F.concat(F.lit("run-"), F.floor(F.col(frame) / 1000000000).cast("string"))


class Views:
    """Lazy DataFrames over one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def ev(self):
        e = self.table("events")
        t = epoch_seconds("ts").alias("t")
        e = e.select("event_id", t, F.col("user_id").alias("track_id"), "event_type", "value")
        key = (F.col("track_id") % 3).cast("string")
        z = (F.col("track_id") + F.floor(F.col("t") / 172800)
             + F.when(F.col("event_id") % 5 == 0, 1).otherwise(0)) % 5
        return e.select("event_id", "t", "track_id", "event_type", "value",
                        F.concat(F.lit("run-"), key).alias("run_id"),
                        F.concat(F.lit("store-"), key).alias("store_id"),
                        z.cast("bigint").alias("z"))

    def of_type(self, *types):
        return self.ev.where(F.col("event_type").isin(*types))

    @cached_property
    def observation(self):
        zone = F.try_element_at(F.array(*map(F.lit, ("entrance", "aisle_a", "aisle_b",
                                                     "checkout"))), (F.col("z") + 1).cast("int"))
        return self.ev.select("run_id", "track_id", "t", F.col("event_id").alias("seq"),
                              zone.alias("zone"))

    @cached_property
    def visit(self):
        return sequence.visits(self.observation, VISIT_DEBOUNCE, VISIT_MIN)

    @cached_property
    def tripwire(self):
        return self.of_type("view", "click").select(
            "run_id", "store_id", "t", F.col("event_id").alias("seq"),
            F.when(F.col("event_type") == "view", "in").otherwise("out").alias("dir"))

    @cached_property
    def occupancy(self):
        return self.of_type("signup").select(
            "run_id", "store_id", "t", F.col("event_id").alias("seq"),
            (F.floor("value") % 60).cast("bigint").alias("count"))

    @property
    def _roi(self):
        return F.concat(F.lit("A"), (F.col("track_id") % 6 + 1).cast("string"))

    @cached_property
    def shelf_fill(self):
        return self.ev.select("run_id", "store_id", "t", F.col("event_id").alias("seq"),
                              self._roi.alias("roi"),
                              (F.floor("value") % 256).cast("double").alias("fill"))

    @cached_property
    def stockout_event(self):
        return self.of_type("error", "signup").select(
            "run_id", "store_id", "t", F.col("event_id").alias("seq"), self._roi.alias("roi"),
            F.concat(F.lit("S"), self._roi).alias("sku"),
            F.when(F.col("event_type") == "error", "start").otherwise("end").alias("kind"))

    @cached_property
    def stockout(self):
        t = epoch_seconds("l_shipdate")
        return self.table("lineitem").select(
            F.concat(F.lit("run-"), (F.col("l_suppkey") % 3).cast("string")).alias("run_id"),
            F.concat(F.lit("F"), (F.col("l_partkey") % 64).cast("string")).alias("roi"),
            F.col("l_partkey").alias("sku"), t.alias("t_start"),
            F.when(F.col("l_returnflag") != "R", t + F.col("l_quantity") * 3600).alias("t_end"))

    @cached_property
    def planogram(self):
        return self.table("part").select(
            F.col("p_partkey").alias("position"), F.col("p_partkey").alias("sku"),
            F.concat(F.lit("F"), (F.col("p_partkey") % 64).cast("string")).alias("facing"),
            F.col("p_name").alias("name"), F.col("p_retailprice").alias("unit_price"),
            F.col("p_size").cast("double").alias("expected_sales_per_hour"))

    @property
    def _lane(self):
        return (F.col("track_id") % 4 + 1).cast("bigint").alias("lane")

    @cached_property
    def queue_estimate(self):
        return self.of_type("click").select(
            "run_id", "store_id", "t", F.col("event_id").alias("seq"), self._lane,
            (F.col("value") / 50).alias("count"), F.col("value").alias("pred_wait_s"))

    @cached_property
    def queue_truth(self):
        return self.of_type("purchase").select(
            F.col("run_id").alias("clip"), "t", F.col("event_id").alias("seq"), self._lane,
            F.floor(F.col("value") / 50).cast("bigint").alias("count"),
            F.col("value").alias("actual_wait_s"))

    @cached_property
    def lane_occ(self):
        cells = F.transform(F.sequence(F.lit(0), F.lit(15)),
                            lambda i: (F.col("event_id") * 7 + i * 13) % 100)
        return self.ev.select("run_id", "store_id", "t", F.col("event_id").alias("seq"),
                              (F.col("track_id") % 2 + 1).cast("bigint").alias("lane"),
                              cells.cast("array<bigint>").alias("cells"))

    @cached_property
    def pos_txn(self):
        zone = F.try_element_at(F.array(*map(F.lit, ("entrance", "aisle_a", "aisle_b",
                                                     "checkout"))), (F.col("z") + 1).cast("int"))
        return self.of_type("purchase").select(
            "run_id", "store_id", "t", F.col("event_id").alias("seq"), self._lane,
            (F.col("event_id") % 8 + 1).cast("bigint").alias("items"),
            F.col("value").alias("amount"), zone.alias("zone_hint"))

    @cached_property
    def point(self):
        camera = F.when(F.col("track_id") >= 0, "overhead").otherwise("shelf")
        return self.ev.select(
            "run_id", camera.alias("stream"), "track_id", "t",
            F.col("event_id").alias("seq"),
            (F.col("event_id") * 37 % 640).cast("double").alias("u"),
            (F.col("event_id") * 53 % 480).cast("double").alias("v"))

    @cached_property
    def alert(self):
        rule = F.element_at(F.array(*map(F.lit, ("stockout", "wait_over", "occupancy_over"))),
                            (F.col("event_id") % 3 + 1).cast("int"))
        severity = F.element_at(F.array(*map(F.lit, ("warning", "warning", "info"))),
                                (F.col("event_id") % 3 + 1).cast("int"))
        return self.of_type("error").select(
            "run_id", "t", F.col("event_id").alias("seq"), severity.alias("severity"),
            rule.alias("rule"), F.concat(F.lit("user "), F.col("track_id").cast("string"))
            .alias("message"), (F.floor("value") % 2).cast("bigint").alias("acked"))

    @cached_property
    def run(self):
        return self.ev.groupBy("run_id", "store_id").agg(F.min("t").alias("started")).select(
            "run_id", "store_id", "started", F.lit("driver").alias("clipset"))

    @cached_property
    def box(self):
        """Raw boxes, about four per frame, before the per-frame slot limit."""
        return self.table("lineitem").select(
            frame_run("l_orderkey").alias("run_id"), F.lit("overhead").alias("stream"),
            F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("line"),
            (F.col("l_partkey") % 600).cast("double").alias("x"),
            (F.col("l_suppkey") % 440).cast("double").alias("y"),
            (F.col("l_quantity") + 20).alias("w"), (F.col("l_quantity") * 2 + 40).alias("h"),
            F.lit(0).alias("flags"))

    @cached_property
    def box_b(self):
        """The second detector: shifted on odd lines, the smallest boxes out of the picture."""
        off = F.when(F.col("w") < 23, 1000.0).when(F.col("line") % 2 == 1, 4.0).otherwise(0.0)
        return self.box.withColumn("x", F.col("x") + off)

    @cached_property
    def envelope(self):
        """Every driver event as one envelope row with a JSON payload."""
        e, et = self.ev, F.col("event_type")
        roi, lane = self._roi, F.col("track_id") % 4 + 1
        payload = (
            F.when(et == "view", F.to_json(F.struct(F.lit("in").alias("dir"),
                                                    F.lit("door").alias("tripwire_id"))))
            .when(et == "click", F.to_json(F.struct(
                lane.alias("lane"), (F.col("value") / 50).alias("count"),
                F.col("value").alias("pred_wait_s"))))
            .when(et == "signup", F.to_json(F.struct(
                (F.floor("value") % 60).cast("bigint").alias("count"))))
            .when(et == "purchase", F.to_json(F.struct(
                lane.alias("lane"), (F.col("event_id") % 8 + 1).alias("items"),
                F.col("value").alias("amount"))))
            .otherwise(F.to_json(F.struct(F.concat(F.lit("S"), roi).alias("sku"),
                                          roi.alias("facing")))))
        kind = (F.when(et == "view", "tripwire").when(et == "click", "queue_estimate")
                .when(et == "signup", "occupancy").when(et == "purchase", "pos_txn")
                .when(F.col("event_id") % 7 == 0, "mystery").otherwise("stockout_start"))
        return e.select("t", "store_id", F.when(F.col("event_id") % 11 == 0, "cellar")
                        .otherwise("overhead").alias("stream"),
                        F.when(et == "error", roi).alias("zone_id"), kind.alias("event_type"),
                        payload.alias("payload"), F.col("event_id").alias("seq"))


VIEW_SQL = {
    "v_ev": """SELECT event_id, epoch_us(ts)/1e6 AS t, user_id AS track_id, event_type, value,
        'run-' || (user_id % 3) AS run_id, 'store-' || (user_id % 3) AS store_id,
        (user_id + CAST(floor(epoch_us(ts)/1e6/172800) AS BIGINT)
          + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) % 5 AS z FROM events""",
    "v_obs": """SELECT run_id, track_id, t, event_id AS seq, CASE z WHEN 0 THEN 'entrance'
        WHEN 1 THEN 'aisle_a' WHEN 2 THEN 'aisle_b' WHEN 3 THEN 'checkout' END AS zone FROM v_ev""",
    "v_isl": """SELECT run_id, track_id, zone, g, min(t) AS a, max(t) AS b FROM (
        SELECT *, sum(CASE WHEN rn = 1 OR zone IS DISTINCT FROM pz THEN 1 ELSE 0 END)
            OVER (PARTITION BY run_id, track_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS g FROM (
          SELECT *, lag(zone) OVER w AS pz, row_number() OVER w AS rn FROM v_obs
          WINDOW w AS (PARTITION BY run_id, track_id ORDER BY t, seq)))
        GROUP BY run_id, track_id, zone, g""",
    "v_visit": """SELECT run_id, track_id, zone, t_enter, t_exit, t_exit - t_enter AS dwell_s FROM (
        SELECT s.run_id, s.track_id, s.zone, s.a AS t_enter,
          coalesce(lead(s.a) OVER (PARTITION BY s.run_id, s.track_id ORDER BY s.a), e.last_t) AS t_exit
        FROM (SELECT * FROM (SELECT *, lag(zone) OVER w AS pz, row_number() OVER w AS rn FROM v_isl
                WHERE b - a >= 21600 WINDOW w AS (PARTITION BY run_id, track_id ORDER BY a))
              WHERE rn = 1 OR zone IS DISTINCT FROM pz) s
        JOIN (SELECT run_id, track_id, max(t) AS last_t FROM v_obs GROUP BY ALL) e
          ON s.run_id = e.run_id AND s.track_id = e.track_id)
        WHERE zone IS NOT NULL AND t_exit - t_enter >= 43200""",
    "v_tripwire": """SELECT run_id, store_id, t, event_id AS seq,
        CASE WHEN event_type = 'view' THEN 'in' ELSE 'out' END AS dir FROM v_ev
        WHERE event_type IN ('view', 'click')""",
    "v_occupancy": """SELECT run_id, store_id, t, event_id AS seq,
        CAST(floor(value) AS BIGINT) % 60 AS count FROM v_ev WHERE event_type = 'signup'""",
    "v_shelf_fill": """SELECT run_id, store_id, t, event_id AS seq, 'A' || (track_id % 6 + 1) AS roi,
        CAST(CAST(floor(value) AS BIGINT) % 256 AS DOUBLE) AS fill FROM v_ev""",
    "v_stockout_event": """SELECT run_id, store_id, t, event_id AS seq,
        'A' || (track_id % 6 + 1) AS roi, 'SA' || (track_id % 6 + 1) AS sku,
        CASE WHEN event_type = 'error' THEN 'start' ELSE 'end' END AS kind FROM v_ev
        WHERE event_type IN ('error', 'signup')""",
    "v_stockout": """SELECT 'run-' || (l_suppkey % 3) AS run_id, 'F' || (l_partkey % 64) AS roi,
        l_partkey AS sku, epoch_us(l_shipdate)/1e6 AS t_start,
        CASE WHEN l_returnflag <> 'R' THEN epoch_us(l_shipdate)/1e6 + l_quantity * 3600 END AS t_end
        FROM lineitem""",
    "v_planogram": """SELECT p_partkey AS sku, 'F' || (p_partkey % 64) AS facing, p_name AS name,
        p_retailprice AS unit_price, CAST(p_size AS DOUBLE) AS expected_sales_per_hour,
        CAST(p_size AS DOUBLE) * p_retailprice AS rate FROM part""",
    "v_queue_estimate": """SELECT run_id, store_id, t, event_id AS seq, track_id % 4 + 1 AS lane,
        value / 50 AS count, value AS pred_wait_s FROM v_ev WHERE event_type = 'click'""",
    "v_queue_truth": """SELECT run_id AS clip, t, event_id AS seq, track_id % 4 + 1 AS lane,
        CAST(floor(value / 50) AS BIGINT) AS count, value AS actual_wait_s
        FROM v_ev WHERE event_type = 'purchase'""",
    "v_lane_occ": """SELECT run_id, store_id, t, event_id AS seq, track_id % 2 + 1 AS lane,
        list_transform(range(16), lambda i: (event_id * 7 + i * 13) % 100) AS cells FROM v_ev""",
    "v_pos_txn": """SELECT run_id, store_id, t, event_id AS seq, track_id % 4 + 1 AS lane,
        event_id % 8 + 1 AS items, value AS amount, CASE z WHEN 0 THEN 'entrance'
        WHEN 1 THEN 'aisle_a' WHEN 2 THEN 'aisle_b' WHEN 3 THEN 'checkout' END AS zone_hint
        FROM v_ev WHERE event_type = 'purchase'""",
    "v_point": """SELECT run_id, track_id, t, event_id AS seq,
        CAST(event_id * 37 % 640 AS DOUBLE) AS u, CAST(event_id * 53 % 480 AS DOUBLE) AS v,
        CAST(event_id * 37 % 640 AS DOUBLE) / 80 AS fx,
        6 - CAST(event_id * 53 % 480 AS DOUBLE) / 80 AS fy FROM v_ev""",
    "v_alert": """SELECT run_id, t, event_id AS seq,
        CASE event_id % 3 WHEN 2 THEN 'info' ELSE 'warning' END AS severity,
        CASE event_id % 3 WHEN 0 THEN 'stockout' WHEN 1 THEN 'wait_over' ELSE 'occupancy_over' END AS rule,
        'user ' || track_id AS message, CAST(floor(value) AS BIGINT) % 2 AS acked
        FROM v_ev WHERE event_type = 'error'""",
    "v_run": """SELECT run_id, store_id, min(t) AS started, 'driver' AS clipset FROM v_ev
        GROUP BY run_id, store_id""",
    "v_box": """SELECT l_orderkey AS frame_id, l_linenumber AS line,
        CAST(l_partkey % 600 AS DOUBLE) AS x, CAST(l_suppkey % 440 AS DOUBLE) AS y,
        l_quantity + 20 AS w, l_quantity * 2 + 40 AS h FROM lineitem""",
    "v_window": """SELECT run_id, min(t) AS t0, max(t) AS t1 FROM (
        SELECT run_id, t FROM v_occupancy UNION ALL SELECT run_id, t FROM v_tripwire
        UNION ALL SELECT run_id, t FROM v_shelf_fill UNION ALL SELECT run_id, t_exit FROM v_visit)
        GROUP BY run_id""",
    "v_heatmap": """SELECT run_id, t_bucket, gx, gy, CAST(sum(n) OVER (PARTITION BY run_id, gx, gy
        ORDER BY t_bucket ROWS UNBOUNDED PRECEDING) AS BIGINT) AS count FROM (
        SELECT run_id, CAST(floor(t / 60) AS BIGINT) AS t_bucket, CAST(floor(fx / 0.25) AS BIGINT) AS gx,
          CAST(floor(fy / 0.25) AS BIGINT) AS gy, count(*) AS n FROM v_point GROUP BY ALL)""",
}


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix `sql` with the views it needs, in dependency order."""
    views = {**VIEW_SQL, **(extra or {})}
    ordered: list[str] = []

    def visit(text):
        for name in re.findall(r"\bv_\w+\b", text):
            if name in views and name not in ordered:
                visit(views[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    head = ", ".join(f"{n} AS ({views[n]})" for n in ordered)
    body = sql.strip()
    if not head:
        return body
    if re.match(r"(?i)with\s+recursive\b", body):
        return f"WITH RECURSIVE {head}, {body[len('WITH RECURSIVE'):].strip()}"
    if re.match(r"(?i)with\b", body):
        return f"WITH {head}, {body[4:].strip()}"
    return f"WITH {head} {body}"
