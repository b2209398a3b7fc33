"""Queries of the scoring jobs; labels are derived from the driver's own rows."""
from __future__ import annotations

from pyspark.sql import functions as F

from aislemetry.plans import scoring as SC
from aislemetry.plans.registry import query

TOL = 3600.0

GT = {
    "v_gt_entry": """SELECT run_id AS clip, t, CASE event_type WHEN 'click' THEN 'out' ELSE 'in' END AS dir
        FROM v_ev WHERE event_type IN ('view', 'click', 'signup')""",
    "v_gt_occ": """SELECT run_id AS clip, t, CAST(floor(value) AS BIGINT) % 60 AS count FROM v_ev
        WHERE event_type = 'purchase'""",
    "v_gt_visit": """SELECT run_id AS clip, track_id * 100000000000 + CAST(floor(t_enter) AS BIGINT) AS label_id, zone,
        t_enter + 7200 AS t_enter, t_exit - 3600 AS t_exit FROM v_visit""",
    "v_gt_so": """SELECT run_id AS clip, seq AS pos, roi AS facing, t + 600 AS t_start FROM v_stockout_event
        WHERE kind = 'start'""",
}


def gt(v):
    e = v.of_type("view", "click", "signup")
    label = (F.col("track_id") * 100000000000 + F.floor("t_enter")).cast("bigint")
    starts = v.stockout_event.where(F.col("kind") == "start")
    return {
        "entries": e.select(F.col("run_id").alias("clip"), "t", F.when(
            F.col("event_type") == "click", "out").otherwise("in").alias("dir")),
        "occupancy": v.of_type("purchase").select(
            F.col("run_id").alias("clip"), "t", (F.floor("value") % 60).cast("bigint").alias("count")),
        "visits": v.visit.select(F.col("run_id").alias("clip"), label.alias("label_id"), "zone",
                                 (F.col("t_enter") + 7200).alias("t_enter"), (F.col("t_exit") - 3600).alias("t_exit")),
        "stockouts": starts.select(F.col("run_id").alias("clip"), F.col("seq").alias("pos"),
                                   F.col("roi").alias("facing"), (F.col("t") + 600).alias("t_start")),
    }


def detected(v):
    clip = F.col("run_id").alias("clip")
    starts = v.stockout_event.where(F.col("kind") == "start")
    return {
        "tripwire": v.tripwire.select(clip, "t", "dir"),
        "occupancy": v.occupancy.select(clip, "t", "seq", "count"),
        "visit": v.visit.select(clip, "zone", F.struct("t_enter", "track_id").alias("seq"), "t_enter", "t_exit"),
        "starts": starts.select(clip, "seq", F.col("roi").alias("facing"), "t"),
    }


ENTRY_SQL = """SELECT clip, d AS entries_detected, l AS entries_labelled, (d - l) / CAST(l AS DOUBLE) AS entry_count_error,
    (dx - lx) / CAST(lx AS DOUBLE) AS exit_count_error FROM (
    SELECT clip, count(*) FILTER (dir = 'in') AS l, count(*) FILTER (dir = 'out') AS lx FROM v_gt_entry GROUP BY ALL)
    JOIN (SELECT run_id AS clip, count(*) FILTER (dir = 'in') AS d, count(*) FILTER (dir = 'out') AS dx
      FROM v_tripwire GROUP BY ALL) USING (clip)"""


@query("entry_exit_error", ENTRY_SQL, GT)
def _(v):
    return SC.entry_exit_error(detected(v)["tripwire"], gt(v)["entries"])


OCC_SQL = """SELECT clip, avg(abs(near - count)) AS occupancy_mae FROM (
    SELECT q.clip, q.count, CASE WHEN b.t IS NOT NULL AND (a.t IS NULL OR q.t - b.t <= a.t - q.t) THEN b.count ELSE a.count END AS near
    FROM v_gt_occ q ASOF LEFT JOIN v_occupancy b ON q.clip = b.run_id AND q.t >= b.t
    ASOF LEFT JOIN v_occupancy a ON q.clip = a.run_id AND q.t < a.t) WHERE near IS NOT NULL GROUP BY clip"""


@query("occupancy_mae", f"SELECT clip, round(occupancy_mae, 6) AS occupancy_mae FROM ({OCC_SQL})", GT)
def _(v):
    return SC.occupancy_mae(detected(v)["occupancy"], gt(v)["occupancy"]).select(
        "clip", F.round("occupancy_mae", 6).alias("occupancy_mae"))


VISIT_SQL = """SELECT clip, label_id, count(*) AS matches, arg_min(err, rank) AS dwell_error FROM (
    SELECT *, row_number() OVER (PARTITION BY clip, label_id ORDER BY ov DESC, b0, track_id) AS rank FROM (
      SELECT g.clip, g.label_id, d.track_id, d.t_enter AS b0, abs((d.t_exit - d.t_enter) - (g.t_exit - g.t_enter)) AS err,
        greatest(0, least(g.t_exit, d.t_exit) - greatest(g.t_enter, d.t_enter)) AS ov,
        greatest(g.t_exit, d.t_exit) - least(g.t_enter, d.t_enter) AS un
      FROM v_gt_visit g JOIN v_visit d ON d.run_id = g.clip AND d.zone = g.zone) WHERE un > 0 AND ov / un >= 0.5)
    GROUP BY clip, label_id"""


@query("match_visits", VISIT_SQL, GT)
def _(v):
    return SC.match_visits(gt(v)["visits"], detected(v)["visit"])


SWITCH_SQL = f"""SELECT clip, avg(dwell_error) AS dwell_mae, CAST(sum(matches - 1) AS BIGINT) AS id_switches,
    (SELECT count(*) FROM v_visit d WHERE d.run_id = clip) AS visits_detected,
    (SELECT count(*) FROM v_gt_visit g WHERE g.clip = m.clip) AS visits_labelled, count(*) AS visits_matched
    FROM ({VISIT_SQL}) m GROUP BY clip"""


@query("dwell_and_switches", f"SELECT * REPLACE (round(dwell_mae, 4) AS dwell_mae) FROM ({SWITCH_SQL})", GT)
def _(v):
    return SC.dwell_and_switches(gt(v)["visits"], detected(v)["visit"]).withColumn(
        "dwell_mae", F.round("dwell_mae", 4))


# Independent model: labels of a facing in order, with the list of used starts.
SO_SQL = f"""WITH RECURSIVE lab AS (SELECT *, row_number() OVER (PARTITION BY clip, facing ORDER BY pos) AS rn FROM v_gt_so),
    f(clip, facing, rn, used, pos, hit) AS (
      SELECT DISTINCT clip, facing, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM lab
      UNION ALL SELECT clip, facing, rn, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit) END, pos, hit FROM (
        SELECT f.clip, f.facing, l.rn, f.used, l.pos, (SELECT min(s.seq) FROM v_stockout_event s WHERE s.kind = 'start'
          AND s.run_id = f.clip AND s.roi = f.facing AND abs(s.t - l.t_start) <= {TOL}
          AND NOT list_contains(f.used, s.seq)) AS hit
        FROM f JOIN lab l ON l.clip = f.clip AND l.facing = f.facing AND l.rn = f.rn + 1))
    SELECT clip, pos, hit AS seq FROM f WHERE hit IS NOT NULL"""


@query("match_stockouts", SO_SQL, GT)
def _(v):
    return SC.match_stockouts(gt(v)["stockouts"], detected(v)["starts"], TOL).select("clip", "pos", "seq")


@query("stockout_scores", f"""WITH RECURSIVE m AS (SELECT * FROM ({SO_SQL}))
    SELECT clip, (SELECT count(*) FROM m WHERE m.clip = g.clip) / CAST(count(*) AS DOUBLE) AS stockout_recall,
      (SELECT count(*) FROM v_stockout_event s WHERE s.run_id = g.clip AND kind = 'start')
        - (SELECT count(*) FROM m WHERE m.clip = g.clip) AS stockout_false_alarms
    FROM v_gt_so g GROUP BY clip""", GT)
def _(v):
    return SC.stockout_scores(gt(v)["stockouts"], detected(v)["starts"], TOL)


EVAL = ("entry_count_error", "exit_count_error", "occupancy_mae", "dwell_mae")


def evaluation(v):
    d = detected(v)
    return SC.evaluate_run(d["tripwire"], d["occupancy"], d["visit"], d["starts"], gt(v))


# The run score uses the 10 s tolerance.
SO10_SQL = SO_SQL.replace(str(TOL), "10.0")
RUN_SQL = f"""SELECT e.*, o.occupancy_mae, (SELECT count(*) FROM m WHERE m.clip = e.clip)
        / CAST((SELECT count(*) FROM v_gt_so g WHERE g.clip = e.clip) AS DOUBLE) AS stockout_recall,
      (SELECT count(*) FROM v_stockout_event x WHERE x.run_id = e.clip AND kind = 'start')
        - (SELECT count(*) FROM m WHERE m.clip = e.clip) AS stockout_false_alarms,
      s.* EXCLUDE (clip), false AS passes
    FROM ({ENTRY_SQL}) e JOIN ({OCC_SQL}) o USING (clip) JOIN ({SWITCH_SQL}) s USING (clip)"""


@query("evaluate_run", f"""WITH RECURSIVE m AS (SELECT * FROM ({SO10_SQL})) SELECT * REPLACE (round(entry_count_error, 4) AS entry_count_error,
    round(exit_count_error, 4) AS exit_count_error, round(occupancy_mae, 4) AS occupancy_mae,
    round(dwell_mae, 4) AS dwell_mae, round(stockout_recall, 6) AS stockout_recall) FROM ({RUN_SQL})""", GT)
def _(v):
    return evaluation(v).withColumns({c: F.round(c, 4) for c in EVAL}).withColumn(
        "stockout_recall", F.round("stockout_recall", 6))


NEAR = """SELECT q.*, CASE WHEN b.t IS NOT NULL AND (a.t IS NULL OR q.t - b.t <= a.t - q.t) THEN b ELSE a END AS near
    FROM v_queue_truth q ASOF LEFT JOIN v_queue_estimate b ON q.clip = b.run_id AND q.lane = b.lane AND q.t >= b.t
    ASOF LEFT JOIN v_queue_estimate a ON q.clip = a.run_id AND q.lane = a.lane AND q.t < a.t"""


def queue_pred(v):
    return v.queue_estimate.select(F.col("run_id").alias("clip"), "lane", "t", "seq", "count", "pred_wait_s")


@query("nearest_within", f"""SELECT clip, seq, near.seq AS pred_seq, near.t - t AS dt FROM ({NEAR})
    WHERE abs(near.t - t) <= {TOL}""")
def _(v):
    m = SC.nearest_within(v.queue_truth, queue_pred(v), TOL)
    return m.select("clip", "seq", F.col("near.seq").alias("pred_seq"), (F.col("near.t") - F.col("t")).alias("dt"))


@query("evaluate_queue", f"""SELECT clip, round(avg(abs(near.count - count)), 6) AS count_mae,
    round(avg(abs(near.pred_wait_s - actual_wait_s)), 6) AS wait_mae, count(*) AS n,
    avg(abs(near.count - count)) <= 1 AS count_pass FROM ({NEAR}) WHERE abs(near.t - t) <= {TOL} GROUP BY clip""")
def _(v):
    return SC.evaluate_queue(v.queue_truth, queue_pred(v), TOL).withColumns(
        {c: F.round(c, 6) for c in ("count_mae", "wait_mae")})


METRICS = ("entries_detected", "entries_labelled", "entry_count_error", "exit_count_error", "occupancy_mae",
           "stockout_recall", "stockout_false_alarms", "dwell_mae", "id_switches", "visits_detected",
           "visits_labelled", "visits_matched")


@query("summarise_clips", f"""WITH RECURSIVE m AS (SELECT * FROM ({SO10_SQL})) SELECT metric, round(avg(value), 3) AS mean, count(*) AS n_clips, false AS all_passed FROM (
    UNPIVOT (SELECT {', '.join(f'CAST({m} AS DOUBLE) AS {m}' for m in METRICS)} FROM ({RUN_SQL}))
    ON COLUMNS(*) INTO NAME metric VALUE value) GROUP BY metric""", GT)
def _(v):
    return SC.summarise_clips(evaluation(v)).withColumn("mean", F.round("mean", 3))


@query("timing_stats", """SELECT event_type AS label, count(*) AS frames, round(avg(value), 6) AS mean_ms,
    round(quantile_cont(value, 0.95), 6) AS p95_ms, round(count(*) * 1000 / sum(value), 6) AS fps
    FROM v_ev GROUP BY ALL""")
def _(v):
    t = SC.timing_stats(v.ev.select(F.col("event_type").alias("label"), F.col("value").alias("ms")))
    return t.withColumns({c: F.round(c, 6) for c in ("mean_ms", "p95_ms", "fps")})
