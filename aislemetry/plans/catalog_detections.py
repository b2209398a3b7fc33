"""Queries over boxes, frames, zones and tracks."""
from __future__ import annotations

from pyspark.sql import functions as F

from aislemetry.functions import geometry as G
from aislemetry.operators import detections as D
from aislemetry.operators import tracks as T
from aislemetry.operators.ordered import laid_by
from aislemetry.operators.zones import zone_of
from aislemetry.plans import reports as R
from aislemetry.plans import scoring as SC
from aislemetry.plans.registry import query
from aislemetry.plans.views import HOMOGRAPHY, ZONES, frame_run


def clip_sql(source, k="v_clip"):
    return {
        k + "0": f"""SELECT frame_id, line, x0 AS x, y0 AS y, x1 - x0 AS w, y1 - y0 AS h,
            (x1 - x0) * (y1 - y0) AS area FROM (SELECT frame_id, line,
              floor(greatest(0, least(x, 639))) AS x0, floor(greatest(0, least(y, 479))) AS y0,
              floor(greatest(0, least(x + w, 640))) AS x1, floor(greatest(0, least(y + h, 480))) AS y1
              FROM {source}) WHERE x1 - x0 >= 2 AND y1 - y0 >= 2""",
        k: f"""SELECT *, CAST(r - 1 AS INTEGER) AS k, CASE WHEN n > 64 THEN 3 ELSE 1 END AS flags FROM (
            SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY area DESC, x, y, w, h) AS r,
              count(*) OVER (PARTITION BY frame_id) AS n FROM {k}0) WHERE r <= 64""",
    }


BOX_B = {"v_boxb": """SELECT frame_id, line, x + CASE WHEN w < 23 THEN 1000.0::DOUBLE WHEN line % 2 = 1 THEN 4.0::DOUBLE
    ELSE 0.0::DOUBLE END AS x, y, w, h FROM v_box"""}
BOTH = {**clip_sql("v_box"), **BOX_B, **clip_sql("v_boxb", "v_clipb")}


def iou_sql(a, b):
    iw = f"greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x))"
    ih = f"greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))"
    inter = f"({iw} * {ih})"
    return f"({inter} / ({a}.w * {a}.h + {b}.w * {b}.h - {inter}))"


def boxes_a(v):
    return D.clip_detections(v.box)


def boxes_b(v):
    return D.clip_detections(v.box_b)


@query("foot_point", """SELECT frame_id, line, CAST(x + floor(w / 2) AS BIGINT) AS foot_u,
    CAST(y + h AS BIGINT) AS foot_v, x + w / 2 AS fu, y + h AS fv FROM v_box""")
def _(v):
    iu, iv = G.foot_point("x", "y", "w", "h")
    fu, fv = G.foot_point_float("x", "y", "w", "h")
    return v.box.select("frame_id", "line", iu.alias("foot_u"), iv.alias("foot_v"), fu.alias("fu"), fv.alias("fv"))


@query("image_to_floor", """SELECT seq, round(fx, 6) AS fx, round(fy, 6) AS fy,
    CAST(floor(fx / 0.25) AS BIGINT) AS gx, CAST(floor(fy / 0.25) AS BIGINT) AS gy,
    round(fx * 80, 6) AS u2, round((6 - fy) * 80, 6) AS v2 FROM v_point""")
def _(v):
    x, y = G.image_to_floor(HOMOGRAPHY, F.col("u"), F.col("v"))
    gx, gy = G.heatmap_index(x, y)
    u2, v2 = G.floor_to_image(HOMOGRAPHY, x, y)
    return v.point.select("seq", F.round(x, 6).alias("fx"), F.round(y, 6).alias("fy"), gx.alias("gx"),
                          gy.alias("gy"), F.round(u2, 6).alias("u2"), F.round(v2, 6).alias("v2"))


@query("image_regions", """SELECT seq, CASE least(2, greatest(0, CAST(trunc((v - 60) / 120) AS INTEGER)))
      WHEN 0 THEN 'top' WHEN 1 THEN 'middle' ELSE 'bottom' END || '-'
      || CASE least(2, greatest(0, CAST(trunc(u / (640.0::DOUBLE / 3)) AS INTEGER)))
      WHEN 0 THEN 'left' WHEN 1 THEN 'centre' ELSE 'right' END AS region,
    u <= 24 OR u >= 616 OR v <= 84 OR v >= 396 AS edge FROM v_point""")
def _(v):
    rect = G.content_rect(1920, 1080)
    return v.point.select("seq", G.region_of(F.col("u"), F.col("v"), rect).alias("region"),
                          G.near_edge(F.col("u"), F.col("v"), rect).alias("edge"))


@query("segment_geometry", """SELECT seq, round(d, 6) AS dist, CAST(CASE WHEN d > 0 THEN 1 WHEN d < 0 THEN -1
      ELSE 0 END AS INTEGER) AS side, (d1 > 0) <> (d2 > 0) AND (d3 > 0) <> (d4 > 0) AS crosses,
    CASE WHEN (d > 0) = (-560 > 0) THEN 'in' ELSE 'out' END AS dir FROM (
    SELECT seq, v - 240 AS d, 560 * (pv - 240) AS d1, 560 * (v - 240) AS d2,
      (u - pu) * (240 - pv) - (v - pv) * (40 - pu) AS d3, (u - pu) * (240 - pv) - (v - pv) * (600 - pu) AS d4 FROM (
      SELECT seq, u, v, CAST(seq * 11 % 640 AS DOUBLE) AS pu, CAST(seq * 17 % 480 AS DOUBLE) AS pv FROM v_point))""")
def _(v):
    a, b = (F.lit(40.0), F.lit(240.0)), (F.lit(600.0), F.lit(240.0))
    p = v.point.withColumns({"pu": (F.col("seq") * 11 % 640).cast("double"),
                             "pv": (F.col("seq") * 17 % 480).cast("double")})
    u, w = F.col("u"), F.col("v")
    side = G.side_of(a, b, u, w)
    return p.select("seq", F.round(G.signed_distance(a, b, u, w), 6).alias("dist"), side.alias("side"),
                    G.segments_cross((F.col("pu"), F.col("pv")), (u, w), a, b).alias("crosses"),
                    G.crossing_direction(a, b, F.lit("up"), side > 0).alias("dir"))


@query("clip_detections", """SELECT 'run-0' AS run_id, 'overhead' AS stream, frame_id, k, x, y, w, h, area,
    CAST(flags AS INTEGER) AS flags FROM v_clip""", clip_sql("v_box"))
def _(v):
    return boxes_a(v).drop("line")


FRAME_SQL = {"v_frame": """SELECT DISTINCT frame_id, frame_id / 15.0::DOUBLE AS t,
    CASE WHEN frame_id % 16 = 0 THEN 0 ELSE 1 END AS flags FROM v_box"""}


def frames(v):
    return v.box.select("run_id", "stream", "frame_id").distinct().withColumns({
        "t": F.col("frame_id") / 15.0,
        "flags": F.when(F.col("frame_id") % 16 == 0, 0).otherwise(1)})


GATE_SQL = """SELECT frame_id, t, CAST(flags AS INTEGER) AS flags, box_area,
      NOT coalesce(t < max(CASE WHEN box_area > 0.1::DOUBLE * 307200 THEN t END) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING)
        + 0.5, false) AS counted FROM (
      SELECT f.*, coalesce(a.box_area, 0) AS box_area FROM v_frame f LEFT JOIN (
        SELECT frame_id, sum(w * h) AS box_area FROM v_box GROUP BY frame_id) a USING (frame_id) WHERE flags = 1)"""


def gated(v):
    return D.gate_frames(frames(v), v.box, flood_frac=0.1, pause_s=0.5)


@query("gate_frames", "SELECT 'run-0' AS run_id, 'overhead' AS stream, * FROM v_gate",
       {**FRAME_SQL, "v_gate": GATE_SQL})
def _(v):
    return gated(v)


@query("drop_shadows", """SELECT frame_id, k, x, y, w, h FROM v_clip WHERE NOT (h > 0 AND w / h > 0.7)""",
       clip_sql("v_box"))
def _(v):
    return D.drop_shadows(boxes_a(v), 0.7).select("frame_id", "k", "x", "y", "w", "h")


PAIR_SQL = f"""SELECT a.frame_id, a.k AS i, b.k AS j, {iou_sql('a', 'b')} AS iou
    FROM v_clip a JOIN v_clipb b ON a.frame_id = b.frame_id WHERE {iou_sql('a', 'b')} >= 0.5"""


@query("iou_pairs", "SELECT frame_id, i, j, round(iou, 9) AS iou FROM v_pair", {**BOTH, "v_pair": PAIR_SQL})
def _(v):
    return D.iou_pairs(boxes_a(v), boxes_b(v)).select("frame_id", "i", "j", F.round("iou", 9).alias("iou"))


# Independent model: walk each frame's pairs in order with the lists of used slots.
MATCH_SQL = """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY iou DESC, i, j) AS rn
      FROM v_pair),
    f(frame_id, rn, ua, ub, i, j, iou) AS (
      SELECT DISTINCT frame_id, CAST(0 AS BIGINT), CAST([] AS INTEGER[]), CAST([] AS INTEGER[]),
        CAST(NULL AS INTEGER), CAST(NULL AS INTEGER), CAST(NULL AS DOUBLE) FROM o
      UNION ALL SELECT f.frame_id, o.rn,
        CASE WHEN ok THEN list_append(f.ua, o.i) ELSE f.ua END, CASE WHEN ok THEN list_append(f.ub, o.j) ELSE f.ub END,
        CASE WHEN ok THEN o.i END, CASE WHEN ok THEN o.j END, o.iou
      FROM f JOIN o ON o.frame_id = f.frame_id AND o.rn = f.rn + 1,
      LATERAL (SELECT NOT list_contains(f.ua, o.i) AND NOT list_contains(f.ub, o.j) AS ok))
    SELECT frame_id, i, j, round(iou, 9) AS iou FROM f WHERE i IS NOT NULL"""


@query("match_blobs", MATCH_SQL, {**BOTH, "v_pair": PAIR_SQL})
def _(v):
    return D.match_blobs(boxes_a(v), boxes_b(v)).select("frame_id", "i", "j", F.round("iou", 9).alias("iou"))


@query("match_blobs_leftover", f"""WITH RECURSIVE m AS (SELECT * FROM ({MATCH_SQL}))
    SELECT frame_id, k, 'a' AS side FROM v_clip a WHERE NOT EXISTS (SELECT 1 FROM m
      WHERE m.frame_id = a.frame_id AND m.i = a.k)
    UNION ALL SELECT frame_id, k, 'b' FROM v_clipb b WHERE NOT EXISTS (SELECT 1 FROM m
      WHERE m.frame_id = b.frame_id AND m.j = b.k)""", {**BOTH, "v_pair": PAIR_SQL})
def _(v):
    return D.leftovers(boxes_a(v), boxes_b(v)).select("frame_id", "k", "side")


@query("compare_detections", f"""WITH RECURSIVE m AS (SELECT * FROM ({MATCH_SQL})) ,
    n AS (SELECT coalesce(a.frame_id, b.frame_id) AS frame_id, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb
      FROM (SELECT frame_id, count(*) AS na FROM v_clip GROUP BY ALL) a
      FULL JOIN (SELECT frame_id, count(*) AS nb FROM v_clipb GROUP BY ALL) b ON a.frame_id = b.frame_id)
    SELECT 'run-0' AS run_id, 'overhead' AS stream, (SELECT count(*) FROM n) AS frames,
      (SELECT count(*) FROM m) AS matched, round((SELECT avg(iou) FROM m), 6) AS mean_iou,
      round((SELECT avg(CAST(na = nb AS INTEGER)) FROM n), 6) AS count_agreement,
      round((SELECT avg(nb - na) FROM n), 6) AS mean_blob_delta,
      (SELECT avg(CAST(na = nb AS INTEGER)) >= 0.9 FROM n) AND (SELECT avg(iou) >= 0.7 FROM m) AS passes""",
       {**BOTH, "v_pair": PAIR_SQL})
def _(v):
    c = SC.compare_detections(boxes_a(v), boxes_b(v))
    return c.withColumns({k: F.round(k, 6) for k in ("mean_iou", "count_agreement", "mean_blob_delta")})


# Independent model: one step per looked-at pair (i, j) of every frame; a pass without a union ends it.
STACK = """(CASE WHEN a.y <= b.y THEN b.y - (a.y + a.h) ELSE a.y - (b.y + b.h) END) BETWEEN -0.25 * least(a.h, b.h) AND 8
    AND greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) / greatest(least(a.w, b.w), 1e-9) >= 0.6"""
FUSE_SQL = f"""WITH RECURSIVE s(frame_id, bs, i, j, ch) AS (
      SELECT frame_id, list({{'x': x, 'y': y, 'w': w, 'h': h}} ORDER BY k), 1, 2, false FROM v_clip GROUP BY frame_id
      UNION ALL SELECT frame_id, CASE WHEN hit THEN list_concat(list_append(bs[:i - 1], {{'x': least(a.x, b.x), 'y': least(a.y, b.y),
            'w': greatest(a.x + a.w, b.x + b.w) - least(a.x, b.x), 'h': greatest(a.y + a.h, b.y + b.h) - least(a.y, b.y)}}),
            list_concat(bs[i + 1:j - 1], bs[j + 1:])) ELSE bs END,
        CASE WHEN hit OR j < len(bs) THEN i WHEN i < len(bs) THEN i + 1 ELSE 1 END,
        CASE WHEN hit THEN j WHEN j < len(bs) THEN j + 1 WHEN i < len(bs) THEN i + 2 ELSE 2 END,
        CASE WHEN hit THEN true WHEN j < len(bs) OR i < len(bs) THEN ch ELSE false END
      FROM (SELECT *, j <= len(bs) AND {STACK} AS hit FROM (SELECT *, bs[i] AS a, bs[j] AS b FROM s
        WHERE i < len(bs) OR ch)))
    SELECT frame_id, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY w * h DESC, x, y, w, h) - 1 AS INTEGER) AS k,
      x, y, w, h, w * h AS area FROM (SELECT frame_id, unnest(bs, recursive := true) FROM s WHERE i >= len(bs) AND NOT ch)"""


@query("merge_fragments", FUSE_SQL, clip_sql("v_box"))
def _(v):
    return D.merge_fragments(boxes_a(v), x_tol=0.6).drop("run_id", "stream")


# --- zones -------------------------------------------------------------------
def zones(v):
    rows = [(i, n, [list(p) for p in poly]) for i, (n, poly) in enumerate(ZONES)]
    return v.spark.createDataFrame(rows, "position int, id string, polygon array<array<double>>")


EDGE_VALUES = ", ".join(
    f"({i}, '{n}', {p[j][0]}, {p[j][1]}, {p[(j + 1) % len(p)][0]}, {p[(j + 1) % len(p)][1]})"
    for i, (n, p) in enumerate(ZONES) for j in range(len(p)))
ZONE_SQL = f"""WITH edge(pos, id, ax, ay, ex, ey) AS (VALUES {EDGE_VALUES}),
    cell AS (SELECT x.range AS gx, y.range AS gy, -1 + (x.range + 0.5) * 0.25 AS px, -1 + (y.range + 0.5) * 0.25 AS py
      FROM range(0, 42) x, range(0, 30) y),
    hit AS (SELECT gx, gy, pos, id FROM cell, edge WHERE (ay > py) <> (ey > py)
      AND px < (ex - ax) * (py - ay) / (ey - ay) + ax GROUP BY gx, gy, pos, id HAVING count(*) % 2 = 1),
    raster AS (SELECT gx, gy, arg_max(id, pos) AS zone FROM hit GROUP BY gx, gy)
    SELECT p.seq, r.zone FROM v_point p LEFT JOIN raster r
      ON r.gx = CAST(floor((p.fx + 1) / 0.25) AS BIGINT) AND r.gy = CAST(floor((p.fy + 1) / 0.25) AS BIGINT)"""


@query("zone_of", ZONE_SQL)
def _(v):
    x, y = G.image_to_floor(HOMOGRAPHY, F.col("u"), F.col("v"))
    return zone_of(v.point.withColumns({"X": x, "Y": y}), zones(v)).select("seq", "zone")


# --- tracks ------------------------------------------------------------------
TRK = {"v_trk": """SELECT l_orderkey AS frame_id, l_suppkey AS track_id, CAST(p % 640 AS DOUBLE) AS u,
    CAST(p * 7 % 480 AS DOUBLE) AS v, p % 5 = 0 AS still, CAST(p % 97 AS DOUBLE) AS travelled,
    CASE l_suppkey % 5 WHEN 0 THEN 'entrance' WHEN 1 THEN 'aisle_a' WHEN 2 THEN 'aisle_b'
      WHEN 3 THEN 'checkout' END AS zone
    FROM (SELECT l_orderkey, l_suppkey, CAST(sum(l_partkey) AS BIGINT) AS p FROM lineitem GROUP BY ALL)"""}


def trk(v, lines=None):
    lines = v.table("lineitem") if lines is None else lines
    return boxed(lines.groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_partkey").alias("p")))


def boxed(g):
    """A box per row of l_orderkey, l_suppkey, p."""
    zone = F.try_element_at(F.array(*map(F.lit, ("entrance", "aisle_a", "aisle_b", "checkout"))),
                            (F.col("l_suppkey") % 5 + 1).cast("int"))
    u, w = (F.col("p") % 640).cast("double"), (F.col("p") * 7 % 480).cast("double")
    return g.select(
        frame_run("l_orderkey").alias("run_id"), F.lit("overhead").alias("stream"), F.col("l_orderkey").alias("frame_id"),
        F.col("l_suppkey").alias("track_id"), u.alias("u"), w.alias("v"), (F.col("p") % 5 == 0).alias("still"),
        (F.col("p") % 97).cast("double").alias("travelled"), zone.alias("zone"),
        (u - 10).alias("x"), (w - 40).alias("y"), F.lit(20.0).alias("w"), F.lit(40.0).alias("h"))


FEATURE_SQL = """SELECT track_id, frame_id, round(travelled, 6) AS travelled, far_frames, far_frames >= 5 AS walked,
      round(speed, 6) AS speed, coalesce(speed < 30, false) AS still FROM (
    SELECT track_id, frame_id, max(away) OVER w AS travelled, CAST(sum(CASE WHEN away >= 40 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS far_frames,
      CASE WHEN rn > 1 THEN sqrt((u - u0) ** 2 + (v - v0) ** 2) / (least(rn, 8) - 1) END AS speed FROM (
      SELECT *, sqrt((u - first(u) OVER o) ** 2 + (v - first(v) OVER o) ** 2) AS away, row_number() OVER o AS rn,
        first(u) OVER (PARTITION BY track_id ORDER BY frame_id ROWS 7 PRECEDING) AS u0,
        first(v) OVER (PARTITION BY track_id ORDER BY frame_id ROWS 7 PRECEDING) AS v0
      FROM v_trk WINDOW o AS (PARTITION BY track_id ORDER BY frame_id))
    WINDOW w AS (PARTITION BY track_id ORDER BY frame_id ROWS UNBOUNDED PRECEDING))"""


def whole_tracks(v):
    """Tracks, and the chunk length of scans over them.

    Lines are counted instead of boxes, which are no more and would have to be shuffled to be counted. Where no track has
    to be cut, its lines meet in one task before they are added up to boxes, so that boxes are not shuffled again.
    """
    lines = v.table("lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    chunk_s = T.resolve("auto", boxed(lines.withColumnRenamed("l_partkey", "p")), T.TRACK, "frame_id")
    t = trk(v, laid_by(lines, "l_suppkey") if chunk_s is None else lines)
    return t.drop("still", "travelled"), chunk_s


def features(v):
    t, chunk_s = whole_tracks(v)
    return T.track_features(t, still_px=30.0, chunk_s=chunk_s)


@query("track_features", FEATURE_SQL, TRK)
def _(v):
    return features(v).select("track_id", "frame_id", F.round("travelled", 6).alias("travelled"), "far_frames",
                              "walked", F.round("speed", 6).alias("speed"), "still")


@query("hold_still", """SELECT track_id, frame_id, false AS held FROM v_feat
    UNION ALL SELECT track_id, unnest(range(frame_id + 1, least(frame_id + 450, coalesce(nxt - 1, frame_id + 450)) + 1)), true
    FROM (SELECT *, lead(frame_id) OVER (PARTITION BY track_id ORDER BY frame_id) AS nxt FROM v_feat)
    WHERE walked AND still""", {**TRK, "v_feat": FEATURE_SQL})
def _(v):
    t, chunk_s = whole_tracks(v)
    return T.hold_still(t, still_px=30.0, chunk_s=chunk_s).select("track_id", "frame_id", "held")


@query("occupancy", """WITH RECURSIVE src AS (SELECT 1 AS k, g.t, g.frame_id AS seq,
      CASE WHEN counted THEN coalesce(n, 0) ELSE 0 END AS count FROM v_gate g LEFT JOIN (
        SELECT frame_id, count(*) AS n FROM v_trk WHERE zone IS DISTINCT FROM 'entrance' GROUP BY ALL) x USING (frame_id)),
    kept(k, t) AS (SELECT k, min(t) FROM src GROUP BY k UNION ALL SELECT kept.k, (SELECT min(s.t) FROM src s
      WHERE s.t - kept.t >= 1.0) FROM kept WHERE kept.t IS NOT NULL)
    SELECT 'run-0' AS run_id, 'overhead' AS stream, s.t, s.seq, s.count FROM src s JOIN kept ON kept.t = s.t""",
       {**FRAME_SQL, **TRK, "v_gate": GATE_SQL})
def _(v):
    return T.occupancy(gated(v), trk(v))


@query("link_detections")
def _(v):
    return T.link_detections(boxes_a(v))


def _same_size(a, b):
    """IoU of two boxes of 20 x 40 by their foot points."""
    inter = f"greatest(0, 20 - abs({a[0]} - {b[0]})) * greatest(0, 40 - abs({a[1]} - {b[1]}))"
    return f"({inter} / (1600 - {inter}))"


STATIC_SQL = f"""WITH away AS (SELECT *, sqrt((u - first(u) OVER o) ** 2 + (v - first(v) OVER o) ** 2) AS d FROM v_trk
      WINDOW o AS (PARTITION BY track_id ORDER BY frame_id)),
    life AS (SELECT track_id, min(frame_id) AS f0, max(frame_id) AS f1, arg_min(u, frame_id) AS u0, arg_min(v, frame_id) AS v0,
      arg_max(u, frame_id) AS u1, arg_max(v, frame_id) AS v1, count(*) FILTER (d >= 700) >= 5 AS walked FROM away GROUP BY track_id),
    heir AS (SELECT DISTINCT n.track_id FROM life n JOIN life g ON g.walked AND n.f0 - (g.f1 + 31) > 0
      AND n.f0 - (g.f1 + 31) < 45 AND {_same_size(("g.u1", "g.v1"), ("n.u0", "n.v0"))} >= 0.3),
    other AS (SELECT * FROM life WHERE NOT walked AND track_id NOT IN (SELECT track_id FROM heir)),
    fixed AS (SELECT *, f0 + 25 AS s0 FROM other WHERE f1 - f0 + 1 > 25),
    hit AS (SELECT p.track_id AS spot, b.frame_id AS f FROM fixed p JOIN v_trk b ON b.frame_id > p.s0
      AND {_same_size(("p.u1", "p.v1"), ("b.u", "b.v"))} >= 0.5 UNION SELECT track_id, s0 FROM fixed),
    gap AS (SELECT spot, f, f - lag(f) OVER (PARTITION BY spot ORDER BY f) >= 600 AS quiet FROM hit),
    chain AS (SELECT spot, f, count(*) FILTER (quiet) OVER (PARTITION BY spot ORDER BY f) AS broken FROM gap),
    seen AS (SELECT spot, max(f) AS seen_to FROM chain WHERE broken = 0 GROUP BY spot),
    ghost AS (SELECT n.track_id FROM other n JOIN fixed p ON n.f0 > p.s0
      AND {_same_size(("p.u1", "p.v1"), ("n.u0", "n.v0"))} >= 0.5 JOIN seen ON seen.spot = p.track_id AND n.f0 < seen_to + 600)
    SELECT 'run-0' AS run_id, 'overhead' AS stream, frame_id, track_id, u, v, zone, u - 10 AS x, v - 40 AS y,
      20.0::DOUBLE AS w, 40.0::DOUBLE AS h FROM v_trk WHERE track_id NOT IN (SELECT track_id FROM fixed)
      AND track_id NOT IN (SELECT track_id FROM ghost)"""


@query("drop_static", STATIC_SQL, TRK)
def _(v):
    return T.drop_static(trk(v).drop("still", "travelled"), far_px=700.0)


# --- reports -----------------------------------------------------------------
REGION = """CASE least(2, greatest(0, CAST(trunc({v} / 160.0::DOUBLE) AS INTEGER)))
      WHEN 0 THEN 'top' WHEN 1 THEN 'middle' ELSE 'bottom' END || '-'
      || CASE least(2, greatest(0, CAST(trunc({u} / (640.0::DOUBLE / 3)) AS INTEGER)))
      WHEN 0 THEN 'left' WHEN 1 THEN 'centre' ELSE 'right' END"""
DWELL_SQL = f"""SELECT d.track_id, round(f0 / 15, 2) AS first_seen_s, round(f1 / 15, 2) AS last_seen_s,
      round(n / 15, 2) AS present_s, round(s / 15, 2) AS standing_still_s, CAST(walked AS BIGINT) AS walked_px,
      m.r AS mostly_in_region, coalesce(z.zone, '') AS mostly_in_zone FROM (
      SELECT track_id, min(frame_id) AS f0, max(frame_id) AS f1, count(*) AS n, count(*) FILTER (still) AS s,
        arg_max(travelled, frame_id) AS walked FROM v_trk GROUP BY ALL) d
    JOIN (SELECT * FROM (SELECT track_id, r, row_number() OVER (PARTITION BY track_id ORDER BY n DESC, f) AS rn FROM (
      SELECT track_id, {REGION.format(u='u', v='v')} AS r, count(*) AS n, min(frame_id) AS f FROM v_trk GROUP BY ALL))
      WHERE rn = 1) m ON m.track_id = d.track_id
    LEFT JOIN (SELECT DISTINCT track_id, zone FROM v_trk WHERE zone IS NOT NULL) z ON z.track_id = d.track_id"""
SPAN = {"v_span": """SELECT track_id, min(frame_id) AS f0, max(frame_id) AS f1, count(*) AS present,
    arg_min(u, frame_id) AS bu, arg_min(v, frame_id) AS bv, arg_max(u, frame_id) AS gu, arg_max(v, frame_id) AS gv
    FROM v_trk GROUP BY ALL"""}
REPORT = {**TRK, **FRAME_SQL, **SPAN}
EDGE_SQL = """SELECT track_id, CAST(bu <= 24 OR bu >= 616 OR bv <= 24 OR bv >= 456 AS INTEGER) AS entered_view_from_edge,
    CAST((gu <= 24 OR gu >= 616 OR gv <= 24 OR gv >= 456) AND f1 < (SELECT max(frame_id) FROM v_frame) AS INTEGER)
      AS left_view_via_edge, 'frame edge (no door configured)' AS basis FROM v_span WHERE present >= 7"""


@query("dwell_report", DWELL_SQL, REPORT)
def _(v):
    return R.dwell_report(trk(v)).drop("run_id", "stream")


@query("footfall_report", """SELECT round(b * 10.0::DOUBLE, 1) AS from_s,
      round(least((b + 1) * 10.0::DOUBLE, ((SELECT max(frame_id) FROM v_frame) + 1) / 15), 1) AS to_s,
      round(avg(n), 2) AS people_present_mean, max(n) AS people_present_max,
      (SELECT count(*) FROM v_span WHERE f0 // 150 = b) AS arrivals,
      (SELECT count(*) FROM v_span WHERE f1 // 150 = b AND f1 < (SELECT max(frame_id) FROM v_frame)) AS departures
    FROM (SELECT f.frame_id // 150 AS b, coalesce(x.n, 0) AS n FROM v_frame f LEFT JOIN (
      SELECT frame_id, count(*) AS n FROM v_trk GROUP BY ALL) x USING (frame_id)) GROUP BY b""", REPORT)
def _(v):
    return R.footfall_report(trk(v), frames(v)).drop("run_id", "stream")


@query("entries_exits_edge", EDGE_SQL, REPORT)
def _(v):
    return R.entries_exits_edge(trk(v), frames(v)).drop("run_id", "stream")


def door(v):
    """Crossings as a clip report sees them: frame and direction."""
    return trk(v).select(
        "run_id", "stream", "frame_id", F.when(F.col("still"), "in").otherwise("out").alias("dir"))


@query("entries_exits_door", """SELECT round(b.range * 10.0::DOUBLE, 1) AS from_s, coalesce(e, 0) AS entered,
      coalesce(x, 0) AS exited, 'configured door line' AS basis
    FROM range((SELECT max(frame_id) FROM v_frame) // 150 + 1) b LEFT JOIN (
      SELECT frame_id // 150 AS b, count(*) FILTER (still) AS e, count(*) FILTER (NOT still) AS x
      FROM v_trk GROUP BY ALL) c ON c.b = b.range""", REPORT)
def _(v):
    return R.entries_exits_door(door(v), frames(v)).drop("run_id", "stream")


@query("clip_summary", f"""WITH f AS (SELECT count(*) AS frames, round(avg(coalesce(n, 0)), 2) AS m, max(coalesce(n, 0)) AS x
      FROM v_frame LEFT JOIN (SELECT frame_id, count(*) AS n FROM v_trk GROUP BY ALL) USING (frame_id)),
    h AS (SELECT gx, gy, n FROM (SELECT floor(u / 16) AS gx, floor(v / 16) AS gy, count(*) AS n FROM v_trk GROUP BY ALL)
      ORDER BY n DESC, gy, gx LIMIT 1)
    SELECT frames, round(frames / 15, 1) AS duration_s,
      (SELECT CAST(sum(entered_view_from_edge) AS BIGINT) FROM ({EDGE_SQL})) AS entered,
      (SELECT CAST(sum(left_view_via_edge) AS BIGINT) FROM ({EDGE_SQL})) AS exited,
      m AS people_present_mean, x AS people_present_max, (SELECT count(*) FROM v_dw) AS distinct_people,
      (SELECT count(*) FROM v_dw WHERE standing_still_s >= 2) AS stood_still_2s,
      (SELECT max(standing_still_s) FROM v_dw) AS longest_still_s, CAST(gx * 16 + 8 AS BIGINT) AS hot_x,
      CAST(gy * 16 + 8 AS BIGINT) AS hot_y, {REGION.format(u='(gx * 16)', v='(gy * 16)')} AS hot_region, h.n AS hot_samples
    FROM f, h""", {**REPORT, "v_dw": DWELL_SQL})
def _(v):
    return R.clip_summary(trk(v), frames(v)).drop("run_id", "stream")
