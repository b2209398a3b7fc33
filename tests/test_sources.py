import json

import pytest
from pyspark.sql import functions as F

from aislemetry.schema import DIMENSIONS, ENVELOPE, FRAME, PLAUSIBLE_EPOCH, TABLES
from aislemetry.sources import maintain as M
from aislemetry.sources import readers as RD
from aislemetry.sources import sinks as SK
from aislemetry.sources import validate as V


def event(t, kind, payload, zone=None, stream="overhead", store="s"):
    return (float(t), store, stream, zone, kind, json.dumps(payload))


def envelopes(spark, rows):
    return spark.createDataFrame(rows, ENVELOPE)


def test_read_events_keeps_payload_text_and_skips_blanks(spark, tmp_path):
    lines = [json.dumps({"t": 1.5, "store_id": "s", "stream": "-", "zone_id": None, "event_type": "occupancy",
                         "payload": {"count": 3}}), "", "{broken"]
    (tmp_path / "e.jsonl").write_text("\n".join(lines))
    got = RD.read_events(spark, str(tmp_path)).collect()
    assert [json.loads(r.payload) for r in got if r.corrupt is None] == [{"count": 3}]
    assert [r.corrupt for r in got if r.corrupt is not None] == ["{broken"]


def test_pos_csv_blank_hint_is_null_and_valid(spark, tmp_path):
    (tmp_path / "p.csv").write_text("t,lane,items,amount,zone_hint\n1.0,2,3,9.5,\n2.0,1,1,4.0,aisle\n")
    good, bad = V.validate_events(RD.read_pos_csv(spark, str(tmp_path / "p.csv"), "s"))
    assert bad.count() == 0
    rows = SK.route_events(good, "r")["pos_txn"].orderBy("t").collect()
    assert [(r.lane, r.items, r.amount, r.zone_hint) for r in rows] == [(2, 3, 9.5, None), (1, 1, 4.0, "aisle")]


def test_validation_reasons(spark):
    e = envelopes(spark, [event(2e9, "occupancy", {"count": 1}), event(2e9, "nope", {}),
                          event(2e9, "occupancy", {"count": 1}, stream="roof"),
                          event(2e9, "occupancy", {"n": 1}), event(5, "occupancy", {"count": 1})])
    good, bad = V.validate_events(e, PLAUSIBLE_EPOCH)
    assert good.count() == 1
    assert sorted((r.reason, str(r.missing), str(r.unexpected)) for r in bad.collect()) == [
        ("implausible time", "[]", "[]"), ("payload mismatch", "['count']", "['n']"),
        ("unknown event_type", "None", "None"), ("unknown stream", "[]", "[]")]


def test_every_event_type_reaches_its_table(spark):
    rows = [event(1, "tripwire", {"dir": "in", "tripwire_id": "d"}), event(1, "occupancy", {"count": 4}),
            event(1, "visit", {"track_id": 7, "t_enter": 1.0, "t_exit": 3.5}, "a"),
            event(1, "heatmap", {"t_bucket": 0, "tiles": [[1, 2, 3], [4, 5, 6]]}),
            event(2, "heatmap", {"t_bucket": 0, "tiles": [[1, 2, 9]]}),
            event(1, "shelf_fill", {"fill": 120}, "A1"),
            event(1, "stockout_start", {"sku": "S", "facing": "A1"}, "A1"),
            event(5, "stockout_end", {"sku": "S", "facing": "A1"}, "A1"),
            event(1, "planogram_violation", {"expected_sku": "S", "observed": "low"}, "A1"),
            event(1, "lane_occ", {"lane": 1, "cells": list(range(250, 266))}),
            event(1, "queue_estimate", {"lane": 1, "count": 1.5, "pred_wait_s": 67.5}),
            event(1, "pos_txn", {"lane": 1, "items": 2, "amount": 3.5, "zone_hint": None}),
            event(1, "alert", {"severity": "info", "rule": "r", "message": "m"})]
    good, bad = V.validate_events(envelopes(spark, rows))
    assert bad.count() == 0
    t = {k: [tuple(r)[1:] for r in v.collect()] for k, v in SK.route_events(good, "r").items()}
    assert t["tripwire"] == [(1.0, "in")] and t["visit"] == [(7, "a", 1.0, 3.5, 2.5)]
    assert sorted(t["heatmap"]) == [(0, 1, 2, 9), (0, 4, 5, 6)]
    assert t["stockout"] == [("A1", "S", 1.0, 5.0)]
    assert t["lane_occ"][0][2] == [250, 251, 252, 253, 254, 255, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert t["alert"] == [(1.0, "info", "r", "m", 0)] and t["pos_txn"] == [(1.0, 1, 2, 3.5, None)]


def test_run_lifecycle(spark, tmp_path):
    base = str(tmp_path)
    SK.start_run(spark, base, "r1", "s", "c", 1.0)
    SK.start_run(spark, base, "r2", "s", "c", 2.0)
    SK.write_tables({"occupancy": spark.createDataFrame([("r1", 1.0, 3), ("r2", 1.0, 4)], TABLES["occupancy"])}, base)
    runs = SK.read_table(spark, base, "run")
    assert [r.run_id for r in SK.list_runs(runs).collect()] == ["r2", "r1"]
    live = spark.createDataFrame([("r3", "s", 0.5, "c", "running"), ("r1", "s", 1.0, "c", "done")],
                                 "run_id string, store_id string, started double, clipset string, state string")
    assert [(r.run_id, r.state) for r in SK.list_runs(runs, live).collect()] == [
        ("r3", "running"), ("r2", None), ("r1", "done")]
    assert SK.latest_run(runs).first()[0] == "r2"
    assert sorted(SK.delete_run(spark, base, "r2")) == ["occupancy", "run"]
    assert [r.run_id for r in SK.read_table(spark, base, "occupancy").collect()] == ["r1"]
    assert SK.without_run(runs.limit(5), "r1").where("run_id = 'r1'").count() == 0


def test_rollup_means_and_untouched_rows(spark):
    now = 10 * 86400.0
    f = spark.createDataFrame([("r", now - 7260, "A", 100.0), ("r", now - 7230, "A", 200.0), ("r", now - 60, "A", 7.0),
                               ("r", now - 8 * 86400, "A", 9.0)], TABLES["shelf_fill"])
    got = sorted((r.t, r.fill) for r in M.rollup_fills(f, now).collect())
    assert got == [(now - 8 * 86400, 9.0), (now - 7260, 150.0), (now - 60, 7.0)]
    assert M.retention(f, now).count() == 3
    c = spark.createDataFrame([("r", now - 7260, 1, [0] * 16), ("r", now - 7230, 1, [17] * 16)], TABLES["lane_occ"])
    assert M.rollup_lanes(c, now).first()["cells"] == [8] * 16


def test_sync_advances_only_after_delivery(spark, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    kpi = spark.createDataFrame([("r", b, "entries", 1.0) for b in (900, 1800)], TABLES["kpi_15m"])
    assert M.sync(spark, kpi, out, state, clock_synced=False) == 0
    assert M.sync(spark, kpi, out, state) == 1800
    assert M.sync(spark, kpi, out, state) == 1800
    more = kpi.union(spark.createDataFrame([("r", 2700, "entries", 2.0)], TABLES["kpi_15m"]))
    assert M.sync(spark, more, out, state) == 2700
    assert sorted(r.t_bucket for r in spark.read.parquet(out).collect()) == [900, 1800, 2700]
    blocked = tmp_path / "file"
    blocked.write_text("x")
    with pytest.raises(Exception):
        M.sync(spark, more.union(spark.createDataFrame([("r", 3600, "k", 1.0)], TABLES["kpi_15m"])),
               str(blocked), state)
    assert M.read_cursor(spark, state) == 2700


def test_frames_unpack(spark, tmp_path):
    rec = {"run_id": "r", "store_id": "s", "stream": "shelf", "frame_id": 5, "t_ns": 3_000_000_000, "flags": 1,
           "num_blobs": 1, "blobs": [{"x": 1, "y": 2, "w": 3, "h": 4, "area": 12}, {"x": 9, "y": 9, "w": 9, "h": 9, "area": 81}],
           "roi_fill": [10, 20, 30], "lane_occupancy": [50, 60, 70]}
    later = {**rec, "frame_id": 6, "t_ns": 4_500_000_000, "num_blobs": 0}
    (tmp_path / "f.json").write_text(json.dumps(rec) + "\n" + json.dumps(later))
    frames = V.event_time(RD.read_frames(spark, str(tmp_path)), 100.0)
    assert frames.select("t", *[n.strip().split(" ")[0] for n in FRAME.split(",")[:2]]).count() == 2
    assert [(r.frame_id, r.t, r.k, r.x, r.area) for r in RD.detections(frames).collect()] == [(5, 100.0, 0, 1.0, 12.0)]
    rois = spark.createDataFrame([(0, "A"), (2, "C")], "position int, id string")
    assert sorted((r.t, r.roi, r.fill) for r in RD.roi_fills(frames, rois).collect()) == [
        (100.0, "A", 10), (100.0, "C", 30), (101.5, "A", 10), (101.5, "C", 30)]
    lanes = spark.createDataFrame([(0, 1), (2, 1), (1, 2)], "position int, lane int")
    cells = {(r.t, r.lane): r.cells for r in RD.lane_cells(frames, lanes).collect()}
    assert cells[(100.0, 1)] == [50, 70] + [0] * 14 and cells[(101.5, 2)] == [60] + [0] * 15


def dims(spark, **changes):
    base = {
        "rois": [("s", 0, "A1", "shelf", 0, 0, 10, 10, 60, 110, None)],
        "lanes": [("s", 0, "L", 1, 0, 0, 0, 10, 10)],
        "zones": [("s", 0, "z", [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]])],
        "tripwires": [("s", 0, "d", "overhead", [0.0, 0.0], [1.0, 0.0], "up")],
        "planogram": [("s", 0, "A1", "S", "n", 1.0, 2.0, None, None)],
    }
    base.update(changes)
    return {n: spark.createDataFrame(base[n], f"store_id string, position int, {DIMENSIONS[n]}") for n in base}


def test_dimension_checks(spark):
    assert V.validate_dimensions(dims(spark)).count() == 0
    d = dims(spark, rois=[("s", 0, "A1", "shelf", 315, 0, 10, 10, 60, 110, None), ("s", 1, "A1", "roof", 0, 0, 1, 1, 9, 9, None)],
             zones=[("s", 0, "z", [[0.0, 0.0], [1.0, 0.0]])],
             planogram=[("s", 0, "B9", "S", "n", 1.0, None, None, None)])
    got = {(r.table, r.entry, r.problem) for r in V.validate_dimensions(d).collect()}
    assert got == {("rois", "A1", "duplicate id"), ("rois", "A1", "box outside the frame"), ("rois", "A1", "unknown stream"),
                   ("rois", "A1", "bad fill thresholds"), ("zones", "z", "polygon needs 3 points"),
                   ("planogram", "B9", "facing has no roi"), ("planogram", "B9", "missing expected_sales_per_hour")}


def test_read_dimensions_keeps_list_order(spark, tmp_path):
    for name in DIMENSIONS:
        (tmp_path / f"{name}.json").write_text("[]")
    (tmp_path / "zones.json").write_text(json.dumps([{"id": "b", "polygon": [[0, 0]], "extra": 1}, {"id": "a", "polygon": []}]))
    d = RD.read_dimensions(spark, str(tmp_path), "s")
    assert [(r.position, r.id) for r in d["zones"].orderBy("position").collect()] == [(0, "b"), (1, "a")]
    assert d["rois"].count() == 0


def test_both_truth_shapes_normalise(spark, tmp_path):
    a = {"clip": "a", "entries": [{"t": 1, "dir": "in"}, {"t": 2, "dir": "out"}], "occupancy": [[5, 2]],
         "stockouts": [{"facing": "A1", "t_start": 3, "t_end": 4}]}
    b = {"clip": "b", "entries": [{"t": 1}], "exits": [{"t": 9}, [11]], "occupancy": [{"t": 6, "count": 3}],
         "people": [{"gt_id": 1, "zones": [{"zone": "z", "t_enter": 0, "t_exit": 4}]}]}
    for n, d in (("a", a), ("b", b)):
        (tmp_path / f"{n}.json").write_text(json.dumps(d, indent=1))
    gt = RD.read_ground_truth(spark, str(tmp_path))
    assert sorted((r.clip, r.t, r.dir) for r in gt["entries"].collect()) == [
        ("a", 1.0, "in"), ("a", 2.0, "out"), ("b", 1.0, "in"), ("b", 9.0, "out"), ("b", 11.0, "out")]
    assert sorted((r.clip, r.t, r["count"]) for r in gt["occupancy"].collect()) == [("a", 5.0, 2), ("b", 6.0, 3)]
    assert [tuple(r) for r in gt["visits"].collect()] == [("b", 1, "z", 0.0, 4.0)]
    assert [(r.clip, r.facing) for r in gt["stockouts"].collect()] == [("a", "A1")]
    assert [tuple(r) for r in gt["missing"].collect()] == [("b", ["stockouts"])]


def test_report_files(spark, tmp_path):
    t = spark.createDataFrame([("r", 1)], "run_id string, n int")
    SK.write_report({"a": t}, t.agg(F.sum("n").alias("n")), str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "a")).first()["n"] == "1"
    assert spark.read.json(str(tmp_path / "summary")).first()["n"] == 1


def test_loading_twice_leaves_the_same_rows(spark, tmp_path):
    """Long lanes go to quarantine; a repeated load replaces its runs and leaves others alone."""
    rows = [(1.0, "s", "overhead", None, "occupancy", '{"count": 3}', "r1"), (2.0, "s", "overhead", None, "occupancy", '{"count": 4}', "r2"),
            (3.0, "s", "overhead", None, "lane_occ", json.dumps({"lane": 1, "cells": list(range(17))}), "r1"),
            (4.0, "s", "overhead", None, "lane_occ", json.dumps({"lane": 1, "cells": [1, 2]}), "r1")]
    events = spark.createDataFrame(rows, "t double, store_id string, stream string, zone_id string, event_type string, "
                                         "payload string, run_id string")
    base = str(tmp_path)
    SK.load_history(spark, events, base)
    SK.load_history(spark, events.where("run_id = 'r1'"), base)
    occ = SK.read_table(spark, base, "occupancy")
    assert sorted((r.run_id, r["count"]) for r in occ.collect()) == [("r1", 3), ("r2", 4)]
    assert [r.cells for r in SK.read_table(spark, base, "lane_occ").collect()] == [[1, 2] + [0] * 14]
    bad = spark.read.parquet(f"{base}/quarantine").collect()
    assert [(r.t, r.reason) for r in bad] == [(3.0, "more than 16 cells")]
    assert SK.read_table(spark, base, "run").count() == 2
