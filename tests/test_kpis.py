import pytest
from pyspark.sql import functions as F

from aislemetry.plans import dashboard as DB
from aislemetry.plans import kpis as K
from aislemetry.schema import TABLES


def table(spark, name, rows, extra=""):
    return spark.createDataFrame(rows, TABLES[name] + extra)


def test_dwell_percentiles(spark):
    v = table(spark, "visit", [("r", i, "a", 0.0, d, d) for i, d in enumerate((30.0, 10.0, 20.0))])
    for chunk in (None, 12.0):
        r = K.dwell_by_zone(v, chunk_s=chunk).first()
        assert (r.visits, r.median_dwell_s, r.p90_dwell_s) == (3, 20.0, 30.0)
    even = table(spark, "visit", [("r", i, "a", 0.0, float(i), float(i)) for i in range(1, 11)])
    r = K.dwell_by_zone(even, chunk_s=3.0).first()
    assert (r.median_dwell_s, r.p90_dwell_s) == (6.0, 9.0)
    assert K.dwell_by_zone(v, 1.0, 2.0, chunk_s=None).count() == 0


def test_heatmap_takes_the_largest_total(spark):
    h = table(spark, "heatmap", [("r", m, 1, 2, n) for m, n in ((5, 10), (6, 25), (7, 40))])
    assert K.heatmap(h).first()["count"] == 40
    assert K.heatmap(h, 300, 360).first()["count"] == 25


def test_published_heatmap_follows_the_clock(spark):
    c = spark.createDataFrame([("r", float(t), 1, 1) for t in range(0, 31)], "run_id string, t double, gx long, gy long")
    got = K.heatmap_accumulate(c, publish_s=10.0, chunk_s=None).collect()
    assert [(r.t_bucket, r["count"]) for r in got] == [(0, 31)]
    late = K.heatmap_accumulate(c.where("t < 30"), publish_s=10.0, chunk_s=None).collect()
    assert [r["count"] for r in late] == [21]


def test_live_heatmap_decays_from_the_frame_before(spark):
    c = spark.createDataFrame([("r", 0.0, 1, 1), ("r", 2.0, 1, 1)], "run_id string, t double, gx long, gy long")
    got = K.heatmap_live(c, chunk_s=None).first()["value"]
    assert got == round(0.98 ** 2 + 0.98 ** 2, 3)


def test_lost_revenue(spark):
    so = table(spark, "stockout", [("r", "A", "S", 0.0, 3600.0), ("r", "B", "S", 3600.0, None), ("r", "C", "X", 0.0, None)])
    plan = spark.createDataFrame([("S", 0, 1.0, 1.0), ("S", 1, 6.0, 10.0)],
                                 "sku string, position int, expected_sales_per_hour double, unit_price double")
    assert K.lost_revenue(so, plan, 7200.0).first()["lost_revenue"] == 120.0
    top = K.replenishment_list(so, plan, 5).orderBy("rank").collect()
    assert [(r.roi, r.revenue_rate) for r in top] == [("B", 60.0), ("C", 0.0)]
    recent = {r.facing: (r.status, r.lost) for r in K.recent_stockouts(so, plan, 7200.0).collect()}
    assert recent == {"A": ("resolved", 60.0), "B": ("active", 60.0), "C": ("active", 0.0)}


def test_shelf_latest_and_board(spark):
    f = table(spark, "shelf_fill", [("r", 1.0, "A1", 200.0, 0), ("r", 2.0, "A1", 150.0, 1), ("r", 1.0, "A2", 180.0, 2)],
              ", seq bigint")
    so = table(spark, "stockout", [("r", "A1", "S", 0.0, None), ("r", "A2", "S", 0.0, 1.0)])
    assert {r.roi: (r.fill, r.stockout) for r in K.shelf_latest(f, so).collect()} == {
        "A1": (150.0, True), "A2": (180.0, False)}
    assert {r.roi: r.state for r in K.shelf_board(f, so).collect()} == {"A1": "empty", "A2": "full"}


def test_run_window_of_an_empty_run_is_null(spark):
    runs = table(spark, "run", [("r", "s", 0.0, "c"), ("e", "s", 0.0, "c")])
    occ = table(spark, "occupancy", [("r", 50.0, 1)])
    trip = table(spark, "tripwire", [("r", 10.0, "in")])
    vis = table(spark, "visit", [("r", 1, "a", 5.0, 90.0, 85.0)])
    fill = table(spark, "shelf_fill", [])
    got = {r.run_id: (r.t0, r.t1) for r in K.run_window(runs, occ, trip, fill, vis).collect()}
    assert got == {"r": (10.0, 90.0), "e": (None, None)}


def test_queue_status_keeps_ties(spark):
    q = table(spark, "queue_estimate", [("r", 1.0, 1, 1.0, 5.0), ("r", 2.0, 1, 2.0, 6.0), ("r", 2.0, 1, 3.0, 7.0)])
    assert sorted(r["count"] for r in K.queue_status(q).collect()) == [2.0, 3.0]


def conversions(spark, t, **kw):
    v = table(spark, "visit", [("r", 1, "a", 100.0, 110.0, 10.0), ("r", 2, "a", 100.0, 104.0, 4.0)])
    x = table(spark, "pos_txn", [("r", t, 1, 1, 9.0, "a")])
    return [(r.track_id, r.converted, r.label) for r in K.classify_visits(v, x, chunk_s=None, **kw).collect()]


@pytest.mark.parametrize("t,hit", [(99.0, False), (100.0, True), (111.0, True), (1010.0, True), (1010.5, False)])
def test_conversion_window(spark, t, hit):
    assert conversions(spark, t) == [(1, hit, "engaged" if hit else "ignored")]


def test_conversion_by_shelf_reading(spark):
    m = spark.createDataFrame([("A1", "a")], "source string, zone string")
    f = table(spark, "shelf_fill", [("r", 111.0, "A1", 20.0, 0)], ", seq bigint")
    v = table(spark, "visit", [("r", 1, "a", 100.0, 110.0, 10.0)])
    assert K.convert_by_shelf(v, f, m, chunk_s=None).first()["converted"]
    assert not K.convert_by_shelf(v, f, m, drop=30.0, chunk_s=None).first()["converted"]


def test_footfall_day_hours_and_spark(spark):
    t0 = 1704067200.0
    trip = table(spark, "tripwire", [("r", t0 + 60, "in"), ("r", t0 + 3599, "in"), ("r", t0 + 3600, "out"),
                                     ("r", t0 + 7200, "in"), ("r", t0 + 90000, "in")])
    h = K.footfall_by_hour(trip, day=t0 + 5000)
    assert {r.hour: r.entries for r in h.collect()} == {0: 2, 2: 1}
    full = K.footfall_by_hour(trip, day=t0 + 5000, zero_fill=True)
    assert full.count() == 24 and full.agg(F.sum("entries")).first()[0] == 3
    assert [r.day for r in K.footfall_by_day(trip, 1).collect()] == [19724]
    w = spark.createDataFrame([("r", t0, t0 + 90000)], "run_id string, t0 double, t1 double")
    s = {r.bucket: r.entries for r in K.footfall_spark(trip, w).collect()}
    assert len(s) == 12 and s[0] == 3 and s[11] == 1


def test_rollup_totals(spark):
    runs = table(spark, "run", [("a", "s1", 0.0, "c"), ("b", "s1", 0.0, "c"), ("c", "s2", 0.0, "c")])
    trip = table(spark, "tripwire", [("a", 1.0, "in"), ("b", 1.0, "in"), ("c", 1.0, "out")])
    r = K.store_rollup(runs, trip, table(spark, "visit", []), table(spark, "pos_txn", []), table(spark, "stockout", []))
    got = {(x.store_id, x.run_id): (x.entries, x.exits) for x in r.collect()}
    assert got[("s1", None)] == (2, 0) and got[(None, None)] == (2, 1) and len(got) == 6


def test_wait_ignores_lane_unless_asked(spark):
    truth = spark.createDataFrame([("r", 10.0, 0, 1, 1, 50.0)],
                                  "clip string, t double, seq bigint, lane bigint, count bigint, actual_wait_s double")
    pred = table(spark, "queue_estimate", [("r", 9.0, 2, 1.0, 40.0, 0), ("r", 11.0, 1, 1.0, 60.0, 1),
                                           ("other", 10.0, 1, 1.0, 99.0, 2)], ", seq bigint")
    assert K.wait_pred_vs_actual(truth, pred, chunk_s=None).first()["error_s"] == -10.0
    assert K.wait_pred_vs_actual(truth, pred, by_lane=True, chunk_s=None).first()["error_s"] == 10.0


def test_zone_labels_are_clamped(spark):
    z = spark.createDataFrame([("z", [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]])], "id string, polygon array<array<double>>")
    r = K.zone_labels(z, (0.0, 32.0, 0.0, 24.0)).first()
    assert (r.name, r.left, r.top) == ("z", 6.3, 91.7)


def test_dashboard_of_one_run(spark):
    t = {n: table(spark, n, []) for n in ("occupancy", "tripwire", "visit", "heatmap", "stockout", "pos_txn")}
    t |= {"run": table(spark, "run", [("r", "s", 0.0, "c")]),
          "shelf_fill": table(spark, "shelf_fill", [], ", seq bigint"),
          "queue_estimate": table(spark, "queue_estimate", [], ", seq bigint"),
          "alert": table(spark, "alert", [], ", seq bigint"),
          "planogram": spark.createDataFrame([], "sku string, position int, expected_sales_per_hour double, unit_price double")}
    t["occupancy"] = table(spark, "occupancy", [("r", 5.0, 3, 0)], ", seq bigint")
    d = DB.dashboard(t, now=6.0, run_id="r")
    assert d["live"].first()["occupancy"] == 3
    assert [r.value for r in d["funnel"].orderBy("step").collect()] == [3, 0, 0, 0]
    assert d["footfall_spark"].count() == 12
    rows = {(r.tile, r.item, r.measure): r.value for r in DB.board(t, now=6.0, run_id="r").collect()}
    assert rows["live", "", "occupancy"] == 3 and rows["funnel", "Footfall", "value"] == 3 and rows["window", "", "t1"] == 5
    doc = DB.documents(t, now=6.0).first()
    assert doc.run_id == "r" and len(doc.footfall_spark) == 12 and doc.zones == [] and doc.live[0].measure == "occupancy"


def test_last_day_has_all_hours_of_every_run(spark):
    noon = 19723 * 86400.0 + 43200
    trip = table(spark, "tripwire", [("a", noon - 86400, "in"), ("a", noon, "in"), ("a", noon + 10, "in"), ("a", noon, "out"),
                                     ("c", noon, "in")])
    window = spark.createDataFrame([("a", noon - 86400, noon + 10), ("b", noon, noon), ("n", None, None)],
                                   "run_id string, t0 double, t1 double")
    rows = K.footfall_last_day(trip, window).collect()
    assert len(rows) == 72 and {(r.run_id, r.hour, r.entries) for r in rows if r.entries} == {("a", 12, 2)}
    shifted = K.footfall_last_day(trip, window, "Asia/Kolkata").where("entries > 0").collect()
    assert [(r.run_id, r.hour, r.entries) for r in shifted] == [("a", 17, 2)]


def test_shelf_board_names_items_of_the_store(spark):
    run = table(spark, "run", [("a", "s1", 0.0, "c"), ("b", "s2", 0.0, "c")])
    fill = spark.createDataFrame([("a", 1.0, "F1", 50.0, 0), ("b", 1.0, "F1", 120.0, 0), ("b", 1.0, "F9", 200.0, 0)],
                                 "run_id string, t double, roi string, fill double, seq bigint")
    plan = spark.createDataFrame([("s1", "F1", "tea", "Tea", 0), ("s2", "F1", "old", "Old", 1), ("s2", "F1", "rice", "Rice", 2)],
                                 "store_id string, facing string, sku string, name string, position int")
    got = {(r.run_id, r.roi): (r.fill, r.state, r.sku, r.name)
           for r in K.shelf_board(fill, table(spark, "stockout", []), run=run, planogram=plan).collect()}
    assert got == {("a", "F1"): (50, "empty", "tea", "Tea"), ("b", "F1"): (120, "partial", "rice", "Rice"),
                   ("b", "F9"): (200, "full", None, None)}
