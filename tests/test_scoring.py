import random

from aislemetry.plans import scoring as SC

TRIP = "clip string, t double, dir string"
OCC = "clip string, t double, seq bigint, count bigint"
VIS = "clip string, seq bigint, zone string, t_enter double, t_exit double"
LAB = "clip string, label_id bigint, zone string, t_enter double, t_exit double"
GTS = "clip string, pos bigint, facing string, t_start double"
STA = "clip string, seq bigint, facing string, t double"
EST = "clip string, lane bigint, t double, seq bigint, count double, pred_wait_s double"
TRU = "clip string, lane bigint, t double, count bigint, actual_wait_s double"


def test_evaluate_run(spark):
    d = spark.createDataFrame
    gt = {"entries": d([("c", 1.0, "in"), ("c", 2.0, "in"), ("c", 3.0, "out")], TRIP),
          "occupancy": d([("c", 5.0, 2)], "clip string, t double, count bigint"),
          "visits": d([("c", 1, "a", 0.0, 10.0)], LAB), "stockouts": d([("c", 0, "A", 100.0)], GTS)}
    r = SC.evaluate_run(d([("c", 1.0, "in"), ("c", 2.0, "in"), ("c", 3.0, "out")], TRIP),
                        d([("c", 4.0, 0, 3), ("c", 6.0, 1, 9)], OCC),
                        d([("c", 0, "a", 0.0, 6.0), ("c", 1, "a", 4.5, 10.0), ("c", 2, "b", 0.0, 10.0)], VIS),
                        d([("c", 0, "A", 109.0), ("c", 1, "A", 300.0)], STA), gt, chunk_s=None).first()
    assert (r.entry_count_error, r.exit_count_error, r.occupancy_mae) == (0.0, 0.0, 1.0)
    assert (r.stockout_recall, r.stockout_false_alarms) == (1.0, 1)
    assert (r.dwell_mae, r.id_switches, r.visits_detected, r.visits_matched) == (4.0, 1, 3, 1)
    assert r.passes


def test_missing_labels_are_null_and_fail(spark):
    d = spark.createDataFrame
    gt = {"entries": d([], TRIP), "occupancy": d([], "clip string, t double, count bigint"), "visits": d([], LAB),
          "stockouts": d([], GTS)}
    r = SC.evaluate_run(d([("c", 1.0, "in")], TRIP), d([("c", 4.0, 0, 3)], OCC), d([], VIS), d([], STA), gt, chunk_s=None).first()
    assert r.entry_count_error is None and r.occupancy_mae is None and r.stockout_recall is None and not r.passes


def test_stockout_matching_is_greedy_in_list_order(spark):
    rng = random.Random(11)
    labels = [("c", i, rng.choice("AB"), float(rng.randint(0, 60))) for i in range(25)]
    starts = [("c", i, rng.choice("AB"), float(rng.randint(0, 60))) for i in range(25)]
    used, want = set(), set()
    for _, p, f, t in labels:
        for _, s, g, u in starts:
            if s not in used and f == g and abs(t - u) <= 10:
                used.add(s)
                want.add((p, s))
                break
    got = SC.match_stockouts(spark.createDataFrame(labels, GTS), spark.createDataFrame(starts, STA))
    assert {(r.pos, r.seq) for r in got.collect()} == want


def test_evaluate_queue_takes_the_nearest_then_the_first(spark):
    est = spark.createDataFrame([("c", 1, 9.0, 0, 0.0, 10.0), ("c", 1, 11.0, 1, 5.0, 50.0), ("c", 2, 10.0, 2, 9.0, 90.0)], EST)
    r = SC.evaluate_queue(spark.createDataFrame([("c", 1, 10.0, 0, 10.0), ("c", 1, 99.0, 0, 0.0)], TRU), est, chunk_s=None).first()
    assert (r.n, r.count_mae, r.wait_mae, r.count_pass) == (1, 0.0, 0.0, True)
    none = SC.evaluate_queue(spark.createDataFrame([("c", 3, 10.0, 0, 1.0)], TRU), est, chunk_s=None).first()
    assert (none.n, none.count_mae, none.count_pass) == (0, None, False)


def test_summary_skips_missing_metrics(spark):
    m = spark.createDataFrame([("a", 1.0, None, True), ("b", 3.0, None, True)],
                              "clip string, dwell_mae double, occupancy_mae double, passes boolean")
    got = {r.metric: (r.mean, r.n_clips, r.all_passed) for r in SC.summarise_clips(m).collect()}
    assert got == {"dwell_mae": (2.0, 2, True), "occupancy_mae": (None, 2, True)}


def test_timing_percentile_is_linear(spark):
    d = spark.createDataFrame([("x", float(v)) for v in range(1, 21)], "label string, ms double")
    for chunk in (None, 4.0):
        r = SC.timing_stats(d, chunk_s=chunk).first()
        assert (r.frames, r.mean_ms, round(r.p95_ms, 9), round(r.fps, 6)) == (20, 10.5, 19.05, round(20000 / 210, 6))
