import random

import pytest
from pyspark.sql import functions as F

from aislemetry.operators import sequence as S
from aislemetry.streaming import folds

OBS = "run_id string, track_id bigint, t double, seq bigint, zone string"


def observe(spark, zones, step=0.5):
    return spark.createDataFrame([("r", 1, i * step, i, z) for i, z in enumerate(zones)], OBS)


def visit_rows(df):
    return sorted((r.zone, r.t_enter, r.t_exit) for r in df.collect())


def model_visits(rows, debounce, least):
    step, finish = folds.visit_step(debounce, least)
    state, out = (None, 0.0, None, 0.0, False, 0.0), []
    for r in rows:
        state, o = step(state, r)
        out += o
    out += finish(state)
    return sorted((o["zone"], o["t_enter"], o["t_exit"]) for o in out)


def test_exit_is_first_sight_elsewhere(spark):
    v = S.visits(observe(spark, ["aisle"] * 12 + ["checkout"] * 9), chunk_s=None)
    assert visit_rows(v) == [("aisle", 0.0, 6.0), ("checkout", 6.0, 10.0)]


def test_boundary_wobble_is_one_visit(spark):
    zones = ["aisle"] * 6 + ["checkout", "aisle"] * 10 + ["aisle"] * 4
    v = S.visits(observe(spark, zones), chunk_s=None)
    assert visit_rows(v) == [("aisle", 0.0, 14.5)]


def test_floor_outside_zones_ends_a_visit_and_short_ones_drop(spark):
    v = S.visits(observe(spark, ["a"] * 8 + [None] * 6 + ["b"] * 3), chunk_s=None)
    assert visit_rows(v) == [("a", 0.0, 4.0)]


def test_deleted_track_sets_the_end(spark):
    end = spark.createDataFrame([("r", 1, 9.0)], "run_id string, track_id bigint, t_end double")
    v = S.visits(observe(spark, ["a"] * 8), track_end=end, chunk_s=None)
    assert visit_rows(v) == [("a", 0.0, 9.0)]


@pytest.mark.parametrize("chunk", [None, 7.0])
def test_visits_equal_the_sequential_model(spark, chunk):
    rng = random.Random(4)
    rows, zone = [], None
    for i in range(400):
        if rng.random() < 0.35:
            zone = rng.choice(["a", "b", None])
        rows.append({"t": i * 0.5, "seq": i, "zone": zone})
    df = spark.createDataFrame([("r", 1, r["t"], r["seq"], r["zone"]) for r in rows], OBS)
    assert visit_rows(S.visits(df, 1.0, 2.0, chunk_s=chunk)) == model_visits(rows, 1.0, 2.0)


@pytest.mark.parametrize("chunk", [None, 15.0])
def test_crossings_equal_the_sequential_model(spark, chunk):
    rng = random.Random(5)
    wires = [("door", "overhead", [10.0, 50.0], [90.0, 50.0], "up"), ("side", "overhead", [50.0, 0.0], [50.0, 99.0], "right")]
    pts, u, v = [], 50.0, 30.0
    for i in range(300):
        u, v = min(99.0, max(0.0, u + rng.uniform(-25, 25))), min(99.0, max(0.0, v + rng.uniform(-25, 25)))
        pts.append(("r", "overhead", 1, i * 0.7, i, u, v))
    want = []
    for w in wires:
        step, state = folds.crossing_step(12.0, 2.0), (None, None, None, None)
        for p in pts:
            state, out = step(state, {"t": p[3], "seq": p[4], "u": p[5], "v": p[6], "q1": w[2], "q2": w[3], "in_dir": w[4]})
            want += [(w[0], o["seq"], o["dir"]) for o in out]
    got = S.crossings(
        spark.createDataFrame(pts, "run_id string, stream string, track_id bigint, t double, seq bigint, u double, v double"),
        spark.createDataFrame(wires, "wire_id string, stream string, q1 array<double>, q2 array<double>, in_dir string"),
        chunk_s=chunk)
    assert sorted((r.wire_id, r.seq, r.dir) for r in got.collect()) == sorted(want) and len(want) > 10


def walk(spark, vs, **extra):
    rows = [("r", "overhead", 1, float(i), i, 100.0, float(v)) for i, v in enumerate(vs)]
    p = spark.createDataFrame(rows, "run_id string, stream string, track_id bigint, t double, seq bigint, u double, v double")
    w = spark.createDataFrame([("door", "overhead", [40.0, 460.0], [240.0, 460.0], "up")],
                              "wire_id string, stream string, q1 array<double>, q2 array<double>, in_dir string")
    return [(r.t, r.dir) for r in S.crossings(p, w, chunk_s=None, **extra).collect()]


def test_crossing_from_inside_the_band_and_band_edge(spark):
    assert walk(spark, [464, 456, 448]) == [(2.0, "in")]
    assert walk(spark, [464, 456, 449]) == []
    assert walk(spark, [430, 480]) == [(1.0, "out")]


def stock_events(spark, kinds):
    return spark.createDataFrame([("r", "A1", "S", float(i), i, k) for i, k in enumerate(kinds)],
                                 "run_id string, roi string, sku string, t double, seq bigint, kind string")


def test_stockouts_close_the_latest_open_start(spark):
    kinds = ["end", "start", "start", "end", "start", "end", "end", "end", "start"]
    got = sorted((r.t_start, r.t_end) for r in S.close_stockouts(stock_events(spark, kinds), chunk_s=None).collect())
    assert got == [(1.0, 6.0), (2.0, 3.0), (4.0, 5.0), (8.0, None)]


@pytest.mark.parametrize("chunk", [None, 9.0])
def test_stockout_pairing_equals_a_stack(spark, chunk):
    rng = random.Random(6)
    kinds = [rng.choice(["start", "end"]) for _ in range(200)]
    stack, want = [], {}
    for i, k in enumerate(kinds):
        if k == "start":
            stack.append(i)
            want[float(i)] = None
        elif stack:
            want[float(stack.pop())] = float(i)
    got = {r.t_start: r.t_end for r in S.close_stockouts(stock_events(spark, kinds), chunk_s=chunk).collect()}
    assert got == want


def test_one_incident_alternates(spark):
    got = S.one_incident(stock_events(spark, ["end", "start", "start", "end", "end", "start"]), chunk_s=None)
    assert [r.t for r in got.orderBy("t").collect()] == [1.0, 3.0, 5.0]


def fills(spark, values):
    return spark.createDataFrame([("r", "A1", float(i), i, float(v)) for i, v in enumerate(values)],
                                 "run_id string, roi string, t double, seq bigint, fill double")


def test_fill_status_needs_a_majority(spark):
    got = S.fill_status(fills(spark, [200, 200, 200, 0, 0, 0, 0, 0, 0]), chunk_s=None).orderBy("t").collect()
    smooth, want = [], 200.0
    for i, x in enumerate([200, 200, 200, 0, 0, 0, 0, 0, 0]):
        want = 0.35 * x + 0.65 * want
        smooth.append(round(want, 1))
    assert [r.smoothed_fill for r in got] == smooth
    assert got[0].status == "normal" and got[0].confidence == 1.0
    seen, current, want = [], "normal", []
    for x in smooth:
        seen = (seen + ["empty" if x <= 60 else "low" if x <= 110 else "normal"])[-5:]
        for name in ("normal", "low", "empty"):
            if seen.count(name) >= len(seen) // 2 + 1:
                current = name
        want.append(current)
    assert [r.status for r in got] == want and want[-1] == "empty"


def test_threshold_is_inclusive(spark):
    assert {r.status for r in S.fill_status(fills(spark, [60] * 4), chunk_s=None).collect()} == {"empty"}
    assert {r.status for r in S.fill_status(fills(spark, [110] * 4), chunk_s=None).collect()} == {"low"}


def status(spark, names):
    return spark.createDataFrame([("r", "A1", float(i), i, s) for i, s in enumerate(names)],
                                 "run_id string, roi string, t double, seq bigint, status string")


def test_low_alert_is_latched_until_normal(spark):
    names = ["low", "low", "empty", "low", "empty", "normal", "low"]
    got = S.shelf_incidents(status(spark, names), chunk_s=None)
    assert sorted((r.t, r.kind) for r in got.collect()) == [
        (0.0, "alert_low"), (2.0, "alert_out"), (2.0, "start"), (3.0, "end"), (4.0, "alert_out"), (4.0, "start"),
        (5.0, "end"), (6.0, "alert_low")]


def test_violation_repeats_only_after_a_change(spark):
    got = S.planogram_violations(status(spark, ["low", "low", "empty", "empty", "normal", "empty", "low"]), chunk_s=None)
    assert sorted((r.t, r.observed) for r in got.collect()) == [
        (0.0, "low"), (2.0, "empty"), (5.0, "empty"), (6.0, "low")]


def test_wrong_item_is_unknown(spark):
    st = status(spark, ["normal", "normal"]).withColumn("sku", F.when(F.col("t") == 1, "X").otherwise("S"))
    plan = spark.createDataFrame([("A1", "S")], "roi string, sku string")
    assert [(r.t, r.observed) for r in S.planogram_violations(st, plan, chunk_s=None).collect()] == [(1.0, "unknown")]


@pytest.mark.parametrize("chunk", [None, 20.0])
def test_inventory_equals_the_sequential_model(spark, chunk):
    rng = random.Random(7)
    names = []
    for s, n in (("normal", 20), ("low", 30), ("normal", 5), ("empty", 40), ("normal", 20)):
        names += [s if rng.random() < 0.95 else "normal" for _ in range(n)]
    stock = spark.createDataFrame([("A1", 10, None, 2.5)], "roi string, initial_stock int, low_threshold int, unit_price double")
    got = S.inventory(status(spark, names), stock, chunk_s=chunk)
    step, state, want = folds.inventory_step(), (None, None), []
    for i, s in enumerate(names):
        state, out = step(state, {"t": float(i), "seq": i, "status": s, "initial_stock": 10, "threshold": 3})
        want += [(o["t"], o["removed"], o["remaining"], o["rule"]) for o in out]
    assert sorted((r.t, r.removed, r.remaining, r.rule) for r in got.collect()) == want and len(want) == 2


def test_removals_rewrite_the_window():
    step, state = folds.inventory_step(), (None, None)
    row = {"seq": 0, "initial_stock": 2, "threshold": 1, "status": "normal"}
    state, out = step(state, {**row, "t": 0.0, "removal": 1})
    assert out[0]["remaining"] == 1 and out[0]["rule"] == "low_stock_detected"
    state, out = step(state, {**row, "t": 1.0, "removal": 5})
    assert out[0]["removed"] == 1 and out[0]["rule"] == "stockout_detected"
    assert step(state, {**row, "t": 2.0, "removal": 1})[1] == []


def test_cooldown_is_per_store_and_rule(spark):
    so = spark.createDataFrame([("s", "A", 0.0, 0, "start"), ("s", "B", 30.0, 1, "start"), ("s", "A", 60.0, 2, "end"),
                                ("s", "A", 61.0, 3, "start"), ("s", "A", 400.0, 4, "end"), ("t", "A", 30.0, 5, "start")],
                               "store_id string, roi string, t double, seq bigint, kind string")
    q = spark.createDataFrame([("s", 1, 0.0, 0, 181.0), ("s", 2, 59.0, 1, 500.0), ("s", 1, 60.0, 2, 180.0)],
                              "store_id string, lane bigint, t double, seq bigint, pred_wait_s double")
    o = spark.createDataFrame([("s", 0.0, 0, 50), ("s", 1.0, 1, 51)], "store_id string, t double, seq bigint, count bigint")
    got = S.alerts_from_events(so, q, o, chunk_s=None).collect()
    assert sorted((r.store_id, r.rule, r.t) for r in got) == [
        ("s", "occupancy_over", 1.0), ("s", "stockout", 0.0), ("s", "stockout", 61.0), ("s", "stockout_long", 400.0),
        ("s", "wait_over", 0.0), ("t", "stockout", 30.0)]
    assert {r.message for r in got if r.rule == "stockout_long"} == {"A empty for 339s"}
    assert {r.message for r in got if r.rule == "wait_over"} == {"lane 1 predicted wait 181s > 180.0s"}


@pytest.mark.parametrize("chunk", [None, 50.0])
def test_arrival_rate_equals_a_loop(spark, chunk):
    rng = random.Random(8)
    ent = [("r", float(rng.randint(0, 900))) for _ in range(60)]
    pro = [("r", float(t), t) for t in range(0, 1000, 37)] + [("r", 300.0, 5000)]
    got = S.arrival_rate(spark.createDataFrame(ent, "run_id string, t double"),
                         spark.createDataFrame(pro, "run_id string, t double, seq bigint"), chunk_s=chunk)
    for r in got.collect():
        inside = [t for _, t in ent if r.t - 300 < t <= r.t]
        rate = len(inside) / max(r.t - min(inside), 1.0) if inside else 0.0
        assert r.arrivals == len(inside) and abs(r.lambda_per_s - rate) < 1e-12


def test_holt_constant_and_single(spark):
    s = spark.createDataFrame([("a", i, 5.0) for i in range(6)] + [("b", 0, 7.0)], "run_id string, bucket int, value double")
    got = {r.run_id: (r.level, r.trend, r.forecast) for r in S.holt(s).collect()}
    assert got["a"] == pytest.approx((5.0, 0.0, 5.0)) and got["b"] == (7.0, 0.0, 7.0)


def test_reach_needs_three_frames_and_cooldown(spark):
    on = [1, 1, 1, 0, 1, 1, 0, 1, 1, 1, 0, 1, 1, 1, 1, 0]
    m = spark.createDataFrame([("r", "A1", i * 0.25, i, 0.5 if a else 0.0, 200) for i, a in enumerate(on)],
                              "run_id string, roi string, t double, seq bigint, ratio double, peak int")
    assert sorted(r.seq for r in S.reach_events(m, chunk_s=None).collect()) == [3, 10]


def test_queue_estimate_pads_and_smooths(spark):
    lanes = spark.createDataFrame([("r", 1, 0.0, 0, [50, 50, 0]), ("r", 1, 1.0, 1, [0, 0, 0])],
                                  "run_id string, lane bigint, t double, seq bigint, cells array<bigint>")
    got = S.queue_estimates(lanes, chunk_s=None).orderBy("t").collect()
    assert [(r.count, r.pred_wait_s) for r in [tuple_of(x) for x in got]] == [(1.6, 72.0), (1.12, 50.4)]


class tuple_of:
    def __init__(self, row):
        self.count, self.pred_wait_s = row["count"], row["pred_wait_s"]


@pytest.mark.parametrize("alpha,beta", [(0.3, 0.1), (0.5, 0.9), (0.9, 0.01), (0.19, 0.0)])
def test_holt_folds_every_value(spark, alpha, beta):
    rng = random.Random(21)
    values = [rng.uniform(0, 50) for _ in range(700)]
    level, trend = values[0], values[1] - values[0]
    for x in values[1:]:
        before, level = level, alpha * x + (1 - alpha) * (level + trend)
        trend = beta * (level - before) + (1 - beta) * trend
    s = spark.createDataFrame([(None, i, x) for i, x in enumerate(values)], "run_id string, bucket int, value double")
    for chunk in (None, 50.0):
        r = S.holt(s, alpha=alpha, beta=beta, chunk_s=chunk).first()
        assert (r.level, r.trend) == pytest.approx((level, trend), abs=1e-9)


def test_inventory_with_removals(spark):
    """Picks lower the stock at once, readings only later; both together match the streamed step."""
    from aislemetry.streaming.folds import inventory_step
    rng = random.Random(17)
    names = [s if rng.random() < 0.95 else "normal" for s, n in (("normal", 20), ("low", 30), ("empty", 40)) for _ in range(n)]
    picks = {5: 2, 6: 1, 50: 99, 51: 1}
    status = spark.createDataFrame([(r, "A1", float(i), i, s) for r in ("r", None) for i, s in enumerate(names) if i not in picks],
                                   "run_id string, roi string, t double, seq bigint, status string")
    removals = spark.createDataFrame([(r, "A1", float(i), i, q) for r in ("r", None) for i, q in picks.items()],
                                     "run_id string, roi string, t double, seq bigint, quantity int")
    stock = spark.createDataFrame([("A1", 10, 3, 2.0)], "roi string, initial_stock int, low_threshold int, unit_price double")
    step, state, want = inventory_step(), (None, None), []
    for i, s in enumerate(names):
        row = {"t": float(i), "seq": i, "initial_stock": 10, "threshold": 3,
               "status": None if i in picks else s, "removal": picks.get(i)}
        state, out = step(state, row)
        want += [(i, o["removed"], o["remaining"], o["removed"] * 2.0, o["rule"]) for o in out]
    got = S.inventory_with_removals(status, removals, stock)
    for r in ("r", None):
        mine = sorted((x.seq, x.removed, x.remaining, x.revenue, x.rule) for x in got.collect() if x.run_id == r)
        assert mine == want and mine[0][:3] == (5, 2, 8) and mine[-1][2] == 0
    assert {x.seq for x in S.inventory_incidents(got).collect()} == {want[-1][0]}
