import random

import pytest
from pyspark.sql import functions as F

from aislemetry.operators import asof
from aislemetry.operators.ordered import (First, LastValid, Next, NextValid, Prev, RunMax, RunMin, RunSum, Tail,
                                          WholeMax, WholeSum, chunk_seconds, ema, scan)
from aislemetry.operators.thinning import due_from, throttle

ROWS = None


def rows():
    rng = random.Random(1)
    return [(rng.choice("aab"), float(rng.randint(0, 400)), i, rng.choice([None, 1.0, 2.0, 3.0]))
            for i in range(300)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(rows(), "k string, t double, seq bigint, v double").cache()


def test_chunked_scan_equals_plain(df):
    v = F.col("v")
    specs = {"p": Prev(v), "n": Next(v), "lv": LastValid(v), "li": LastValid(v, True), "nv": NextValid(v),
             "ni": NextValid(v, True), "rs": RunSum(v), "re": RunSum(v, False), "mn": RunMin(v),
             "mx": RunMax(v, False), "wm": WholeMax(v), "ws": WholeSum(v), "f": First(v), "tl": Tail(v, 5)}
    plain = scan(df, ["k"], ["t", "seq"], specs)
    want = sorted(map(repr, plain.collect()))
    for chunk in (9.0, 70.0):
        got = scan(df, ["k"], ["t", "seq"], specs, chunk).select(*plain.columns)
        assert sorted(map(repr, got.collect())) == want


def test_chunk_seconds_bounds_every_chunk(df):
    assert chunk_seconds(df, ["k"], target=1000) is None
    s = chunk_seconds(df, ["k"], target=20)
    worst = df.groupBy("k", F.floor(F.col("t") / s)).count().agg(F.max("count")).first()[0]
    assert worst <= 20


@pytest.fixture(params=[1, 2, 7])
def ranges(spark, request):
    """Rows lie in that many ranges, so keys are cut anywhere."""
    wanted = {"spark.sql.shuffle.partitions": str(request.param), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("period,strict", [(3.0, False), (17.0, True), (150.0, False), (0.0, True), (0.0, False), (0.1, False)])
def test_throttle_matches_a_loop(spark, df, ranges, period, strict):
    want = []
    for k in "ab":
        last = float("-inf")
        for _, t, s, _ in sorted((r for r in rows() if r[0] == k), key=lambda r: (r[1], r[2])):
            if t - last > period or (t - last == period and not strict):
                want.append(s)
                last = t
    got = throttle(df.drop("v"), ["k"], ["t", "seq"], period, strict)
    assert sorted(r.seq for r in got.collect()) == sorted(want)


def looped(times, period):
    kept, last = [], float("-inf")
    for t in times:
        if t - last >= period:
            kept.append(t)
            last = t
    return kept


def test_throttle_spreads_one_hot_key(spark, ranges):
    """A key of 200,000 rows, dense and sparse by turns, with ties across every cut."""
    rng = random.Random(4)
    times = sorted([rng.uniform(0, 100.0) for _ in range(60_000)] + [float(rng.randint(5_000, 5_040)) for _ in range(100_000)]
                   + [rng.uniform(0, 400_000.0) for _ in range(39_997)] + [1e6, 1e6, 1e6])
    d = spark.createDataFrame([(t, i) for i, t in enumerate(times)], "t double, seq bigint").repartition(4)
    for period in (0.004, 33.0, 3600.0):
        got = throttle(d, [], ["t", "seq"], period)
        first = {}
        for i, t in enumerate(times):
            first.setdefault(t, i)
        want = looped(times, period)
        assert sorted(map(tuple, got.collect())) == [(t, first[t]) for t in want]


def test_throttle_of_odd_rows(spark, ranges):
    """Null and NaN times, null keys, repeated rows, a period per key, an empty table."""
    data = [("a", 1.0, 1, 2.0), ("a", 1.0, 1, 2.0), ("a", None, 2, 2.0), ("a", float("nan"), 3, 2.0), ("a", 3.0, 4, 2.0),
            (None, 1.0, 5, 4.0), (None, 4.0, 6, 4.0), (None, 5.0, 7, 4.0), ("b", float("-1e300"), 8, 1.0), ("b", 0.1, 9, 1.0)]
    d = spark.createDataFrame(data, "k string, t double, seq bigint, p double")
    got = throttle(d, ["k"], ["t", "seq"], "p")
    assert sorted((r.k or "", r.seq) for r in got.collect()) == [("", 5), ("", 7), ("a", 1), ("a", 4), ("b", 8), ("b", 9)]
    assert got.columns == d.columns and throttle(d.limit(0), ["k"], ["t"], 1.0).collect() == []


def test_due_times_are_exact():
    import numpy as np
    rng = random.Random(6)
    for _ in range(3000):
        t = rng.choice([rng.uniform(-5, 5), 1.7e9 + rng.random(), -1e-12, 0.0, 1e17])
        p = rng.choice([0.1, 0.3, 1e-9, 21600.0, rng.random(), 3.3])
        for strict in (False, True):
            u = float(due_from(t, p, strict))
            below = float(np.nextafter(u, -np.inf))
            assert (u - t > p) if strict else (u - t >= p)
            assert below <= t or not ((below - t > p) if strict else (below - t >= p))


@pytest.mark.parametrize("chunk", [None, 25.0])
def test_ema_matches_a_loop(df, chunk):
    want, state = {}, {}
    for k, t, s, v in sorted(rows(), key=lambda r: (r[1], r[2])):
        x = v or 0.0
        state[k] = x if k not in state else 0.3 * x + 0.7 * state[k]
        want[s] = state[k]
    got = ema(df.fillna(0.0), ["k"], ["t", "seq"], "v", 0.3, "e", chunk)
    assert all(abs(r.e - want[r.seq]) < 1e-12 for r in got.collect())


def test_ema_of_a_constant_is_exact_across_chunks(spark):
    d = spark.range(200).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("t"),
                                F.col("id").alias("seq"), F.lit(60.0).alias("v"))
    e = ema(d, ["k"], ["t", "seq"], "v", 0.35, "e", 10.0, blend_first=True)
    assert {r.e for r in e.collect()} == {60.0}


@pytest.mark.parametrize("chunk", [None, 13.0])
def test_nearest_prefers_the_earlier_on_ties(spark, chunk):
    rng = random.Random(2)
    left = [(float(rng.randint(0, 300)), i) for i in range(60)]
    right = [(float(rng.randint(0, 300)), i) for i in range(20)]
    order = sorted(right)
    want = {i: min(order, key=lambda p: abs(p[0] - t))[1] for t, i in left}
    got = asof.nearest(spark.createDataFrame(left, "t double, i int"),
                       spark.createDataFrame(right, "t double, j int"), [], right_seq="j", chunk_s=chunk)
    assert {r.i: r.near.j for r in got.collect()} == want


def test_exists_within_closed_interval(spark):
    left = spark.createDataFrame([("z", 0.0, 10.0, 1), ("z", 10.0, 10.0, 2), ("z", 10.5, 12.0, 3), ("y", 0.0, 99.0, 4)],
                                 "zone string, lo double, hi double, id int")
    right = spark.createDataFrame([("z", 10.0), ("z", 10.0), ("x", 11.0)], "zone string, t double")
    got = asof.exists_within(left, right, ["zone"], "lo", "hi", chunk_s=None)
    assert {r.id: r.hit for r in got.collect()} == {1: True, 2: True, 3: False, 4: False}


def test_overlap_matches_equals_brute_force(spark):
    rng = random.Random(3)

    def make(n):
        out = []
        for i in range(n):
            a = rng.uniform(0, 200)
            out.append(("c", i, a, a + rng.choice([0.0, 0.3, 3.0, 20.0, 90.0]) * rng.uniform(0.5, 1.5)))
        return out
    labels, seen = make(60), make(60)
    want = set()
    for _, i, a, b in labels:
        for _, j, c, d in seen:
            un = max(b, d) - min(a, c)
            if un > 0 and max(0.0, min(b, d) - max(a, c)) / un >= 0.5:
                want.add((i, j))
    got = asof.overlap_matches(
        spark.createDataFrame(labels, "clip string, label_id int, t_enter double, t_exit double"),
        spark.createDataFrame(seen, "clip string, seq int, t_enter double, t_exit double"), ["clip"])
    pairs = [(r.label_id, r.d_seq) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_null_keys_survive_chunks(spark):
    """A NULL key is a key of its own in every form, whatever the chunk length."""
    data = [(None if i % 3 == 0 else "a", float(i), i, float(i % 7)) for i in range(60)]
    d = spark.createDataFrame(data, "k string, t double, seq bigint, v double")

    def loop(step):
        state, out = {}, {}
        for k, t, s, x in data:
            state[k], out[s] = step(state.get(k), t, x)
        return out

    for chunk in (None, 7.0, 25.0):
        n = scan(d, ["k"], ["t", "seq"], {"n": RunSum(F.lit(1))}, chunk)
        assert {r.seq: r.n for r in n.collect()} == loop(lambda s, t, x: ((s or 0) + 1, (s or 0) + 1))
        e = {r.seq: r.e for r in ema(d, ["k"], ["t", "seq"], "v", 0.3, "e", chunk).collect()}
        assert e == pytest.approx(loop(lambda s, t, x: (x if s is None else 0.3 * x + 0.7 * s,) * 2))
        kept = loop(lambda s, t, x: (t, True) if s is None or t - s >= 5 else (s, False))
        got = throttle(d, ["k"], ["t", "seq"], 5.0)
        assert sorted(r.seq for r in got.collect()) == [s for s, yes in kept.items() if yes]


@pytest.mark.parametrize("chunk", [None, 3.0])
def test_ranks_of_equal_values(spark, chunk):
    """One value that nearly every row has is one weighted row; medians are those of the sorted list."""
    from aislemetry.plans import kpis as K
    from aislemetry.plans import scoring as SC
    rng = random.Random(9)
    values = {z: [5.0] * 400 + [float(rng.randint(0, 9)) for _ in range(99)] for z in ("a", None)}
    visit = spark.createDataFrame([("r", z, v, 0.0) for z, vs in values.items() for v in vs],
                                  "run_id string, zone string, dwell_s double, t_enter double")
    for r in K.dwell_by_zone(visit, chunk_s=chunk).collect():
        d = sorted(values[r.zone])
        assert (r.visits, r.median_dwell_s, r.p90_dwell_s) == (len(d), d[len(d) // 2], d[-(-len(d) * 9 // 10) - 1])
    timed = visit.select(F.col("zone").alias("label"), F.col("dwell_s").alias("ms"))
    for r in SC.timing_stats(timed, chunk_s=chunk).collect():
        d = sorted(values[r.label])
        at = (len(d) - 1) * 0.95
        want = d[int(at)] + (d[int(at) + 1] - d[int(at)]) * (at - int(at))
        assert (r.frames, r.mean_ms) == (len(d), sum(d) / len(d)) and abs(r.p95_ms - want) < 1e-9
