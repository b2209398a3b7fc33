"""Operators on inputs whose keys, pairs or files outgrow one task: small rows, tight limits."""
import random

import pytest
from pyspark.sql import functions as F

from aislemetry.operators import asof
from aislemetry.operators.ordered import scan


@pytest.mark.parametrize("tile", [3, 1000])
def test_best_overlaps_equal_brute_force(spark, monkeypatch, tile):
    """Counts and best matches over tiles of any size; ties go to the least seq, a label id may repeat."""
    monkeypatch.setattr(asof, "TILE_LABELS", tile)
    monkeypatch.setattr(asof, "TILE_VISITS", tile + 1)
    monkeypatch.setattr(asof, "CELLS", 4 * tile)
    rng = random.Random(5)

    def make(n):
        out = []
        for i in range(n):
            a = float(rng.randint(0, 60))
            out.append((rng.choice(["x", "x", "y", None]), i, a, a + rng.choice([-3.0, 0.0, 0.5, 4.0, 9.0, 30.0, 31.0])))
        return [*out, *[("x", n, 1.0, None), ("x", n + 1, None, 5.0)]]

    labels, seen = [(z, i // 2, a, b) for z, i, a, b in make(80)], make(80)
    want = {}
    for z, i, a, b in labels:
        for y, j, c, d in seen:
            if z is None or z != y or None in (a, b, c, d) or not max(b, d) > min(a, c):
                continue
            both = max(0.0, min(b, d) - max(a, c))
            if both / (max(b, d) - min(a, c)) >= 0.5:
                want.setdefault(i, []).append((-both, (c, j), d))
    got = asof.overlap_best(
        spark.createDataFrame(labels, "zone string, label_id int, t_enter double, t_exit double"),
        spark.createDataFrame([(z, a, b, (a, j)) for z, j, a, b in seen],
                              "zone string, t_enter double, t_exit double, seq struct<a:double,j:int>"),
        ["zone"], ["label_id"]).collect()
    assert len(got) == len(want) > 20 and any(len(w) > 4 for w in want.values())
    for r in got:
        best = min(want[r.label_id])
        assert (r.matches, -r.overlap_s, tuple(r.d_seq), r.d_exit) == (len(want[r.label_id]), *best)


def test_sparse_keys_are_not_cut(spark):
    """Many small keys are one chunk each, a key that outgrows a task is cut; one at a single instant ends the search."""
    from aislemetry.operators.ordered import resolve
    conf = {"spark.aislemetry.chunk.bytes": "0", "spark.aislemetry.chunk.rows": "50"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        sparse = spark.range(2000).select((F.col("id") % 100).alias("k"), (F.col("id") * 9000.0).alias("t"))
        assert resolve("auto", sparse, ["k"]) is None
        dense = sparse.withColumn("k", F.lit("a"))
        slot = resolve("auto", dense, ["k"])
        assert dense.groupBy(F.floor(F.col("t") / slot)).count().agg(F.max("count")).first()[0] <= 50 < slot
        assert resolve("auto", dense.withColumn("t", F.lit(5.0)), ["k"]) < 1e-3
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_facts_of_a_run_are_dealt_over_tasks(spark):
    """Facts that meet a table of runs keep their rows, unknown and null runs too, and no run is one partition."""
    from aislemetry.schema import with_run
    facts = spark.range(400).select(F.when(F.col("id") % 8 == 0, None).otherwise(F.concat(
        F.lit("r"), F.lit(F.col("id") % 2))).alias("run_id"), "id")
    runs = spark.createDataFrame([("r0", 5.0), ("x", 6.0)], "run_id string, now double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = with_run(facts, runs).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(r.id for r in got) == list(range(400))
    assert all(r.now == (5.0 if r.run_id == "r0" else None) for r in got)
    assert len({r.part for r in got if r.run_id == "r0"}) > 1


def test_points_of_a_stream_meet_its_wires_in_several_tasks(spark, monkeypatch):
    """Points of one stream keep their rows when they meet its wires, in batch and stream, and are not one partition."""
    from aislemetry.operators import sequence
    from aislemetry.streaming import folds
    points = spark.range(300).select(
        F.lit("r").alias("run_id"), (F.col("id") % 9).alias("track_id"), F.when(F.col("id") % 10 > 0, "top").alias("stream"),
        F.col("id").cast("double").alias("t"), F.col("id").alias("seq"), *[F.col("id").cast("double").alias(c) for c in "uv"])
    wires = spark.createDataFrame([(w, s, [0.0, 9.0], [9.0, 0.0], "up") for w, s in (("a", "top"), ("b", "top"), ("c", "side"))],
                                  "wire_id string, stream string, q1 array<double>, q2 array<double>, in_dir string")
    want = sorted((i, w) for i in range(300) if i % 10 for w in "ab")
    met = []
    monkeypatch.setattr(sequence, "scan", lambda df, *a, **k: met.append(df) or scan(df, *a, **k))
    monkeypatch.setattr(sequence, "throttle", lambda df, *a, **k: df)
    monkeypatch.setattr(folds, "run_fold", lambda df, *a: met.append(df) or df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sequence.crossings(points, wires)
        folds.stream_crossings(points, wires)
        for df in (met[0], met[-1]):
            rows = df.withColumn("part", F.spark_partition_id()).collect()
            assert sorted((r.seq, r.wire_id) for r in rows) == want
            assert len({r.part for r in rows}) > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_inventory_reads_its_statuses_once(spark):
    """Both rounds of commits read one copy of the statuses, which are dear to compute."""
    from aislemetry.operators.sequence import inventory
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    status = spark.range(40).select(
        F.lit("r").alias("run_id"), F.lit("A1").alias("roi"), F.col("id").cast("double").alias("t"), F.col("id").alias("seq"),
        F.when(F.col("id") < 5, "normal").when(F.col("id") < 22, "low").otherwise("empty").alias("status"))
    stock = spark.createDataFrame([("A1", 10, None, 2.0)], "roi string, initial_stock int, low_threshold int, unit_price double")
    got = inventory(status.mapInArrow(counted, status.schema), stock, chunk_s=None).orderBy("t").collect()
    assert [(r.removed, r.remaining, r.revenue, r.rule) for r in got] == [
        (7, 3, 14.0, "low_stock_detected"), (3, 0, 6.0, "stockout_detected")]
    assert read.value == 40


def test_labels_of_a_run_lie_in_several_files(spark, tmp_path, monkeypatch):
    """No label file holds more than its share of a run's events, and their figures stay the same."""
    from aislemetry.plans import catalog_ranges
    from aislemetry.plans.catalog import QUERIES
    kinds = F.element_at(F.array(*map(F.lit, ("view", "click", "signup", "error", "purchase"))), (F.col("id") % 5 + 1).cast("int"))
    spark.range(600).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60 + 1704067200).alias("ts"),
        (F.col("id") % 7).alias("user_id"), kinds.alias("event_type"), (F.col("id") * 1.5).alias("value"),
        F.lit("").alias("props")).write.parquet(str(tmp_path / "events.parquet"))
    made, shared = [], catalog_ranges.shared_dir
    monkeypatch.setattr(catalog_ranges, "shared_dir", lambda *a: made.append(shared(*a)) or made[-1])
    monkeypatch.setattr(catalog_ranges, "LABELS_PER_FILE", 50)
    got = {(r.part, r.clip): r.n for r in QUERIES["read_ground_truth"](spark, str(tmp_path)).collect()}
    files = spark.read.json(made[0]).select("clip", F.size(F.coalesce("entries", F.array().cast(
        "array<struct<dir:string,t:double>>"))).alias("n"))
    assert files.count() > 9 and files.agg(F.max("n")).first()[0] <= 50
    want = {}
    for i in range(600):
        part = ("entries", "exits", "occupancy", "stockouts", None)[i % 5]
        if part:
            key = (part, f"run-{i % 7 % 3}")
            want[key] = want.get(key, 0) + 1
    assert got == want


def test_fold_hands_over_a_key_in_slices(monkeypatch):
    """A key with many rows in one batch is folded slice by slice, in order, with one state."""
    import pandas as pd

    from aislemetry.streaming import folds

    class Value:
        state = None
        exists = lambda self: self.state is not None
        get = lambda self: self.state

        def update(self, state):
            self.state = state

    monkeypatch.setattr(folds, "SLICE", 7)
    p = folds.Fold(folds.incident_step, "out boolean, low boolean", (False, False),
                   ["k", "t", "seq", "status", "kind"], ["k"])
    p.value = Value()
    status = [["empty", None, "low", "normal", "empty"][n * n % 5] for n in range(60)]
    rows = pd.DataFrame({"t": [float(n) for n in range(60)], "seq": range(60), "status": status})
    mixed = rows.sample(frac=1.0, random_state=1)
    frames = list(p.handleInputRows(("a",), iter([mixed.iloc[:31].copy(), mixed.iloc[31:].copy()]), None))
    state, want = (False, False), []
    for r in rows.to_dict("records"):
        state, out = folds.incident_step(state, r)
        want += [(o["seq"], o["kind"]) for o in out]
    got = pd.concat(frames)
    assert list(zip(got["seq"], got["kind"])) == want and p.value.state == state
    assert len(frames) == 9 and all(len(f) <= 3 * 7 for f in frames)


def test_shared_texts_keep_nulls_and_lists():
    import pandas as pd

    from aislemetry.streaming import folds
    column = [None, "a", "".join(["a"]), None]
    rows = folds._shared(pd.DataFrame({"s": pd.Series(column, dtype=object), "l": [None, [1.0], [2.0], None], "n": range(4)}))
    assert rows["s"].tolist() == column and rows["s"].iloc[0] is None and rows["s"].iloc[1] is rows["s"].iloc[2]
    assert rows["l"].tolist()[1:3] == [[1.0], [2.0]]


def test_waiting_rows_are_few_messages():
    """A batch of a key is one element of its state, nothing released is no frame, and what still waits has its timer."""
    import pandas as pd

    from aislemetry.streaming import folds

    class State:
        held = None
        get = lambda self: self.held
        exists = lambda self: self.held is not None

        def update(self, state):
            self.held = state

    class Waiting:
        held = []
        get = lambda self: iter(self.held)

        def appendList(self, elements):
            self.held = [*self.held, *elements]

        def put(self, elements):
            self.held = list(elements)

    class Handle:
        timers = []
        listTimers = lambda self: iter(self.timers)

        def deleteTimer(self, timer):
            self.timers = [t for t in self.timers if t != timer]

        def registerTimer(self, timer):
            self.timers = [*self.timers, timer]

    class Watermark:
        now = 0
        getCurrentWatermarkInMs = lambda self: self.now

    step, finish = folds.visit_step(1.0, 2.0)
    p = folds.Fold(step, folds.VISIT_STATE, (None, 0.0, None, 0.0, False, 0.0),
                   ["k", "zone", "t_enter", "t_exit", "dwell_s"], ["k"], finish, None, "t double, seq bigint, zone string")
    p.handle, p.value, p.waiting, clock = Handle(), State(), Waiting(), Watermark()
    rows = pd.DataFrame({"t": [float(n) for n in range(20)], "seq": range(20), "zone": ["a"] * 10 + ["b"] * 10})
    for part in (rows.iloc[7:], rows.iloc[:7]):
        assert list(p.handleInputRows(("x",), iter([part.sample(frac=1.0, random_state=3)]), clock)) == []
    assert len(p.waiting.held) == 2 and p.handle.timers == [0]
    for now, left in ((4_500, 5_000), (12_000, 13_000)):
        clock.now, rung = now, p.handle.timers[0]
        frames = list(p.handleExpiredTimer(("x",), clock, None))
        p.handle.deleteTimer(rung)                   # Spark does so after the call
        assert p.handle.timers == [left]
        assert [f.to_dict("records") for f in frames] == ([] if now < 5_000 else [
            [{"k": "x", "zone": "a", "t_enter": 0.0, "t_exit": 10.0, "dwell_s": 10.0}]])


def test_held_boxes_are_shuffled_once(spark, tmp_path):
    """Lines meet by track before they are boxes, so sums and scans add no shuffle; a track that is cut gives the same rows."""
    from aislemetry.plans.catalog import QUERIES
    spark.range(900).select(
        (F.col("id") * 3 % 400).alias("l_orderkey"), (F.col("id") * F.col("id") % 97 * 31).alias("l_partkey"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 5).cast("bigint").alias("l_suppkey")).write.parquet(
        str(tmp_path / "lineitem.parquet"))

    def ran(rows):
        conf = {"spark.aislemetry.chunk.bytes": "0", "spark.aislemetry.chunk.rows": str(rows)}
        for k, v in conf.items():
            spark.conf.set(k, v)
        try:
            df = QUERIES["hold_still"](spark, str(tmp_path))
            return str(df._jdf.queryExecution().executedPlan()), sorted(map(tuple, df.collect()))
        finally:
            for k in conf:
                spark.conf.unset(k)

    plan, whole = ran(100000)
    assert plan.count("Exchange hashpartitioning") == 1 and any(held for *_, held in whole)
    many, cut = ran(100)
    assert many.count("Exchange hashpartitioning") > 1 and cut == whole
