import json
import random

from pyspark.sql import functions as F

from aislemetry.operators import sequence as S
from aislemetry.schema import ENVELOPE
from aislemetry.sources import readers as RD
from aislemetry.streaming import flows, folds


def feed(spark, tmp_path, rows, ddl, parts):
    """Rows written as `parts` files in order; read one file per micro-batch."""
    path = str(tmp_path / "in")
    size = -(-len(rows) // parts)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i:i + size], ddl).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(path), spark.read.parquet(path)


def test_stream_visits_equal_batch(spark, tmp_path):
    rng = random.Random(12)
    rows, zone = [], {1: None, 2: None}
    for i in range(240):
        k = 1 + i % 2
        if rng.random() < 0.2:
            zone[k] = rng.choice(["a", "b", None])
        rows.append(("r", k, i * 0.5, i, zone[k]))
    # A late row of another track moves the watermark past everyone's silence.
    rows += [("r", 9, 100000.0, 999, None), ("r", 9, 200000.0, 1000, None)]
    stream, batch = feed(spark, tmp_path, rows, "run_id string, track_id bigint, t double, seq bigint, zone string", 4)
    got = flows.run_available(folds.stream_visits(folds.with_event_time(stream, "1 minute"), 1.0, 2.0, idle_s=30.0))
    want = S.visits(batch, 1.0, 2.0, chunk_s=None).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 5


def test_stream_crossings_and_incidents_equal_batch(spark, tmp_path):
    rng = random.Random(13)
    pts = [("r", "overhead", 1, float(i), i, rng.uniform(0, 99), rng.uniform(0, 99)) for i in range(120)]
    ddl = "run_id string, stream string, track_id bigint, t double, seq bigint, u double, v double"
    wires = spark.createDataFrame([("door", "overhead", [10.0, 50.0], [90.0, 50.0], "up")],
                                  "wire_id string, stream string, q1 array<double>, q2 array<double>, in_dir string")
    stream, batch = feed(spark, tmp_path, pts, ddl, 3)
    got = flows.run_available(folds.stream_crossings(stream, wires))
    want = S.crossings(batch, wires, chunk_s=None).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 5


def test_stream_shelf_and_inventory_equal_batch(spark, tmp_path):
    rng = random.Random(14)
    names = []
    for s, n in (("normal", 20), ("low", 30), ("empty", 40), ("normal", 10)):
        names += [s if rng.random() < 0.93 else "normal" for _ in range(n)]
    rows = [("r", "A1", float(i), i, s, 10, 3) for i, s in enumerate(names)]
    ddl = "run_id string, roi string, t double, seq bigint, status string, initial_stock int, threshold int"
    stream, batch = feed(spark, tmp_path, rows, ddl, 3)
    got = flows.run_available(folds.stream_shelf_incidents(stream.select("run_id", "roi", "t", "seq", "status")))
    want = S.shelf_incidents(batch.select("run_id", "roi", "t", "seq", "status"), chunk_s=None)
    assert sorted((r.seq, r.kind) for r in got.collect()) == sorted((r.seq, r.kind) for r in want.collect())
    stock = spark.createDataFrame([("A1", 10, 3, 1.0)], "roi string, initial_stock int, low_threshold int, unit_price double")
    gone = flows.run_available(folds.stream_inventory(stream))
    want = S.inventory(batch.select("run_id", "roi", "t", "seq", "status"), stock, chunk_s=None)
    assert sorted((r.t, r.removed, r.rule) for r in gone.collect()) == sorted(
        (r.t, r.removed, r.rule) for r in want.collect())


def test_sink_routes_once_and_quarantines(spark, tmp_path):
    rows = [(2e9 + i, "s", "overhead", None, "occupancy", json.dumps({"count": i})) for i in range(40)]
    rows += [(2e9, "s", "overhead", None, "occupancy", "{}"), (5.0, "s", "overhead", None, "occupancy", '{"count": 1}')]
    stream, _ = feed(spark, tmp_path, rows, ENVELOPE, 4)
    seen = []
    base, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):                                   # the second start finds nothing new
        q = flows.sink_events(stream, base, state, "r", trigger={"availableNow": True},
                              done=lambda df, i: seen.append(i))
        q.awaitTermination()
    got = flows.read_sunk(spark, base, "occupancy")
    assert sorted(r["count"] for r in got.collect()) == list(range(40)) and len(seen) == 4
    bad = flows.read_sunk(spark, base, "quarantine")
    assert sorted(r.reason for r in bad.collect()) == ["implausible time", "payload mismatch"]


def test_windows_duplicates_and_rates(spark, tmp_path):
    rows = [("s", "occupancy", "z", float(t), str(t)) for t in (10, 10, 20, 1000, 100000)]
    ddl = "store_id string, event_type string, zone_id string, t double, payload string"
    stream, _ = feed(spark, tmp_path, rows, ddl, 2)
    assert flows.run_available(flows.deduplicated(stream)).count() == 4
    e = stream.select(F.col("store_id").alias("run_id"), "t", "event_type", F.lit(2.0).alias("amount"))
    k = {r.t_bucket: (r.n, r.total) for r in flows.run_available(flows.windowed_kpis(e)).collect()}
    assert k[0] == (3, 6.0) and k[900] == (1, 2.0)
    a = flows.run_available(flows.sliding_arrivals(e))
    assert {r.t: r.arrivals for r in a.collect()}[300] == 3


def test_streamed_json_envelopes(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "a.json").write_text(json.dumps({"t": 1, "store_id": "s", "stream": "-", "zone_id": None,
                                                       "event_type": "occupancy", "payload": {"count": 3}}))
    s = RD.read_events(spark, str(tmp_path / "e"), streaming=True)
    got = flows.run_available(s.select("t", "payload")).first()
    assert s.isStreaming and json.loads(got.payload) == {"count": 3}


# --- order, late rows, end of input ----------------------------------------------
def arrivals(spark, tmp_path, batches, ddl):
    """Each list of rows is one micro-batch."""
    path = str(tmp_path / "arrivals")
    for rows in batches:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(path), spark.read.parquet(path)


OBS = "run_id string, track_id bigint, t double, seq bigint, zone string"


def wandering(n=300, seed=21):
    rng = random.Random(seed)
    rows, zone = [], {}
    for i in range(n):
        k = 1 + i % 3
        if rng.random() < 0.15:
            zone[k] = rng.choice(["a", "b", None])
        rows.append(("r", k, 100.0 + i * 0.5, i, zone.get(k)))
    return rows


def close_all(stream, name="fold"):
    return flows.run_available(stream, name=name, closing=lambda spark, state: folds.held(
        spark, state, stream.fold, stream.schema))


def test_shuffled_arrival_gives_the_rows_of_the_sorted_one(spark, tmp_path):
    rng = random.Random(22)
    rows = wandering()
    # Every row comes up to 20 s after its place, well inside the delay of a minute.
    order = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 20.0))
    batches = [order[i:i + 50] for i in range(0, 300, 50)]
    stream, batch = arrivals(spark, tmp_path, batches, OBS)
    timed = folds.with_event_time(stream, "1 minute")
    got = close_all(folds.stream_visits(timed, 1.0, 2.0, idle_s=None, reorder=True))
    want = S.visits(batch, 1.0, 2.0, chunk_s=None).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 10


def test_end_of_input_closes_what_is_open(spark, tmp_path):
    rows = wandering(seed=23)
    stream, batch = arrivals(spark, tmp_path, [rows[:150], rows[150:]], OBS)
    open_ = folds.stream_visits(stream, 1.0, 2.0, idle_s=None)
    got = close_all(open_)
    want = S.visits(batch, 1.0, 2.0, chunk_s=None).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # Without the closing step the last visit of every track is missing.
    assert flows.run_available(folds.stream_visits(stream, 1.0, 2.0, idle_s=None)).count() == got.count() - sum(
        1 for k in (1, 2, 3) if max(r.t_exit for r in want.where(f"track_id = {k}").collect())
        == max(r[2] for r in rows if r[1] == k))


def test_waiting_rows_keep_ties_and_gaps(spark, tmp_path):
    """Equal times are folded by seq; missing values and repeated rows survive the wait."""
    rows = [("r", 10.0, 2, 4.0), ("r", 10.0, 1, 2.0), ("r", 9.0, 0, 1.0), ("r", 10.0, 2, 4.0), ("r", 500.0, 3, 8.0)]
    ddl = "run_id string, t double, seq bigint, v double"
    stream, _ = arrivals(spark, tmp_path, [rows[:2], rows[2:]], ddl)
    got = close_all(folds.stream_ema(folds.with_event_time(stream, "1 minute"), "v", 0.5, ["run_id"], "run_id string",
                                     reorder=True))
    assert [(r.seq, r.smooth) for r in got.orderBy("seq", "smooth").collect()] == [
        (0, 1.0), (1, 1.5), (2, 2.75), (2, 3.375), (3, 5.6875)]


def test_late_rows_are_kept_beside_the_others(spark, tmp_path):
    ddl = "run_id string, t double"
    batches = [[("r", 100.0), ("r", 50.0)], [("r", 80.0), ("r", 95.0), ("r", 200.0)], [("r", 100.0), ("r", 191.0), (None, None)]]
    stream, batch = arrivals(spark, tmp_path, batches, ddl)
    base = str(tmp_path / "split")
    for _ in range(2):
        flows.split_late(stream, base, str(tmp_path / "state"), 10.0, {"availableNow": True}).awaitTermination()
    on_time, late = (spark.read.parquet(f"{base}/{x}").select("t") for x in ("on_time", "late"))
    assert sorted(r.t for r in late.collect()) == [80.0, 100.0]
    assert on_time.count() + late.count() == batch.count() and on_time.where("t is null").count() == 1


def test_upserts_hold_every_window_once(spark, tmp_path):
    ddl = "run_id string, t double, event_type string, amount double"
    batches = [[("r", 10.0, "a", 1.0), ("r", 1000.0, "a", 1.0)], [("r", 20.0, "a", 2.0), ("r", 1010.0, "b", 1.0)],
               [("r", 30.0, "a", 4.0)]]
    stream, _ = arrivals(spark, tmp_path, batches, ddl)
    k = flows.windowed_kpis(stream, "1 hour")
    base = str(tmp_path / "windows")
    for _ in range(2):
        flows.upsert(k, base, str(tmp_path / "state"), {"availableNow": True}).awaitTermination()
    got = flows.latest(spark, base, ["run_id", "t_bucket", "event_type"], k.schema)
    assert sorted((r.t_bucket, r.event_type, r.n, r.total) for r in got.collect()) == [
        (0, "a", 3, 7.0), (900, "a", 1, 1.0), (900, "b", 1, 1.0)]


def test_heartbeat_reports_silence(spark, tmp_path):
    ddl = "run_id string, t double, seq bigint, count bigint"
    # Key a falls silent after 25 s while b goes on; b's clock lets a report zeros.
    batches = [[("a", 11.0, 1, 5), ("a", 19.0, 2, 7), ("b", 10.0, 3, 1)], [("a", 25.0, 4, 3), ("b", 40.0, 5, 2)],
               [("b", 100.0, 6, 9)], [("b", 101.0, 7, 4)]]
    stream, _ = arrivals(spark, tmp_path, batches, ddl)
    s = folds.stream_heartbeat(folds.with_event_time(stream, "5 seconds"), 10.0)
    got = flows.run_available(s, name="beat", closing=lambda spark, state: folds.held_ticks(spark, state, s.fold))
    seen = {(r.run_id, r.tick): r["count"] for r in got.collect()}
    assert got.count() == len(seen)
    assert {t: c for (k, t), c in seen.items() if k == "b"} == {1: 1, 2: 0, 3: 0, 4: 2, 5: 0, 6: 0, 7: 0, 8: 0, 9: 0, 10: 4}
    own = {t: c for (k, t), c in seen.items() if k == "a"}
    assert own[1] == 7 and own[2] == 3 and set(own) >= set(range(1, 9)) and not any(own[t] for t in own if t > 2)


def test_many_keys_wait_in_few_groups(spark, tmp_path, monkeypatch):
    """Keys are dealt over a fixed number of groups of the state, with the rows of keys that are folded one by one."""
    monkeypatch.setattr(folds, "GROUPS", 4)
    rng = random.Random(24)
    tracks = [None, *range(32)]
    rows = [("r", "overhead", k, 100.0 + i + n / 100, i * 100 + n, rng.uniform(0, 99), rng.uniform(0, 99))
            for i in range(30) for n, k in enumerate(tracks)]
    order = sorted(rows, key=lambda r: r[3] + rng.uniform(0, 8.0))
    ddl = "run_id string, stream string, track_id bigint, t double, seq bigint, u double, v double"
    stream, batch = arrivals(spark, tmp_path, [order[:400], order[400:700], order[700:]], ddl)
    wires = spark.createDataFrame([("door", "overhead", [10.0, 50.0], [90.0, 50.0], "up"),
                                   ("side", "overhead", [50.0, 10.0], [50.0, 90.0], "left")],
                                  "wire_id string, stream string, q1 array<double>, q2 array<double>, in_dir string")
    s = folds.stream_crossings(folds.with_event_time(stream, "10 seconds"), wires, reorder=True)
    groups = []

    def closing(spark, state):
        groups.append(spark.read.format("statestore").option("stateVarName", "fold").load(state).count())
        return folds.held(spark, state, s.fold, s.schema)

    got = [tuple(r) for r in flows.run_available(s, name="groups", closing=closing).collect()]
    want = [tuple(r) for r in S.crossings(batch, wires, chunk_s=None).select(*s.columns).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and {r[1] for r in got} == set(tracks)
    assert 0 < groups[0] <= 4
