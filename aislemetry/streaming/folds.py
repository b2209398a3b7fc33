"""Keyed state for streams: one processor, one small step function per operator.

Rows of a key are sorted by (t, seq) inside each micro-batch and folded through
`step(state, row) -> (state, outputs)`. State is one tuple per key. How many rows
one key brings per batch is bounded by the source's admission limit
(`maxFilesPerTrigger`, `maxOffsetsPerTrigger`). A key that has been silent for
`idle_s` of event time is closed by a timer, which flushes open visits.

With `reorder`, rows first wait in keyed state until the watermark has passed them and are folded in order then, so
files that arrive out of order give the results of sorted ones; what waits per key is bounded by the watermark delay.
The keys are dealt over `GROUPS` groups whose rows and states lie in state as Arrow streams, as every group exchanges a
dozen messages with the state store in each batch, whatever it holds.
What a stopped stream still holds, state and waiting rows, is read from its checkpoint as a table and closed by the
same fold (`held`), so the end of the input is no different from a later row.
"""
from __future__ import annotations

import math
import re
from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from aislemetry.operators.ordered import whole_groups
from aislemetry.schema import dealt_join, store_keys

VISIT_STATE = ("zone string, since double, run string, run_since double, seen boolean, last double")


SLICE = 10000                   # rows of a key that are Python objects at the same time
GROUPS = 1024                   # groups that the keys of a reordering fold are dealt over; a checkpoint keeps to its number
GROUP = "__group"


def _shared(rows):
    """The rows with equal texts of a column as one object, so that a column costs a pointer a row."""
    for c in rows.columns[rows.dtypes == object]:
        texts = {}
        rows[c] = pd.Series([texts.setdefault(v, v) if isinstance(v, str) else v for v in rows[c]], rows.index, object)
    return rows


def _slices(rows):
    return (rows.iloc[n:n + SLICE] for n in range(0, len(rows), SLICE))


def _packed(rows) -> bytes:
    """An Arrow table as bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as stream:
        stream.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(pieces):
    tables = [pa.ipc.open_stream(p).read_all() for p in pieces]
    return pa.concat_tables(tables, promote_options="permissive") if tables else None


def _values(column):
    """The cells of an Arrow column as Python values; arrays are cut out of one list, as a call per cell is dear."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    cells = []
    for c in column.chunks:
        lengths = [n or 0 for n in c.value_lengths().to_pylist()]
        flat, ends = c.flatten().to_pylist(), list(accumulate(lengths))
        cells += [flat[b - n:b] if there else None for n, b, there in zip(lengths, ends, c.is_valid().to_pylist())]
    return cells


class Fold(StatefulProcessor):
    """Runs a step function over one value state."""

    def __init__(self, step: Callable, state_ddl: str, start: tuple, columns: list[str],
                 keys: list[str], finish: Callable | None = None, idle_s: float | None = None,
                 reorder: str | None = None):
        if reorder and idle_s is not None:
            raise ValueError("a reordering fold closes its keys at the end of the input")
        self.step, self.state_ddl, self.start = step, state_ddl, start
        self.columns, self.keys, self.finish, self.idle_s = columns, keys, finish, idle_s
        self.reorder = reorder           # columns that the step reads, t and seq first, as DDL
        self.dealt = []                  # keys that are told apart within a group of the stream
        self.types = {}                  # Arrow types of the columns in state, where known

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("fold", "states binary" if self.reorder else self.state_ddl)
        if self.reorder:
            self.waiting = handle.getListState("waiting", "rows binary")

    def _folded(self, state, rows):
        outputs = []
        for row in rows:
            state, out = self.step(state, row)
            outputs.extend(out)
        return state, outputs

    def _row_names(self):
        return [c.split(maxsplit=1)[0] for c in re.split(r",\s*(?![^<>]*>)", self.reorder)]

    def _states(self, packed):
        """The state of every key of a group, out of its bytes."""
        if packed is None:
            return {}
        n = len(self.dealt)
        return {r[:n]: r[n:] for r in zip(*map(_values, _unpacked([packed]).columns))}

    def _stored(self, states):
        rows = [(*key, *state) for key, state in states.items()]
        names = [*self.dealt, *[f"state {n}" for n in range(len(self.start))]]
        return _packed(pa.table([pa.array(c, self.types.get(n)) for c, n in zip(zip(*rows), names)], names))

    def _sorted(self, pieces):
        """Waiting rows by time, equal times by seq; None if there are none."""
        rows = _unpacked(pieces)
        return rows and rows.sort_by([("t", "ascending"), ("seq", "ascending")])

    def _folded_slices(self, states, rows):
        """Fold sorted rows into the states of their keys; outputs, with the keys that are told apart, slice by slice."""
        names, n = self._row_names(), len(self.dealt)
        for a in range(0, rows.num_rows, SLICE):
            part, outputs = rows.slice(a, SLICE), []
            of = list(zip(*[_values(part[k]) for k in self.dealt])) if n else [()] * part.num_rows
            for key, r in zip(of, zip(*[_values(part[c]) for c in names])):
                states[key], out = self.step(states.get(key, self.start), dict(zip(names, r)))
                outputs.extend({**dict(zip(self.dealt, key)), **o} for o in out)
            yield outputs

    def _frame(self, key, outputs):
        head = dict(zip(self.keys, key))
        return pd.DataFrame([{**head, **o} for o in outputs], columns=self.columns)

    def handleInputRows(self, key, rows, timerValues):
        if self.reorder:
            self._wait(rows)
            return
        batch = pd.concat([_shared(piece) for piece in rows], ignore_index=True).sort_values(["t", "seq"], kind="stable")
        state = self.value.get() if self.value.exists() else self.start
        for part in _slices(batch):
            state, outputs = self._folded(state, part.to_dict("records"))
            yield self._frame(key, outputs)
        self.value.update(state)
        if self.idle_s is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int((float(batch["t"].max()) + self.idle_s) * 1000))

    def _wait(self, rows):
        """Rows are kept as they come and sorted when they are released.

        An element of the state holds many rows: each element is a message of its own.
        """
        first, names = math.nan, [*dict.fromkeys([*self.dealt, *self._row_names()])]
        for piece in rows:
            kept = pa.table([pa.array(piece[c], self.types.get(c), from_pandas=True) for c in names], names)
            self.waiting.appendList([(_packed(kept),)])
            first = np.fmin(first, float(piece["t"].min()))
        self._wake(float(first))

    def _wake(self, t):
        """One timer, at the first row that waits."""
        timers = list(self.handle.listTimers())
        due = math.ceil(t * 1000)
        if not timers or due < min(timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)

    def _release(self, until_ms):
        """Fold the waiting rows that no later row can precede any more; outputs slice by slice."""
        rows = self._sorted(piece for piece, in self.waiting.get())
        if rows is None:
            return
        n = int((rows["t"].to_numpy() * 1000 <= until_ms).sum())
        if not n:
            return
        states = self._states(*(self.value.get() or (None,)))
        yield from self._folded_slices(states, rows.slice(0, n))
        self.value.update((self._stored(states),))
        if n < rows.num_rows:
            self.waiting.put([(_packed(rows.slice(n)),)])
            self.handle.registerTimer(math.ceil(rows["t"][n].as_py() * 1000))     # the one that has rung ends with this call
        else:
            self.waiting.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.reorder:
            for outputs in self._release(timerValues.getCurrentWatermarkInMs()):
                if outputs:                  # each frame is a batch of its own on its way back
                    yield self._frame(() if self.dealt else key, outputs)
            return
        outputs = self.finish(self.value.get()) if self.finish and self.value.exists() else []
        self.value.clear()
        yield self._frame(key, outputs)

    def close(self) -> None:
        pass


def _grouped(df, keys, needed):
    """The columns that are needed, the event time among them, with the group that the row's key is dealt to."""
    kept = df.select(*[c for c, kind in df.dtypes if c in needed or kind.startswith("timestamp")])
    return kept.withColumn(GROUP, F.pmod(F.xxhash64(*keys), F.lit(GROUPS)).cast("int"))


def run_fold(df: DataFrame, keys, schema: str, processor: Fold) -> DataFrame:
    """Attach a fold to a stream. With `idle_s` or `reorder` the input needs a `ts` watermark."""
    mode = "EventTime" if processor.idle_s is not None or processor.reorder else "None"
    by = list(keys)
    if processor.reorder:
        key_types = {k: t for k, t in _arrow_types(schema).items() if k in keys}
        processor.types = {**key_types, **_arrow_types(processor.reorder), **{
            f"state {n}": t for n, t in enumerate(_arrow_types(processor.state_ddl).values())}}
        df, by, processor.dealt = _grouped(df, keys, processor.types), [GROUP], list(keys)
    out = df.groupBy(*by).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=mode)
    out.fold = processor
    return out


def _arrow_types(ddl):
    return {f.name: f.type for f in to_arrow_schema(StructType.fromDDL(ddl))}


def held(spark, state: str, processor: Fold, schema) -> DataFrame:
    """Rows that closing every key of a stopped stream gives: waiting rows folded, then the fold's `finish`.

    Both are read from the checkpoint `state` as tables; one group's share, or one key's, is what its state and waiting
    rows hold.
    """
    def read(name):
        return spark.read.format("statestore").option("stateVarName", name).load(state)

    names = [GROUP] if processor.reorder else processor.keys
    rows = read("fold").select("key.*", F.struct("value.*").alias("state"))
    if processor.reorder:
        late = read("waiting").select("key.*", F.col("list_element.rows").alias("rows"))
        rows = rows.select(*names, "state.states").unionByName(late, allowMissingColumns=True)

    wanted = to_arrow_schema(schema)

    def finished(key, state):
        head = dict(zip(processor.keys, key))
        return [{**head, **o} for o in (processor.finish(state) if processor.finish else [])]

    def closed(group):
        """Outputs of a group, or of a key, in parts."""
        if not processor.reorder:
            key = tuple(group.column(k)[0].as_py() for k in names)
            yield finished(key, tuple(group.column("state")[0].as_py().values()))
            return
        states = processor._states(next(iter(group.column("states").drop_null().to_pylist()), None))
        waiting = processor._sorted(group.column("rows").drop_null().to_pylist())
        if waiting is not None:
            yield from processor._folded_slices(states, waiting)
        for key, state in states.items():
            yield finished(key, state)

    def close(batches):
        done = []
        for group in whole_groups(batches, names):
            for outputs in closed(group):
                done += outputs
                if len(done) >= SLICE:
                    yield pa.RecordBatch.from_pylist(done, wanted)
                    done = []
        yield pa.RecordBatch.from_pylist(done, wanted)

    return rows.repartition(*names).sortWithinPartitions(*names).mapInArrow(close, schema)


def with_event_time(df: DataFrame, delay="10 minutes") -> DataFrame:
    """Timestamp column from epoch seconds, and its watermark."""
    return df.withColumn("ts", F.timestamp_micros((F.col("t") * 1000000).cast("bigint"))
                         ).withWatermark("ts", delay)


def _text(v):
    """Pandas hands over missing strings as None or NaN."""
    return v if isinstance(v, str) else None


# --- visits ------------------------------------------------------------------
def visit_step(debounce, min_visit):
    def close(zone, since, t):
        if zone is not None and t - since >= min_visit:
            return [{"zone": zone, "t_enter": since, "t_exit": t, "dwell_s": t - since}]
        return []

    def step(state, row):
        zone, since, run, run_since, seen, _ = state
        here, t, out = _text(row["zone"]), float(row["t"]), []
        if not seen or here != run:
            run, run_since = here, t
        elif run != zone and t - run_since >= debounce:
            out = close(zone, since, run_since)
            zone, since = run, run_since
        return (zone, since, run, run_since, True, t), out

    def finish(state):
        return close(state[0], state[1], state[5])

    return step, finish


def stream_visits(obs: DataFrame, debounce=1.0, min_visit=2.0, idle_s=30.0,
                  keys=("run_id", "track_id"), key_ddl="run_id string, track_id bigint", reorder=False) -> DataFrame:
    """Streaming form of `sequence.visits`; silence of `idle_s` ends a track (None: only the end of the input)."""
    step, finish = visit_step(debounce, min_visit)
    cols = ["zone", "t_enter", "t_exit", "dwell_s"]
    p = Fold(step, VISIT_STATE, (None, 0.0, None, 0.0, False, 0.0), [*keys, *cols], list(keys),
             finish, idle_s, "t double, seq bigint, zone string" if reorder else None)
    ddl = f"{key_ddl}, zone string, t_enter double, t_exit double, dwell_s double"
    return run_fold(obs, keys, ddl, p)


# --- thinning, smoothing, incidents --------------------------------------------
def throttle_step(period, columns):
    def step(state, row):
        last, t = state[0], float(row["t"])
        if last is not None and t - last < period:
            return state, []
        return (t,), [{c: row[c] for c in columns}]
    return step


def stream_throttle(df: DataFrame, period, keys, key_ddl, columns, column_ddl) -> DataFrame:
    """Streaming form of `thinning.throttle`, e.g. alert cooldowns per store and rule."""
    keep = ["t", "seq", *columns]
    p = Fold(throttle_step(period, keep), "last double", (None,), [*keys, *keep], list(keys))
    extra = f", {column_ddl}" if column_ddl else ""
    return run_fold(df, keys, f"{key_ddl}, t double, seq bigint{extra}", p)


def stream_ema(df: DataFrame, value, alpha, keys, key_ddl, reorder=False) -> DataFrame:
    """Streaming form of `ordered.ema`: run value per row."""
    def step(state, row):
        x = float(row[value])
        s = x if state[0] is None else alpha * x + (1.0 - alpha) * state[0]
        return (s,), [{"t": row["t"], "seq": row["seq"], "smooth": s}]

    p = Fold(step, "s double", (None,), [*keys, "t", "seq", "smooth"], list(keys),
             reorder=f"t double, seq bigint, {value} double" if reorder else None)
    return run_fold(df, keys, f"{key_ddl}, t double, seq bigint, smooth double", p)


def stream_one_incident(df: DataFrame, keys, key_ddl) -> DataFrame:
    """Streaming form of `sequence.one_incident`."""
    def step(state, row):
        if row["kind"] == (state[0] or "end"):
            return state, []
        return (row["kind"],), [{c: row[c] for c in ("t", "seq", "kind")}]

    p = Fold(step, "kind string", (None,), [*keys, "t", "seq", "kind"], list(keys))
    return run_fold(df, keys, f"{key_ddl}, t double, seq bigint, kind string", p)


# What a reading tells, by whether the facing was and is empty.
_EDGES = {(False, True): ("start", "alert_out"), (True, False): ("end",)}
# Statuses that set or clear the low-stock latch; others leave it.
_LATCH = {"low": True, "normal": False}


def incident_step(state, row):
    """Stock-out edges and the low-stock latch of one facing: the pair of last and new status decides."""
    status = _text(row["status"])
    was_out, latched = state
    now = (status == "empty", _LATCH.get(status, latched))
    kinds = [*_EDGES.get((was_out, now[0]), ())]
    if status == "low" and not latched:
        kinds.append("alert_low")
    return now, [{"t": row["t"], "seq": row["seq"], "status": status, "kind": k} for k in kinds]


def stream_shelf_incidents(status: DataFrame, keys=("run_id", "roi"),
                           key_ddl="run_id string, roi string") -> DataFrame:
    """Streaming form of `sequence.shelf_incidents`."""
    cols = ["t", "seq", "status", "kind"]
    p = Fold(incident_step, "out boolean, low boolean", (False, False), [*keys, *cols], list(keys))
    return run_fold(status, keys, f"{key_ddl}, t double, seq bigint, status string, kind string", p)


# --- crossings -----------------------------------------------------------------
# Sign of the wire's own axis (first or second coordinate) that makes its positive side the inner one.
_INNER = {"up": (0, -1), "down": (0, 1), "left": (1, 1), "right": (1, -1)}


def crossing_step(band, debounce):
    """Crossings of one track and wire; rows carry the wire's ends and in_dir.

    A point is settled when it lies outside the band or on the side committed so far (any first point is); only
    settled points move the state. A change of side is a crossing if the wire's ends lie on different sides of the
    straight way from the last settled point.
    """
    def place(u, v):
        return (math.nan if u is None else float(u)), (math.nan if v is None else float(v))

    def area(origin, to, point):
        """Twice the signed area of a triangle; its sign is the side of origin -> to that the point is on."""
        du, dv, pu, pv = to[0] - origin[0], to[1] - origin[1], point[0] - origin[0], point[1] - origin[1]
        return du * pv - dv * pu

    def step(state, row):
        side, last_u, last_v, fired = state
        t, p = float(row["t"]), place(row["u"], row["v"])
        ends = place(*row["q1"]), place(*row["q2"])
        axis = ends[1][0] - ends[0][0], ends[1][1] - ends[0][1]
        off = area(*ends, p) / (float(np.hypot(*axis)) or 1.0)
        here = 1 if off > 0 else -1
        if side not in (None, here) and abs(off) < band:
            return state, []
        settled = (here, *p)
        if side in (None, here) or (fired is not None and t - fired < debounce):
            return (*settled, fired), []
        last = place(last_u, last_v)
        if len({area(last, p, end) > 0 for end in ends}) == 1:
            return (*settled, fired), []
        k, sign = _INNER[row["in_dir"]]
        way = "in" if (here > 0) == (sign * axis[k] > 0) else "out"
        return (*settled, t), [{"t": t, "seq": row["seq"], "dir": way}]
    return step


def stream_crossings(points: DataFrame, wires: DataFrame, band=12.0, debounce=2.0,
                     keys=("run_id", "track_id", "wire_id"),
                     key_ddl="run_id string, track_id bigint, wire_id string", reorder=False) -> DataFrame:
    """Streaming form of `sequence.crossings` over a stream-static join with the wires."""
    row = "t double, seq bigint, u double, v double, q1 array<double>, q2 array<double>, in_dir string"
    p = Fold(crossing_step(band, debounce), "side int, au double, av double, fired double",
             (None, None, None, None), [*keys, "t", "seq", "dir"], list(keys), reorder=row if reorder else None)
    met = dealt_join(points, wires, store_keys(points, wires, "stream"),
                     [*[k for k in keys if k in points.columns], "t", "seq"])
    return run_fold(met, keys, f"{key_ddl}, t double, seq bigint, dir string", p)


# --- inventory -------------------------------------------------------------------
def inventory_step(confirm=15, agreement=0.85):
    """Stock of one facing from readings and direct removals.

    Rows carry initial_stock and threshold, and either a status or a removal
    quantity (manual correction or detected pick). Stock only falls, so only empty
    and low readings can argue for less; the window is a text of one mark per
    reading, where a dot is a reading that argues for nothing. After a change of
    stock all earlier readings are dots.
    """
    def step(state, row):
        full = int(row["initial_stock"])
        stock, marks = (full, "") if state[0] is None else state
        low = int(full * 0.3)
        asked = row.get("removal")
        if pd.notna(asked) and asked > 0:
            level = stock - min(int(asked), stock)
        else:
            status = _text(row["status"])
            mark = "e" if status == "empty" or (status == "low" and low == 0) else "l" if status == "low" else "."
            marks = (marks + mark)[-confirm:]
            agreed = [q for m, q in (("e", 0), ("l", low))
                      if len(marks) == confirm and marks.count(m) >= confirm * agreement]
            level = min([stock, *agreed])
        if level == stock:
            return (stock, marks), []
        rule = "low_stock_detected" if level <= int(row["threshold"]) else None
        return (level, "." * len(marks)), [{
            "t": row["t"], "seq": row["seq"], "removed": stock - level, "remaining": level,
            "rule": rule if level else "stockout_detected"}]
    return step


def stream_inventory(rows: DataFrame, confirm=15, agreement=0.85, keys=("run_id", "roi"),
                     key_ddl="run_id string, roi string") -> DataFrame:
    """Streaming form of `sequence.inventory`, removals included."""
    cols = ["t", "seq", "removed", "remaining", "rule"]
    p = Fold(inventory_step(confirm, agreement), "stock int, marks string", (None, None),
             [*keys, *cols], list(keys))
    return run_fold(rows, keys, f"{key_ddl}, t double, seq bigint, removed int, remaining int, rule string", p)


# --- heartbeat -------------------------------------------------------------------
class Heartbeat(StatefulProcessor):
    """One row per period and key from its first reading on, whether readings come or not.

    A timer at the end of every period emits the period's last reading, or zero, and sets the next timer, so a silent
    key keeps reporting for as long as the watermark moves. State: the period due next, and the last reading of every
    period that is not over yet.
    """

    def __init__(self, keys, period: float, value: str):
        self.keys, self.period, self.field = list(keys), period, value
        self.columns = [*self.keys, "tick", value]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "tick long")
        self.open = handle.getMapState("open", "tick long", "t double, seq long, count long")

    def _timer(self, tick):
        self.handle.registerTimer(math.ceil((tick + 1) * self.period * 1000))

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["t", "seq"], kind="stable")
        ticks = np.floor(batch["t"].to_numpy() / self.period).astype(np.int64)
        for i in np.append(np.flatnonzero(ticks[1:] != ticks[:-1]), len(ticks) - 1):
            row, at = batch.iloc[int(i)], (int(ticks[i]),)
            now = (float(row["t"]), int(row["seq"]), int(row[self.field]))
            if not self.open.containsKey(at) or tuple(self.open.getValue(at))[:2] < now[:2]:
                self.open.updateValue(at, now)
        first = int(ticks[0])
        if not self.due.exists() or first < self.due.get()[0]:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.due.update((first,))
            self._timer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, tick, out = timerValues.getCurrentWatermarkInMs(), self.due.get()[0], []
        while (tick + 1) * self.period * 1000 <= now:
            value = 0
            if self.open.containsKey((tick,)):
                value = self.open.getValue((tick,))[2]
                self.open.removeKey((tick,))
            out.append((*key, tick, value))
            tick += 1
        self.due.update((tick,))
        self._timer(tick)
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def stream_heartbeat(readings: DataFrame, period: float, value="count", keys=("run_id",),
                     key_ddl="run_id string") -> DataFrame:
    """keys, tick (number of the period) and the period's last reading, zero where there is none.

    readings: keys, t, seq, value, and a `ts` watermark. Readings of periods that are over are late and not taken.
    """
    p = Heartbeat(keys, period, value)
    out = readings.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=p, outputStructType=f"{key_ddl}, tick bigint, {value} bigint", outputMode="Append",
        timeMode="EventTime")
    out.fold = p
    return out


def held_ticks(spark, state: str, processor: Heartbeat) -> DataFrame:
    """Periods of a stopped stream that were still open, each key's up to its last reading."""
    def read(name):
        return spark.read.format("statestore").option("stateVarName", name).load(state)

    value = processor.field
    due = read("due").select("key.*", F.col("value.tick").alias("due"))
    seen = read("open").select("key.*", F.col("user_map_key.tick").alias("tick"), F.col("user_map_value.count").alias(value))
    ends = seen.groupBy(*processor.keys).agg(F.max("tick").alias("last"))
    spine = due.join(ends, processor.keys).where("due <= last").select(
        *processor.keys, F.explode(F.sequence("due", "last")).alias("tick"))
    return spine.join(seen, [*processor.keys, "tick"], "left").fillna(0, [value])
