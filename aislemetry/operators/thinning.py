"""Greedy thinning: keep a row iff it is one period or more after the last kept row of its key.

Which row is kept depends on the last *kept* one, so no window expresses it; yet every row has one successor, the first
row that would be kept after it, and the kept rows are what the key's first row reaches. Rows lie in ranges of
(key, order), one range per task, whatever the sizes of the keys:

* A key inside one range is walked there, batch by batch, with the time of the last kept row as its only state.
* A key over several ranges (there are fewer of these than ranges) becomes a successor graph. Each range contracts its
  part: every row is led to its exit, the last row it reaches inside the range. Exits are then joined to the exit their
  successor is led to, and these links are doubled until none is left, at most log2(ranges) times. Top down, the doubled
  links mark the exits that the key's first row reaches, one per range at most, and so the row at which each range is
  entered. Those few rows are all the driver sees.

Times are compared by the difference `now - last`, as a loop would, for any magnitude of time and period.
"""
from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aislemetry.operators.ordered import key_changes
from aislemetry.session import cut


def due_from(t, period, strict: bool):
    """The least time u with `u - t >= period` (`>` if strict) in doubles, for every t."""
    t = np.asarray(t, np.float64)

    def due(u):
        return u - t > period if strict else u - t >= period

    u = t + period
    while not (ok := due(u)).all():
        u = np.where(ok, u, np.nextafter(u, np.inf))
    while (lower := due(below := np.nextafter(u, -np.inf)) & (below > t)).any():
        u = np.where(lower, below, u)
    return u


def _runs(batches, keys, t):
    """(batch, first row, one past the last, times, key, whether the key starts here) of sorted batches."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        times = batch.column(t).cast(pa.float64()).to_numpy(zero_copy_only=False)
        starts = [0, *np.flatnonzero(key_changes(batch, keys)).tolist()]
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            key = tuple(batch.column(k)[a].as_py() for k in keys)
            yield batch, a, b, times[a:b], key, key != last
            last = key


def _period(batch, row, period) -> float:
    """The period itself, or what its column says for the key that starts at `row`."""
    return float(batch.column(period)[row].as_py()) if isinstance(period, str) else period


def _pieces(batches, keys, t, period):
    """(key, times, period) of every key of one range."""
    key, seconds, parts = None, None, []
    for batch, a, _, times, now, new in _runs(batches, keys, t):
        if new and parts:
            yield key, np.concatenate(parts), seconds
            parts = []
        if new:
            key, seconds = now, _period(batch, a, period)
        parts.append(times)
    if parts:
        yield key, np.concatenate(parts), seconds


def _thin(line: DataFrame, keys, t, period) -> DataFrame:
    return line.select(*keys, t, *([period] if isinstance(period, str) else []))


def _ends(line: DataFrame, keys, t, period):
    """First and last key of every range: (range, key, first time, last time, period)."""
    def run(batches):
        found = []
        for key, times, seconds in _pieces(batches, keys, t, period):
            found = [*found[:1], (key, float(times[0]), float(times[-1]), seconds)]
        at = TaskContext.get().partitionId()
        for key, *numbers in found:
            yield pa.RecordBatch.from_arrays(
                [pa.array([at]), pa.array([pickle.dumps(key)], pa.binary()), *[pa.array([float(x)]) for x in numbers]],
                ["part", "key", "low", "high", "period"])

    rows = _thin(line, keys, t, period).mapInArrow(
        run, "part long, key binary, low double, high double, period double").collect()
    return [(r.part, pickle.loads(r.key), r.low, r.high, r.period) for r in rows]


def _contracted(line: DataFrame, keys, t, period, strict, numbers):
    """chain, part, t, exit: where every time of a chained key is led inside its range."""
    def run(batches):
        part = TaskContext.get().partitionId()
        for key, times, seconds in _pieces(batches, keys, t, period):
            if key not in numbers:
                continue
            times = times[np.append(True, times[1:] != times[:-1])]
            n = len(times)
            at = np.searchsorted(times, due_from(times, seconds, strict))
            lead = np.where(at < n, at, np.arange(n))
            while not np.array_equal(further := lead[lead], lead):
                lead = further
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, numbers[key], np.int64)), pa.array(np.full(n, part, np.int64)), pa.array(times),
                 pa.array(times[lead])], ["chain", "part", "t", "exit"])

    return _thin(line, keys, t, period).mapInArrow(run, "chain long, part long, t double, exit double")


def _successors(nodes: DataFrame, periods: list[float], strict) -> DataFrame:
    """chain, x (exit), r (its successor's time), y (the exit that r is led to); exits without successor are left out.

    A probe at the time from which a row would be due looks up the next row. Ranges of the merged timeline are cut
    anywhere; probes left over at the end of a range take the first row of the next ranges, known from one row each.
    """
    def probes(batches):
        for batch in batches:
            x, seconds = batch.column("x").to_numpy(), np.array(periods)[batch.column("chain").to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column("chain"), pa.array(due_from(x, seconds, strict)),
                                              batch.column("x")], ["chain", "t", "x"])

    exits = nodes.select("chain", F.col("exit").alias("x")).distinct().mapInArrow(
        probes, "chain long, t double, x double")
    none = F.lit(None).cast("double")
    merged = exits.select("chain", "t", F.lit(-1).cast("long").alias("part"), "x", none.alias("exit")).unionByName(
        nodes.select("chain", "t", "part", none.alias("x"), "exit"))
    by = ["chain", "t", "part"]
    merged = cut(merged.repartitionByRange(*by).sortWithinPartitions(*by))

    def firsts(batches):
        """First row, not probe, of every chain in this range: only the last chain's probes can need a later one."""
        seen, at = set(), TaskContext.get().partitionId()
        for batch in batches:
            rows = batch.filter(batch.column("exit").is_valid())
            chain = rows.column("chain").to_numpy()
            for i in np.flatnonzero(np.append(True, chain[1:] != chain[:-1])) if len(chain) else ():
                if chain[i] not in seen:
                    seen.add(int(chain[i]))
                    yield pa.RecordBatch.from_arrays([pa.array([at]), rows.column("chain").slice(i, 1),
                                                      rows.column("t").slice(i, 1), rows.column("exit").slice(i, 1)],
                                                     ["at", "chain", "t", "exit"])

    heads: dict = {}
    for h in merged.select("chain", "t", "exit").mapInArrow(firsts, "at long, chain long, t double, exit double").collect():
        heads.setdefault(h.chain, []).append((h.at, h.t, h.exit))
    heads = {k: sorted(v) for k, v in heads.items()}

    def resolved(batches):
        at = TaskContext.get().partitionId()
        wait_chain, wait = [], []

        def met(chain, x, r, y):
            return pa.RecordBatch.from_arrays([pa.array(chain, pa.int64()), pa.array(x, pa.float64()),
                                               pa.array(r, pa.float64()), pa.array(y, pa.float64())],
                                              ["chain", "x", "r", "y"])

        for batch in batches:
            chain, t = batch.column("chain").to_numpy(), batch.column("t").to_numpy()
            x, exits = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "exit"))
            chain = np.concatenate([np.array(wait_chain, np.int64), chain])
            t, exits = (np.concatenate([np.full(len(wait), np.nan), c]) for c in (t, exits))
            x = np.concatenate([np.array(wait, np.float64), x])
            rows = np.flatnonzero(~np.isnan(exits))
            probe = np.flatnonzero(~np.isnan(x))
            next_ = np.searchsorted(rows, probe)
            inside = next_ < len(rows)
            hit = np.zeros(len(probe), bool)
            hit[inside] = chain[rows[next_[inside]]] == chain[probe[inside]]
            to = rows[next_[hit]]
            yield met(chain[probe[hit]], x[probe[hit]], t[to], exits[to])
            # Probes of the chain that the batch ends in wait for its next row; those of earlier chains have none.
            left = probe[~inside & (chain[probe] == chain[-1])]
            wait_chain, wait = chain[left], x[left]
        if len(wait):
            later = next(((r, y) for part, r, y in heads.get(int(wait_chain[0]), ()) if part > at), None)
            if later is not None:
                yield met(wait_chain, wait, np.full(len(wait), later[0]), np.full(len(wait), later[1]))

    return merged.select("chain", "t", "x", "exit").mapInArrow(resolved, "chain long, x double, r double, y double")


def _entries(line: DataFrame, keys, t, period, strict):
    """{key: {range: time at which the kept rows enter it}} of all keys at the ends of ranges."""
    entries, chains, seconds = {}, {}, {}
    for part, key, low, high, own in _ends(line, keys, t, period):
        entries.setdefault(key, {}).setdefault(part, low)
        chains.setdefault(key, []).append((part, low, high))
        seconds[key] = own
    chains = {k: sorted(v) for k, v in chains.items() if len(v) > 1}
    if not chains:
        return entries
    spark = line.sparkSession
    names = list(chains)
    numbers = {k: n for n, k in enumerate(names)}
    nodes = cut(_contracted(line, keys, t, period, strict, numbers))
    jumps = cut(_successors(nodes, [seconds[k] for k in names], strict))
    levels, now = [], jumps.select("chain", "x", "y")
    while True:
        levels.append(now)
        further = now.select("chain", F.col("x").alias("y"), F.col("y").alias("z"))
        now = cut(now.join(further, ["chain", "y"]).select("chain", "x", F.col("z").alias("y")))
        if not now.take(1):
            break
    schema = "chain long, x double"

    def at(rows, among, *columns):
        """Rows of a link table for the marked exits, of which every range has one per chain at most."""
        return among.join(F.broadcast(spark.createDataFrame(sorted(rows), schema)), ["chain", "x"]).select(
            "chain", *columns).collect()

    roots = {numbers[k]: parts[0][:2] for k, parts in chains.items()}
    first = spark.createDataFrame([(n, p, low) for n, (p, low) in roots.items()], "chain long, part long, t double")
    marked = {(r.chain, r.exit) for r in nodes.join(F.broadcast(first), ["chain", "part", "t"]).select(
        "chain", "exit").collect()}
    for level in reversed(levels):
        marked |= {(r.chain, r.y) for r in at(marked, level, "y")}
    for key in chains:
        part, low = roots[numbers[key]]
        entries[key] = {part: low}
    for r in at(marked, jumps, "r"):
        key = names[r.chain]
        # Rows of one time may lie in two ranges; the first of them is the one that is kept.
        part = next(p for p, _, high in chains[key] if high >= r.r)
        entries[key][part] = r.r
    return entries


def throttle(df: DataFrame, keys, order, period, strict=False) -> DataFrame:
    """Keep a row iff it is `period` or more (`strict`: more) after the last kept row of its key.

    `order` starts with the time; `period` is in its unit, or names a column that holds one period per key. Rows without
    a finite time are never kept; of rows that agree in keys and order one is kept at most. A period that every row
    satisfies keeps all rows with a time. The rows are sorted into ranges when this is called, since the number of
    doublings depends on them.
    """
    keys, order = list(keys), list(order)
    t = order[0]
    rows = df.where(F.abs(F.col(t).cast("double")) < float("inf"))
    if not isinstance(period, str) and (period < 0 or (period == 0 and not strict)):
        return rows
    by = [*keys, *order]
    line = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by))
    several = line.rdd.getNumPartitions() > 1
    entries = _entries(line, keys, t, period, strict) if several else {}

    def run(batches):
        part = TaskContext.get().partitionId() if several else 0
        due, seconds = -np.inf, None
        for batch, a, b, times, key, new in _runs(batches, keys, t):
            if new:
                due, seconds = -np.inf, _period(batch, a, period)
                if key in entries:
                    due = entries[key].get(part, np.inf)
            if not times[-1] >= due:
                continue
            then = due_from(times, seconds, strict)
            at = np.searchsorted(times, then)
            keep, i = [], int(np.searchsorted(times, due))
            while i < b - a:
                keep.append(a + i)
                due = then[i]
                i = int(at[i])
            yield batch.take(pa.array(keep))

    return line.mapInArrow(run, T.StructType(list(df.schema.fields)))
