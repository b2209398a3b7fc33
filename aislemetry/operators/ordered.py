"""Ordered scans that stay balanced when one key holds most of the rows.

A window over `partitionBy(key)` puts a whole key in one task. Here each key's
timeline is cut into chunks of bounded row count when a key is measured to be
too big: windows run per (key, chunk), one summary row per chunk is scanned per
key, and the carried value is joined back to its chunk. A NULL key is a key like
any other. `order` is a list of ascending columns whose first entry is the time
column; rows without a time come first.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = "__chunk"
PART = "__part"            # struct of keys and chunk: unlike plain columns it compares NULL fields as equal
TARGET_ROWS = 500_000
TARGET_BYTES = 64 << 20     # estimated input up to which a key is not cut
CHUNK_SECONDS = 3600.0      # a key's rows of an hour fit one task


def target_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.aislemetry.chunk.rows", str(TARGET_ROWS)))


def chunk_seconds(df: DataFrame, keys, t="t", target=None):
    """Chunk length so that no (key, chunk) exceeds `target` rows, else None.

    Measures with jobs: one aggregation finds the biggest key, which no cut is needed for if it fits one task; else
    the length follows from its rows and its span, and is cut down while some chunk is too full.
    """
    target = int(target or target_rows(df))
    at = F.when(F.abs(F.col(t).cast("double")) < float("inf"), F.col(t).cast("double"))
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(at).alias("a"), F.max(at).alias("b"))
    big = per_key.agg(F.max(F.struct("n", F.col("b") - F.col("a"))).alias("w")).first().w
    if big is None or big[0] <= target:
        return None
    slot = (big[1] or CHUNK_SECONDS) * target / big[0] / 2
    while slot >= 1e-3:
        worst = df.groupBy(*keys, F.floor(F.col(t) / slot).alias("__slot")).count().agg(F.max("count")).first()[0]
        if worst <= target:
            break
        slot /= max(2.0, min(60.0, worst / target))
    return slot


def resolve(chunk_s, df, keys=(), t="t", measure=True):
    """Chunk length: a number fixes it, None means one chunk per key, `"auto"` goes by the size of the inputs.

    Inputs that the optimizer estimates at no more than `spark.aislemetry.chunk.bytes` fit one task however the keys are
    spread, so no job runs for them. For larger ones, and those of unknown size, `chunk_seconds` measures how full the
    keys are: a table of many small keys is not cut, since chunks of an hour would hold a row or two each and their
    summaries would be as big as the table. `spark.aislemetry.chunk.seconds` sets a length instead of measuring; without
    `measure`, for inputs that are dear to compute twice, it is an hour.
    """
    if chunk_s != "auto":
        return chunk_s
    conf = df.sparkSession.conf
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size <= int(conf.get("spark.aislemetry.chunk.bytes", str(TARGET_BYTES))):
        return None
    fixed = conf.get("spark.aislemetry.chunk.seconds", None)
    if measure and fixed is None:
        return chunk_seconds(df, keys, t)
    return float(fixed or CHUNK_SECONDS)


def laid_by(df: DataFrame, *keys) -> DataFrame:
    """Rows of a key in one task, for keys that `resolve` does not cut; about as many rows a task as a chunk may hold.

    Whatever is grouped or scanned by these keys, or by these and others, is not shuffled again. Counts the rows with a job.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // target_rows(df)))
    return df.repartition(tasks, *keys)


def _boxed(expr):
    return F.struct(expr.alias("v"))


@dataclass(frozen=True)
class Spec:
    expr: Column

    def local(self, asc, desc):
        raise NotImplementedError

    def summary(self, order, name):
        raise NotImplementedError

    def carry(self, asc, desc, name):
        raise NotImplementedError

    def merge(self, local, carry):
        return F.coalesce(local, carry)

    def final(self, value):
        return value


class Prev(Spec):
    """Value on the previous row of the key."""

    def local(self, asc, desc):
        return F.lag(_boxed(self.expr)).over(asc)

    def summary(self, order, name):
        return F.max_by(_boxed(self.expr), order)

    def carry(self, asc, desc, name):
        return F.lag(name).over(asc)

    def final(self, value):
        return value["v"]


class Next(Prev):
    """Value on the next row of the key."""

    def local(self, asc, desc):
        return F.lead(_boxed(self.expr)).over(asc)

    def summary(self, order, name):
        return F.min_by(_boxed(self.expr), order)

    def carry(self, asc, desc, name):
        return F.lead(name).over(asc)


@dataclass(frozen=True)
class LastValid(Spec):
    """Last non-null value at or before this row (strictly before by default)."""
    inclusive: bool = False

    def local(self, asc, desc):
        end = Window.currentRow if self.inclusive else -1
        return F.last(self.expr, ignorenulls=True).over(
            asc.rowsBetween(Window.unboundedPreceding, end))

    def summary(self, order, name):
        return F.max_by(self.expr, F.when(self.expr.isNotNull(), order))

    def carry(self, asc, desc, name):
        return F.last(name, ignorenulls=True).over(asc.rowsBetween(Window.unboundedPreceding, -1))


class NextValid(LastValid):
    """Next non-null value after this row (or at it, when inclusive)."""

    def local(self, asc, desc):
        return super().local(desc, asc)

    def summary(self, order, name):
        return F.min_by(self.expr, F.when(self.expr.isNotNull(), order))

    def carry(self, asc, desc, name):
        return super().carry(desc, asc, name)


@dataclass(frozen=True)
class RunSum(Spec):
    inclusive: bool = True

    def local(self, asc, desc):
        end = Window.currentRow if self.inclusive else -1
        s = F.sum(self.expr).over(asc.rowsBetween(Window.unboundedPreceding, end))
        return F.coalesce(s, F.lit(0))

    def summary(self, order, name):
        return F.coalesce(F.sum(self.expr), F.lit(0))

    def carry(self, asc, desc, name):
        s = F.sum(name).over(asc.rowsBetween(Window.unboundedPreceding, -1))
        return F.coalesce(s, F.lit(0))

    def merge(self, local, carry):
        return local + carry


@dataclass(frozen=True)
class RunMin(Spec):
    inclusive: bool = True

    def _pick(self, e):
        return F.min(e)

    def _both(self, a, b):
        return F.least(a, b)

    def local(self, asc, desc):
        end = Window.currentRow if self.inclusive else -1
        return self._pick(self.expr).over(asc.rowsBetween(Window.unboundedPreceding, end))

    def summary(self, order, name):
        return self._pick(self.expr)

    def carry(self, asc, desc, name):
        return self._pick(name).over(asc.rowsBetween(Window.unboundedPreceding, -1))

    def merge(self, local, carry):
        return self._both(local, carry)


class RunMax(RunMin):
    def _pick(self, e):
        return F.max(e)

    def _both(self, a, b):
        return F.greatest(a, b)


class WholeMax(Spec):
    """Maximum over the whole key."""

    def local(self, asc, desc):
        return F.max(self.expr).over(asc.rowsBetween(Window.unboundedPreceding,
                                                     Window.unboundedFollowing))

    def summary(self, order, name):
        return F.max(self.expr)

    def carry(self, asc, desc, name):
        return F.max(name).over(asc.rowsBetween(Window.unboundedPreceding,
                                                Window.unboundedFollowing))

    def merge(self, local, carry):
        return carry


class WholeSum(WholeMax):
    """Sum over the whole key."""

    def local(self, asc, desc):
        return F.sum(self.expr).over(asc.rowsBetween(Window.unboundedPreceding,
                                                     Window.unboundedFollowing))

    def summary(self, order, name):
        return F.sum(self.expr)

    def carry(self, asc, desc, name):
        return F.sum(name).over(asc.rowsBetween(Window.unboundedPreceding,
                                                Window.unboundedFollowing))


class First(Spec):
    """Value on the first row of the key."""

    def local(self, asc, desc):
        return F.first(_boxed(self.expr)).over(
            asc.rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def summary(self, order, name):
        return F.min_by(_boxed(self.expr), order)

    def carry(self, asc, desc, name):
        return F.first(name).over(asc.rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def merge(self, local, carry):
        return carry

    def final(self, value):
        return value["v"]


@dataclass(frozen=True)
class Tail(Spec):
    """The last `n` values up to this row, oldest first, nulls kept."""
    n: int = 2

    def local(self, asc, desc):
        return F.collect_list(_boxed(self.expr)).over(asc.rowsBetween(-(self.n - 1), 0))

    def summary(self, order, name):
        return F.max_by(F.col(name), order)

    def carry(self, asc, desc, name):
        return F.flatten(F.collect_list(name).over(asc.rowsBetween(-(self.n - 1), -1)))

    def merge(self, local, carry):
        both = F.concat(F.coalesce(carry, F.slice(local, 1, 0)), local)
        return F.slice(both, F.greatest(F.size(both) - (self.n - 1), F.lit(1)), self.n)

    def final(self, value):
        return F.transform(value, lambda b: b["v"])


def scan(df: DataFrame, keys, order, specs: dict[str, Spec], chunk_s=None) -> DataFrame:
    """Add one column per spec. See the module text for the physical shape."""
    keys, order = list(keys), list(order)
    ascending = [F.col(c).asc() for c in order]
    descending = [F.col(c).desc() for c in order]
    if chunk_s is None:
        w = Window.partitionBy(*keys)
        asc, desc = w.orderBy(*ascending), w.orderBy(*descending)
        out = {n: s.final(s.local(asc, desc)) for n, s in specs.items()}
        return df.withColumns(out)

    stamp = F.struct(*order)
    chunk = F.floor(F.col(order[0]) / float(chunk_s)).cast("bigint").alias(CHUNK)
    # One explicit exchange feeds both the windows and the summary, so what lies
    # upstream runs once however many scans are stacked.
    cut_df = df.withColumn(PART, F.struct(*keys, chunk)).repartition(PART)
    w = Window.partitionBy(PART)
    asc, desc = w.orderBy(*ascending), w.orderBy(*descending)
    local = cut_df.withColumns({f"__l_{n}": s.local(asc, desc) for n, s in specs.items()})

    # Only a Tail summarises its own local column; the rest summarise raw rows.
    base = local if any(isinstance(s, Tail) for s in specs.values()) else cut_df
    summary = base.groupBy(PART).agg(
        *[s.summary(stamp, f"__l_{n}").alias(f"__c_{n}") for n, s in specs.items()])
    k = Window.partitionBy(*[F.col(PART)[c] for c in keys])
    at = F.col(PART)[CHUNK]
    kasc, kdesc = k.orderBy(at.asc()), k.orderBy(at.desc())
    carried = summary.select(PART, *[
        s.carry(kasc, kdesc, f"__c_{n}").alias(f"__k_{n}") for n, s in specs.items()])
    joined = local.join(carried, PART, "left")
    return joined.select(*df.columns, *[
        s.final(s.merge(F.col(f"__l_{n}"), F.col(f"__k_{n}"))).alias(n)
        for n, s in specs.items()])


# --- ranks ----------------------------------------------------------------------
def weighted_ranks(df: DataFrame, keys, value, chunk_s="auto") -> DataFrame:
    """One row per key and distinct value: its weight `__w`, last rank `__r` and the key's rows `__n`.

    Equal values are added up before the shuffle, so neither a key nor a value that holds most rows is a task.
    """
    rows = df.groupBy(*keys, value).agg(F.count("*").alias("__w"))
    return scan(rows, keys, [value], {"__r": RunSum(F.col("__w")), "__n": WholeSum(F.col("__w"))},
                resolve(chunk_s, df, keys, value, measure=False))


def holds_rank(rank):
    """Whether a row of `weighted_ranks` covers a rank."""
    return (F.col("__r") >= rank) & (F.col("__r") - F.col("__w") < rank)


# --- folds over sorted partitions ----------------------------------------------
def _spread(df, by, sort):
    df = df.repartition(*by) if by else df.repartition(1)
    return df.sortWithinPartitions(*sort)


def _fold(df, keys, order, chunk_s, walker, out_schema, report, chainer, entry_type):
    """Run a sequential fold whose state is one number per key.

    Keys are streamed through sorted partitions, never collected. With chunks,
    `report` sums each chunk up in one row, `chainer` threads those rows per key
    into the entry state of every chunk, and `walker` resumes from it.
    """
    if chunk_s is None:
        return _spread(df, keys, [*keys, *order]).mapInPandas(walker(keys, None), out_schema)
    parts = [*keys, CHUNK]
    rows = df.withColumn(CHUNK, F.floor(F.col(order[0]) / float(chunk_s)).cast("bigint")).repartition(*parts)
    fields = {f.name: f for f in rows.schema.fields}
    head = [fields[k] for k in parts]
    make, needed, summary = report
    reports = rows.select(*parts, *needed).sortWithinPartitions(*parts, *order).mapInPandas(
        make(parts), T.StructType([*head, *summary]))
    entries = _spread(reports, keys, parts).mapInPandas(
        chainer(keys), T.StructType([*head, T.StructField("__entry", entry_type)]))
    entries = entries.select(F.struct(*parts).alias(PART), "__entry")
    ready = rows.withColumn(PART, F.struct(*parts)).join(entries, PART).drop(PART)
    wide = T.StructType([*ready.schema.fields,
                         *[f for f in out_schema.fields if f.name not in ready.columns]])
    return _spread(ready, parts, [*parts, *order]).mapInPandas(
        walker(parts, "__entry"), wide).select(*[f.name for f in out_schema.fields])


def _chunk_reporter(keys, cols, columns, summarise):
    """mapInPandas function: one summary row per key from its columns' values."""
    def run(batches):
        import pandas as pd
        head, values = None, [[] for _ in cols]

        def frame(rows):
            return pd.DataFrame(rows, columns=[*keys, *columns])

        for pdf, a, b, new in _groups(batches, keys):
            if new and head is not None:
                yield frame([(*head, *summarise(*values))])
                values = [[] for _ in cols]
            if new:
                head = tuple(pdf[k].iloc[a] for k in keys)
            for store, c in zip(values, cols):
                store.extend(pdf[c].iloc[a:b].tolist())
        if head is not None:
            yield frame([(*head, *summarise(*values))])
    return run


def ema(df, keys, order, value, alpha, name, chunk_s=None, blend_first=False) -> DataFrame:
    """Exponential mean seeded by the first value of each key.

    `blend_first` also mixes the seed with itself, as a smoother that starts from
    its own first reading does. A chunk is summed up by its first value, its
    length and the mean it ends on when seeded by that value.
    """
    keys, order = list(keys), list(order)
    keep = 1.0 - alpha
    out = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def walker(by, entry):
        def run(batches):
            s, current, vals = None, None, []
            for pdf, a, b, new in _groups(batches, by):
                if current is not pdf:
                    if current is not None:
                        yield current.assign(**{name: vals})
                    current, vals = pdf, []
                    xs = pdf[value].tolist()
                if new:
                    s = None
                    if entry is not None and pdf[entry].iloc[a] == pdf[entry].iloc[a]:
                        s = float(pdf[entry].iloc[a])
                for i in range(a, b):
                    x = float(xs[i])
                    if s is None:
                        s = alpha * x + keep * x if blend_first else x
                    else:
                        s = alpha * x + keep * s
                    vals.append(s)
            if current is not None:
                yield current.assign(**{name: vals})
        return run

    def summarise(*columns):
        xs = [float(x) for x in columns[-1]]
        s = xs[0]
        for x in xs:
            s = alpha * x + keep * s
        return xs[0], float(len(xs)), s

    def chainer(by):
        def run(batches):
            s = None
            for pdf, a, b, new in _groups(batches, by):
                if new:
                    s = None
                part, entry = pdf.iloc[a:b], []
                for first, n, end in zip(part["__first"], part["__n"], part["__end"]):
                    entry.append(float("nan") if s is None else s)
                    s = end if s is None else end + keep ** n * (s - first)
                yield part.assign(__entry=entry).drop(columns=["__first", "__n", "__end"])
        return run

    names = ["__first", "__n", "__end"]
    report = (lambda by: _chunk_reporter(by, [value], names, summarise), [*order, value],
              [T.StructField(n, T.DoubleType()) for n in names])
    return _fold(df, keys, order, chunk_s, walker, out, report, chainer, T.DoubleType())


def _groups(batches, keys):
    """Consecutive rows of one key out of sorted batches.

    Yields (batch, first row, one past the last row, starts a new key). A key may
    run on into later batches.
    """
    before = None
    for pdf in batches:
        n = len(pdf)
        if n == 0:
            continue
        if keys:
            ids = pdf[keys].astype(object).where(pdf[keys].notna(), None)
            last = ids.shift()
            new = ((ids != last) & ~(ids.isna() & last.isna())).any(axis=1).to_numpy()
            new[0] = before is None or tuple(ids.iloc[0]) != before
            before = tuple(ids.iloc[-1])
        else:
            import numpy as np
            new = np.zeros(n, dtype=bool)
            new[0] = before is None
            before = ()
        starts = [0] + [k for k in new.nonzero()[0].tolist() if k > 0]
        for a, b in zip(starts, [*starts[1:], n]):
            yield pdf, a, b, bool(new[a])


def key_changes(batch, keys):
    """Rows of an Arrow batch whose key differs from the row before; NULL equals NULL."""
    import numpy as np
    import pyarrow.compute as pc
    new = np.zeros(batch.num_rows, bool)
    for k in keys:
        now, before = batch.column(k).slice(1), batch.column(k).slice(0, max(0, batch.num_rows - 1))
        unlike = pc.fill_null(pc.not_equal(now, before), False)
        new[1:] |= pc.or_(unlike, pc.xor(now.is_null(), before.is_null())).to_numpy(zero_copy_only=False)
    return new


def whole_groups(batches, keys):
    """One Arrow batch per group of sorted batches; a group that runs on into later batches is joined."""
    import pyarrow as pa
    held, last = [], None

    def joined():
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        starts = [0, *key_changes(batch, keys).nonzero()[0].tolist()]
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            key = tuple(batch.column(k)[a].as_py() for k in keys)
            if held and key != last:
                yield joined()
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield joined()
