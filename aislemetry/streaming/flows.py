"""Streams of event envelopes: checks, fan-out, windowed figures, file runs."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislemetry.schema import PLAUSIBLE_EPOCH
from aislemetry.session import shared_dir
from aislemetry.sources import sinks
from aislemetry.sources.validate import check_events


def deduplicated(events: DataFrame, delay="10 minutes", keys=("store_id", "event_type", "zone_id", "t",
                                                              "payload")) -> DataFrame:
    """Envelopes once each; repeats are recognised within the watermark."""
    ts = F.timestamp_micros((F.col("t") * 1000000).cast("bigint"))
    return events.withColumn("ts", ts).withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def sink_events(events: DataFrame, base: str, checkpoint: str, run_id: str | None = None,
                min_time: float | None = PLAUSIBLE_EPOCH, trigger=None, done=None):
    """Check envelopes and append them to one table per type, bad ones to `quarantine`.

    A retried micro-batch overwrites its own `batch_id=` folder, so every event
    lands exactly once. The batch is persisted because each table reads it.
    `done` is called with every checked batch (subscribers by event type).
    """
    def write(batch: DataFrame, batch_id: int):
        checked = check_events(batch, min_time).persist()
        try:
            good = checked.where(F.col("reason").isNull()).drop("reason", "missing", "unexpected")
            tables = sinks.route_events(good, run_id, pair=False)
            tables["quarantine"] = checked.where(F.col("reason").isNotNull()).unionByName(
                tables["quarantine"], allowMissingColumns=True)
            for name, df in tables.items():
                df.write.mode("overwrite").parquet(f"{base}/{name}/batch_id={batch_id}")
            if done is not None:
                done(good, batch_id)
        finally:
            checked.unpersist()

    return (events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "1 second"})).start())


def read_sunk(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A table of `sink_events`; repeated heatmap keys resolve to the last batch."""
    df = spark.read.parquet(f"{base}/{name}")
    if name == "heatmap":
        return df.groupBy("run_id", "t_bucket", "gx", "gy").agg(F.max_by("count", "batch_id").alias("count"))
    return df.drop("batch_id")


def windowed_kpis(events: DataFrame, delay="10 minutes", length="15 minutes") -> DataFrame:
    """Tumbling event-time figures: run_id, t_bucket, event_type, n, total.

    events: run_id, t, event_type, amount. Late rows within the watermark are
    still counted; later ones show in the query's progress as dropped.
    """
    ts = F.timestamp_micros((F.col("t") * 1000000).cast("bigint"))
    w = events.withColumn("ts", ts).withWatermark("ts", delay)
    g = w.groupBy("run_id", F.window("ts", length).alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.sum("amount").alias("total"))
    return g.select("run_id", F.unix_timestamp("w.start").alias("t_bucket"), "event_type", "n", "total")


def sliding_arrivals(entries: DataFrame, delay="10 minutes", length="5 minutes", slide="1 minute") -> DataFrame:
    """Entries per second over a sliding window."""
    ts = F.timestamp_micros((F.col("t") * 1000000).cast("bigint"))
    g = entries.withColumn("ts", ts).withWatermark("ts", delay).groupBy(
        "run_id", F.window("ts", length, slide).alias("w")).agg(F.count("*").alias("arrivals"))
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return g.select("run_id", F.unix_timestamp("w.end").alias("t"), "arrivals",
                    (F.col("arrivals") / seconds).alias("lambda_per_s"))


def run_available(stream: DataFrame, mode="append", name="stream", closing=None) -> DataFrame:
    """Run a stream over everything available, to a table in the shared folder.

    `closing(spark, checkpoint)` gives the rows that the stopped stream still holds (`folds.held`); they follow.
    """
    spark = stream.sparkSession
    out, state = shared_dir(spark, f"{name}-out"), shared_dir(spark, f"{name}-state")
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(out)
    return rows if closing is None else rows.unionByName(closing(spark, state))


def upsert(stream: DataFrame, base: str, checkpoint: str, trigger=None):
    """Write every change of an aggregation (update mode); `latest` resolves each key to its last change.

    A micro-batch holds one row per changed key and replaces the folder that an earlier attempt of it left, so a key
    is present once however often it changed or a batch was retried, and open windows are there too.
    """
    def write(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{base}/batch_id={batch_id}")

    return (stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "1 second"})).start())


def latest(spark: SparkSession, base: str, keys, schema) -> DataFrame:
    """The table that `upsert` keeps below `base`: the last change of every key."""
    names = [f.name for f in schema.fields]
    rows = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema.fields)}, batch_id long"
                             ).option("basePath", base).parquet(f"{base}/batch_id=*")
    values = [c for c in names if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("__last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"__last.{c}").alias(c) for c in names])


def run_upserts(stream: DataFrame, keys, name="upsert") -> DataFrame:
    """`upsert` over everything available, as a table."""
    spark = stream.sparkSession
    base = shared_dir(spark, f"{name}-out")
    upsert(stream, base, shared_dir(spark, f"{name}-state"), {"availableNow": True}).awaitTermination()
    return latest(spark, base, keys, stream.schema)


def split_late(events: DataFrame, base: str, checkpoint: str, delay_s: float, trigger=None):
    """Write rows to `on_time` or, where they are behind the watermark, to `late`; no row is lost.

    The watermark of a batch is the greatest time of all earlier batches less the delay, as the engine's own is. The
    greatest time of every batch is kept below `marks`, so a retried batch is split as it was at first.
    """
    spark = events.sparkSession

    def write(batch: DataFrame, batch_id: int):
        top = None
        if batch_id:
            marks = spark.read.schema("t double, batch_id long").option("basePath", f"{base}/marks").parquet(
                f"{base}/marks/batch_id=*")
            top = marks.where(F.col("batch_id") < batch_id).agg(F.max("t")).first()[0]
        late = F.lit(False) if top is None else F.coalesce(F.col("t") < top - delay_s, F.lit(False))
        batch.persist()
        try:
            batch.agg(F.max("t").alias("t")).write.mode("overwrite").parquet(f"{base}/marks/batch_id={batch_id}")
            for name, rows in (("on_time", batch.where(~late)), ("late", batch.where(late))):
                rows.write.mode("overwrite").parquet(f"{base}/{name}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return (events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "1 second"})).start())


def replayed(rows: DataFrame, part, parts: int, files=2) -> DataFrame:
    """A stream of `rows` whose micro-batch k holds the rows with `part` k: an arrival order of one's own choice."""
    spark = rows.sparkSession
    folder = shared_dir(spark, "replay")
    for k in range(parts):
        rows.where(part == k).repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)
