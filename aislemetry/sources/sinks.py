"""Fan-out of events into per-type tables, and their files."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislemetry.operators.sequence import close_stockouts
from aislemetry.schema import LANE_CELLS, PAYLOAD_DDL, RUN_TABLES, TABLES
from aislemetry.session import shared_dir
from aislemetry.sources.validate import pack_cells


def _typed(events, kind):
    keep = [c for c in ("run_id", "t", "zone_id", "seq") if c in events.columns]
    return events.where(F.col("event_type") == kind).select(
        *keep, F.from_json("payload", PAYLOAD_DDL[kind]).alias("p"))


def with_run(events: DataFrame, run_id: str | None = None) -> DataFrame:
    """Attach a run id, and an order column where the source has none."""
    if run_id is not None:
        events = events.withColumn("run_id", F.lit(run_id))
    if "seq" not in events.columns:
        events = events.withColumn("seq", F.lit(0).cast("bigint"))
    return events


def route_events(events: DataFrame, run_id: str | None = None, pair=True) -> dict[str, DataFrame]:
    """Valid envelopes to one DataFrame per table.

    `pair` closes stock-outs here; a streaming sink stores start and end rows and
    pairs them when they are read. Lane readings with more cells than a lane has go,
    as envelopes with their reason, to `quarantine`.
    """
    e = with_run(events, run_id)
    p = {k: _typed(e, k) for k in PAYLOAD_DDL}
    lanes = e.where(F.col("event_type") == "lane_occ").withColumn(
        "p", F.from_json("payload", PAYLOAD_DDL["lane_occ"]))
    long_ = F.coalesce(F.size("p.cells") > LANE_CELLS, F.lit(False))
    out = {
        "quarantine": lanes.where(long_).drop("p").withColumn("reason", F.lit(f"more than {LANE_CELLS} cells")),
        "tripwire": p["tripwire"].select("run_id", "t", "p.dir"),
        "occupancy": p["occupancy"].select("run_id", "t", "p.count"),
        "visit": p["visit"].select(
            "run_id", "p.track_id", F.col("zone_id").alias("zone"), "p.t_enter", "p.t_exit",
            (F.col("p.t_exit") - F.col("p.t_enter")).alias("dwell_s")),
        "heatmap": upsert_heatmap(heatmap_rows(p["heatmap"])),
        "shelf_fill": p["shelf_fill"].select("run_id", "t", F.col("zone_id").alias("roi"), "p.fill"),
        "planogram_violation": p["planogram_violation"].select(
            "run_id", "t", F.col("zone_id").alias("roi"), F.col("p.expected_sku").alias("expected"),
            "p.observed"),
        "lane_occ": pack_cells(lanes.where(~long_).select("run_id", "t", "p.lane", "p.cells")).drop("cells_ok"),
        "queue_estimate": p["queue_estimate"].select("run_id", "t", "p.lane", "p.count", "p.pred_wait_s"),
        "pos_txn": p["pos_txn"].select("run_id", "t", "p.lane", "p.items", "p.amount", "p.zone_hint"),
        "alert": p["alert"].select("run_id", "t", "p.severity", "p.rule", "p.message",
                                   F.lit(0).cast("bigint").alias("acked")),
    }
    incident = p["stockout_start"].withColumn("kind", F.lit("start")).unionByName(
        p["stockout_end"].withColumn("kind", F.lit("end"))).select(
        "run_id", F.col("zone_id").alias("roi"), "p.sku", "t", "seq", "kind")
    out["stockout"] = close_stockouts(incident) if pair else incident
    return out


def heatmap_rows(typed: DataFrame) -> DataFrame:
    """One row per published tile."""
    h = typed.select("run_id", "t", "seq", "p.t_bucket", F.explode("p.tiles").alias("tile"))
    return h.select("run_id", "t_bucket", F.col("tile")[0].alias("gx"), F.col("tile")[1].alias("gy"),
                    F.col("tile")[2].alias("count"), "t", "seq")


def upsert_heatmap(rows: DataFrame) -> DataFrame:
    """Last write wins per (run, minute, cell)."""
    return rows.groupBy("run_id", "t_bucket", "gx", "gy").agg(
        F.max_by("count", F.struct("t", "seq")).alias("count"))


def write_tables(tables: dict[str, DataFrame], base: str, mode="append"):
    """Parquet tables partitioned by run, the unit of pruning and deletion.

    With `mode` "replace" the runs at hand take the place of what is there of them, other runs stay: a load that is
    repeated leaves the same rows.
    """
    for name, df in tables.items():
        writer = df.write.partitionBy("run_id")
        if mode == "replace":
            writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        else:
            writer = writer.mode(mode)
        writer.parquet(f"{base}/{name}")


def staged(events: DataFrame, folder: str) -> DataFrame:
    """Events written by type in one pass over their source; each table then reads its own type's files only."""
    events.write.mode("overwrite").partitionBy("event_type").parquet(folder)
    return events.sparkSession.read.schema(events.schema).parquet(folder).select(*events.columns)


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{base}/{name}")


def load_history(spark: SparkSession, events: DataFrame, base: str, clipset="history") -> DataFrame:
    """Bulk-load event history of many stores, each under its own run id.

    events: envelope plus run_id. The source is read once, into files by event type in the shared folder; loading a
    run again replaces it. Returns the run registry rows it wrote.
    """
    events = staged(events, shared_dir(spark, "staged"))
    tables = route_events(events)
    runs = events.groupBy("run_id", "store_id").agg(F.lit(0.0).alias("started")).withColumn(
        "clipset", F.lit(clipset))
    write_tables({**tables, "run": runs}, base, "replace")
    return runs


def start_run(spark: SparkSession, base: str, run_id, store_id, clipset, started: float):
    row = spark.createDataFrame([(run_id, store_id, float(started), clipset)], TABLES["run"])
    row.write.mode("append").partitionBy("run_id").parquet(f"{base}/run")


def list_runs(runs: DataFrame, in_flight: DataFrame | None = None) -> DataFrame:
    """Newest first; runs still in flight come first and carry their state."""
    if in_flight is None:
        return runs.orderBy(F.col("started").desc())
    known = runs.join(in_flight.drop("store_id", "started", "clipset"), "run_id", "left").withColumn(
        "__rank", F.lit(1))
    new = in_flight.join(runs.select("run_id"), "run_id", "left_anti").withColumn("__rank", F.lit(0))
    return known.unionByName(new, allowMissingColumns=True).orderBy(
        "__rank", F.col("started").desc()).drop("__rank")


def latest_run(runs: DataFrame, keys=()) -> DataFrame:
    return runs.groupBy(*keys).agg(F.max_by("run_id", F.struct("started", "run_id")).alias("run_id"))


def delete_run(spark: SparkSession, base: str, run_id: str) -> list[str]:
    """Drop the run's partition from every run table; other runs are untouched."""
    jvm = spark._jvm
    gone = []
    for name in RUN_TABLES:
        path = jvm.org.apache.hadoop.fs.Path(f"{base}/{name}/run_id={run_id}")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path) and fs.delete(path, True):
            gone.append(name)
    return gone


def without_run(df: DataFrame, run_id: str) -> DataFrame:
    """The same on a table that is not partitioned by run."""
    return df.where(~F.col("run_id").eqNullSafe(F.lit(run_id)))


def write_report(tables: dict[str, DataFrame], summary: DataFrame | None, folder: str):
    """One CSV folder with header per question, and a JSON summary."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
    if summary is not None:
        summary.write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/summary")
