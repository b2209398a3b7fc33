"""Retention, minute rollup and incremental export."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislemetry.functions.timebuckets import minute_start
from aislemetry.schema import LANE_CELLS, TABLES

KEEP_S = 7 * 86400.0
ROLLUP_S = 3600.0


def retention(df: DataFrame, now: float, keep_s=KEEP_S) -> DataFrame:
    """Rows young enough to keep."""
    return df.where(F.col("t") >= now - keep_s)


def _split(df, now):
    old = (F.col("t") >= now - KEEP_S) & (F.col("t") < now - ROLLUP_S)
    return df.where(old), df.where(~old)


def rollup_fills(fills: DataFrame, now: float) -> DataFrame:
    """Readings between a week and an hour old become one mean per minute and facing."""
    old, rest = _split(fills.select("run_id", "t", "roi", "fill"), now)
    mean = old.groupBy("run_id", minute_start(F.col("t")).cast("double").alias("t"), "roi").agg(
        F.avg("fill").alias("fill"))
    return mean.unionByName(rest)


def rollup_lanes(lanes: DataFrame, now: float) -> DataFrame:
    """The same for lane cells: floor mean per cell, as sixteen plain sums."""
    old, rest = _split(lanes.select("run_id", "t", "lane", "cells"), now)
    g = old.groupBy("run_id", minute_start(F.col("t")).cast("double").alias("t"), "lane").agg(
        F.count("*").alias("__n"), *[F.sum(F.col("cells")[i]).alias(f"__s{i}") for i in range(LANE_CELLS)])
    cells = F.array(*[F.floor(F.col(f"__s{i}") / F.col("__n")).cast("bigint") for i in range(LANE_CELLS)])
    return g.select("run_id", "t", "lane", cells.alias("cells")).unionByName(rest)


def sync_increment(kpi: DataFrame, cursor: int) -> DataFrame:
    """Rows newer than the cursor. Only aggregates leave the run, never tracks."""
    return kpi.where(F.col("t_bucket") > cursor).select("run_id", "t_bucket", "key", "value")


def next_cursor(kpi: DataFrame, cursor: int) -> DataFrame:
    return sync_increment(kpi, cursor).agg(
        F.coalesce(F.max("t_bucket"), F.lit(cursor).cast("bigint")).alias("last_bucket"))


def read_cursor(spark: SparkSession, state_path: str, key="kpi") -> int:
    try:
        state = spark.read.schema(TABLES["sync_state"]).parquet(state_path)
        row = state.where(F.col("key") == key).agg(F.max("last_bucket").alias("b")).first()
    except Exception as e:                                     # no state written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return 0
    return row.b if row.b is not None else 0


def sync(spark: SparkSession, kpi: DataFrame, out_path: str, state_path: str, key="kpi",
         clock_synced=True) -> int:
    """Deliver pending rows, then advance the cursor. Returns the cursor.

    The delivery is one folder per cursor, overwritten on retry; the cursor row
    is appended only after it was written, so a failure re-sends and never skips.
    """
    cursor = read_cursor(spark, state_path, key)
    if not clock_synced:
        return cursor
    latest = next_cursor(kpi, cursor).first().last_bucket
    if latest == cursor:
        return cursor
    (sync_increment(kpi, cursor).where(F.col("t_bucket") <= latest)
     .write.mode("overwrite").parquet(f"{out_path}/after={cursor}"))
    spark.createDataFrame([(key, latest)], TABLES["sync_state"]).write.mode("append").parquet(state_path)
    return latest
