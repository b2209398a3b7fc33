"""The whole dashboard as a dict of DataFrames, from one set of tables."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislemetry.functions import labels as L
from aislemetry.plans import kpis as K
from aislemetry.schema import with_store


def dashboard(t: dict[str, DataFrame], now: float | None = None, run_id: str | None = None, bounds=None,
              tz="UTC") -> dict[str, DataFrame]:
    """Every tile, for one run or for all.

    `t` holds run, occupancy, tripwire, shelf_fill, visit, heatmap, stockout,
    queue_estimate, pos_txn, alert, planogram and optionally rois and zones;
    planogram and rois may have rows per store. Open incidents are priced up to
    `now` and the hours are those of its day; by default it is one second past the
    last event of each run. Zones get their labels when `bounds` are given.
    """
    if run_id is not None:
        t = {n: d.where(F.col("run_id") == run_id) if "run_id" in d.columns else d for n, d in t.items()}
    window = K.run_window(t["run"], t["occupancy"], t["tripwire"], t["shelf_fill"], t["visit"])
    tiles = K.heatmap(t["heatmap"])
    incidents, until = t["stockout"], now
    if "store_id" in t["planogram"].columns:
        incidents = with_store(incidents, t["run"])
    if now is None:
        incidents, until = K.with_now(incidents, window), "now"
    tiles_of_floor = {"zone_labels": K.zone_labels(t["zones"], bounds)} if "zones" in t and bounds is not None else {}
    return {
        **tiles_of_floor,
        "window": window,
        "live": K.live_summary(t["run"], t["occupancy"]),
        "totals": K.footfall_totals(t["run"], t["tripwire"]),
        "shoppers": K.shopper_totals(t["visit"]),
        "zones": K.dwell_by_zone(t["visit"]),
        "queue": K.queue_status(t["queue_estimate"]),
        "shelf": K.shelf_board(t["shelf_fill"], t["stockout"], t.get("rois"), t["run"],
                               t["planogram"] if "facing" in t["planogram"].columns else None),
        "stockouts": K.recent_stockouts(incidents, t["planogram"], until),
        "lost_revenue": K.lost_revenue(incidents, t["planogram"], until),
        "replenishment": K.replenishment_list(incidents, t["planogram"], 5),
        "alerts": K.alerts(t["alert"], open_only=False, n=12),
        "heatmap": K.heatmap_grid(tiles, bounds),
        "footfall_hourly": K.footfall_last_day(t["tripwire"], window, tz) if now is None else
        K.footfall_by_hour(t["tripwire"], day=now, tz=tz, zero_fill=True),
        "footfall_spark": K.footfall_spark(t["tripwire"], window),
        "revenue": K.revenue(t["pos_txn"]),
        "funnel": K.funnel(t["run"], t["tripwire"], t["visit"], t["occupancy"], t["pos_txn"]),
    }


def _figures(df, tile, item, measures, label=None):
    """One row per figure of a tile: what it is of, what it says, and a text that belongs to it."""
    text = F.lit(None).cast("string") if label is None else F.concat_ws(" | ", *[c for c in label if c in df.columns])
    return df.select("run_id", F.lit(tile).alias("tile"), F.concat_ws(":", *item).alias("item"), text.alias("label"),
                     F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value"))
                                        for m in measures])))


# Tile -> what a figure is of, the figures, and the texts beside them.
TILES = {
    "window": ([], ["t0", "t1"], None),
    "live": ([], ["occupancy", "occupancy_t"], None),
    "totals": ([], ["entries", "exits", "net"], None),
    "shoppers": ([], ["shoppers", "avg_dwell_s", "browsed", "engaged"], None),
    "zones": (["zone"], ["visits", "median_dwell_s", "p90_dwell_s"], None),
    "queue": (["lane"], ["count", "pred_wait_s"], None),
    "shelf": (["roi"], ["fill"], ["state", "sku", "name"]),
    "stockouts": (["facing", "sku"], ["duration_s", "lost"], ["status"]),
    "lost_revenue": ([], ["lost_revenue"], None),
    "replenishment": (["rank"], ["revenue_rate"], ["roi", "sku"]),
    "alerts": (["rule"], ["t"], ["severity", "message"]),
    "heatmap": (["row", "col"], ["heat"], None),
    "footfall_hourly": (["hour"], ["entries"], None),
    "footfall_spark": (["bucket"], ["entries"], None),
    "revenue": ([], ["transactions", "revenue"], None),
    "funnel": (["label"], ["value", "pct"], None),
}


def board(t: dict[str, DataFrame], **options) -> DataFrame:
    """The whole dashboard of every run as one table: run_id, tile, item, label, measure, value.

    `options` are those of `dashboard`. A run has as many rows as its zones, lanes and facings and the fixed lists
    ask for, whatever the number of its events; each tile aggregates before it meets the others.
    """
    d = dashboard(t, **options)
    return reduce(DataFrame.unionByName, [_figures(d[tile], tile, *spec) for tile, spec in TILES.items()])


def documents(t: dict[str, DataFrame], **options) -> DataFrame:
    """One row per run: `run_id` and an array of figures per tile, ordered by item, measure, value and label.

    A tile without figures is an empty array. The lists are as bounded as the rows of `board`.
    """
    rows = board(t, **options)
    figure = F.struct("item", "measure", "value", "label")
    arrays = [F.sort_array(F.collect_list(F.when(F.col("tile") == tile, figure))).alias(tile) for tile in TILES]
    return t["run"].select("run_id").distinct().join(rows.groupBy("run_id").agg(*arrays), "run_id", "left")


def headline(t: dict[str, DataFrame]) -> DataFrame:
    """The metric cards of every run in one row each, with their traffic light."""
    parts = [K.live_summary(t["run"], t["occupancy"]), K.footfall_totals(t["run"], t["tripwire"]),
             K.shopper_totals(t["visit"]), K.revenue(t["pos_txn"])]
    conv = K.funnel(t["run"], t["tripwire"], t["visit"], t["occupancy"], t["pos_txn"]).where(
        F.col("step") == 3).select("run_id", F.col("pct").alias("conversion_rate"))
    j = reduce(lambda a, b: a.join(b, "run_id", "left"), [*parts, conv])
    lights = L.kpi_status(F.col("occupancy"), F.col("net"), F.col("avg_dwell_s") / 60,
                          F.col("conversion_rate"))
    return j.withColumns(lights).withColumn("avg_dwell", L.format_duration(F.col("avg_dwell_s")))
