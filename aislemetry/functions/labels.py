"""Labels, percentages and display strings."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shelf_state(fill: Column, empty_below=60, low_below=110) -> Column:
    return (F.when(fill.isNull(), "unknown").when(fill < empty_below, "empty")
            .when(fill < low_below, "low").when(fill < 180, "partial").otherwise("full"))


def engagement_label(dwell: Column, converted: Column) -> Column:
    return (F.when((dwell >= 120) & ~converted, "confused")
            .when(converted, "engaged").otherwise("ignored"))


def pct_capped(n: Column, total: Column) -> Column:
    # `least` skips NULLs, so an empty total is decided before it.
    share = F.round(F.least(F.lit(100.0), F.try_divide(n * 100.0, total)), 1)
    return F.when(total != 0, share).otherwise(0.0)


def kpi_status(occupancy, net, dwell_min, conversion) -> dict[str, Column]:
    """Traffic light per tile; empty string is neutral."""
    return {
        "occupancy_status": F.when(occupancy >= 22, "amber").otherwise(""),
        "footfall_status": F.when(net >= 22, "amber").otherwise(""),
        "dwell_status": F.when(dwell_min >= 6.8, "red").when(dwell_min >= 5.5, "amber").otherwise(""),
        "conversion_status": (F.when(conversion < 9.5, "red").when(conversion < 11.0, "amber")
                              .otherwise("")),
    }


def format_duration(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor(F.coalesce(seconds, F.lit(0.0)) + 0.5)).cast("bigint")
    return (F.when(s >= 3600, F.format_string("%dh %dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))
            .otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "),
                                F.lpad((s % 60).cast("string"), 2, "0"), F.lit("s"))))


def format_wait(seconds: Column) -> Column:
    s = F.coalesce(seconds, F.lit(0.0))
    return F.concat(F.floor(s / 60).cast("bigint").cast("string"), F.lit(":"),
                    F.lpad(F.floor(s % 60 + 0.5).cast("bigint").cast("string"), 2, "0"))
