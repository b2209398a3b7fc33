"""Time buckets over epoch seconds."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minute_index(t: Column) -> Column:
    return F.floor(t / 60).cast("bigint")


def minute_start(t: Column) -> Column:
    return (F.floor(t / 60) * 60).cast("bigint")


def quarter_start(t: Column) -> Column:
    return (F.floor(t / 900) * 900).cast("bigint")


def utc_day(t: Column) -> Column:
    return F.floor(t / 86400).cast("bigint")


def epoch_seconds(col: str) -> Column:
    """Epoch seconds of a zone-less UTC timestamp, whatever the session zone."""
    return F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', "
                  f"cast({col} AS timestamp_ntz))") / 1e6


def local_midnight(t: Column, tz: str = "UTC") -> Column:
    """Epoch seconds of the local midnight at or before `t`.

    Zone-less timestamps keep the session's time zone out of the result.
    """
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    utc = F.timestamp_add("MICROSECOND", (t * 1000000).cast("bigint"), zero)
    day = F.convert_timezone(F.lit("UTC"), F.lit(tz), utc).cast("date")
    start = F.convert_timezone(F.lit(tz), F.lit("UTC"), day.cast("timestamp_ntz"))
    return F.timestamp_diff("MICROSECOND", zero, start) / 1000000


def frame_bucket(frame: Column, fps: float, seconds: float) -> Column:
    return F.floor(frame / max(int(round(fps * seconds)), 1)).cast("bigint")
