"""Readers for events, sales exports, frames, dimensions and labelled truth."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislemetry.schema import DIMENSIONS, ENVELOPE, FRAME, MAX_BLOBS, store_keys


def read_events(spark: SparkSession, path, streaming=False, **options) -> DataFrame:
    """Event envelopes, one JSON object per line; bad lines land in `corrupt`."""
    reader = spark.readStream if streaming else spark.read
    # A nested payload object is kept as its JSON text.
    r = reader.schema(f"{ENVELOPE}, corrupt string").option(
        "mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt")
    for k, v in options.items():
        r = r.option(k, v)
    return r.json(path)


def read_pos_csv(spark: SparkSession, path, store_id: str) -> DataFrame:
    """A till export `t,lane,items,amount,zone_hint` as `pos_txn` envelopes."""
    rows = spark.read.schema("t double, lane bigint, items bigint, amount double, zone_hint string").option(
        "header", True).option("mode", "FAILFAST").csv(path)
    hint = F.nullif(F.col("zone_hint"), F.lit(""))
    payload = F.to_json(F.struct("lane", "items", "amount", hint.alias("zone_hint")),
                        {"ignoreNullFields": "false"})
    return rows.select("t", F.lit(store_id).alias("store_id"), F.lit("-").alias("stream"),
                       F.lit(None).cast("string").alias("zone_id"),
                       F.lit("pos_txn").alias("event_type"), payload.alias("payload"))


def read_frames(spark: SparkSession, path, fmt="json", streaming=False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(FRAME).format(fmt).load(path)


def detections(frames: DataFrame) -> DataFrame:
    """One row per used blob slot of each frame record."""
    used = F.least(F.coalesce("num_blobs", F.size("blobs")), F.lit(MAX_BLOBS))
    keep = [c for c in ("run_id", "store_id", "stream", "frame_id", "t", "t_ns", "flags")
            if c in frames.columns]
    b = frames.select(*keep, F.posexplode(F.slice("blobs", 1, used)).alias("k", "b"))
    return b.select(*keep, "k", *[F.col(f"b.{c}").cast("double").alias(c)
                                  for c in ("x", "y", "w", "h", "area")])


def roi_fills(frames: DataFrame, rois: DataFrame) -> DataFrame:
    """Fill per facing; the list position in `rois` is the slot in the record."""
    keep = [c for c in ("run_id", "store_id", "stream", "frame_id", "t") if c in frames.columns]
    f = frames.select(*keep, F.posexplode("roi_fill").alias("position", "fill"))
    on = store_keys(f, rois, "position")
    return f.join(rois.select(*on, F.col("id").alias("roi")), on).drop("position")


def lane_cells(frames: DataFrame, lanes: DataFrame) -> DataFrame:
    """Cells per lane, padded with zeros to 16.

    Lane tables hold at most 16 rows, so each array is bounded.
    """
    keep = [c for c in ("run_id", "store_id", "frame_id", "t") if c in frames.columns]
    f = frames.select(*keep, F.posexplode("lane_occupancy").alias("position", "v"))
    on = store_keys(f, lanes, "position")
    j = f.join(lanes.select(*on, F.col("lane").cast("bigint").alias("lane")), on)
    cells = F.transform(F.array_sort(F.collect_list(F.struct("position", "v"))), lambda s: s["v"])
    out = j.groupBy(*keep, "lane").agg(cells.cast("array<bigint>").alias("cells"))
    pad = F.array_repeat(F.lit(0).cast("bigint"), 16)
    return out.withColumn("cells", F.slice(F.concat("cells", pad), 1, 16))


def read_dimensions(spark: SparkSession, folder, store_id: str) -> dict[str, DataFrame]:
    """Dimension lists of one clipset folder with their list position.

    Each file is one JSON list; extra keys are ignored, missing files are empty.
    """
    out = {}
    for name, ddl in DIMENSIONS.items():
        text = spark.read.option("wholetext", True).text(f"{folder}/{name}.json")
        items = text.select(F.from_json("value", f"array<struct<{_struct(ddl)}>>").alias("a"))
        out[name] = items.select(F.posexplode("a").alias("position", "r")).select(
            F.lit(store_id).alias("store_id"), "position", "r.*")
    return out


def _struct(ddl):
    """`name type` pairs to `name:type` pairs, commas inside <> untouched."""
    fields, depth, cur = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            fields.append(cur)
            cur = ""
        else:
            cur += ch
    fields.append(cur)
    return ", ".join("{}: {}".format(*f.strip().split(" ", 1)) for f in fields)


def read_ground_truth(spark: SparkSession, path) -> dict[str, DataFrame]:
    """Labelled clips in either shape as normalised tables.

    Entries may carry a direction or sit in a separate exits list; occupancy may
    be `[t, count]` pairs or objects; visits come from people's zones. Clips
    without entries, occupancy or stock-outs are reported in `missing`.
    """
    raw = spark.read.schema(
        "clip string, entries array<string>, exits array<string>, occupancy array<string>, "
        "stockouts array<struct<facing:string,t_start:double,t_end:double>>, "
        "people array<struct<gt_id:bigint,zones:array<struct<zone:string,t_enter:double,t_exit:double>>>>"
    ).option("multiLine", True).json(path)
    raw = raw.withColumn("clip", F.coalesce("clip", F.lit("unknown")))
    return normalise_truth(raw)


def normalise_truth(raw: DataFrame) -> dict[str, DataFrame]:
    def listed(col):
        return raw.select("clip", F.posexplode(col).alias("pos", "item"))

    def number(obj, pair_index):
        """A field of an object, or the place in a pair."""
        as_pair = F.try_element_at(F.split(F.regexp_replace("item", r"[\[\]\s]", ""), ","),
                                   F.lit(pair_index + 1))
        return F.coalesce(F.get_json_object("item", f"$.{obj}"),
                          F.when(F.col("item").startswith("["), as_pair)).cast("double")

    direction = F.coalesce(F.get_json_object("item", "$.dir"), F.lit("in"))
    into = listed("entries").select("clip", number("t", 0).alias("t"), F.when(
        direction == "out", "out").otherwise("in").alias("dir"))
    out = listed("exits").select("clip", number("t", 0).alias("t"), F.lit("out").alias("dir"))
    occupancy = listed("occupancy").select(
        "clip", number("t", 0).alias("t"), number("count", 1).cast("bigint").alias("count"))
    visits = raw.select("clip", F.explode("people").alias("p")).select(
        "clip", "p.gt_id", F.explode("p.zones").alias("z")).select("clip", "gt_id", "z.*")
    stockouts = raw.select("clip", F.posexplode("stockouts").alias("pos", "s")).select(
        "clip", "pos", "s.*")
    missing = raw.select("clip", F.array_compact(F.array(*[
        F.when(F.col(c).isNull(), c) for c in ("entries", "occupancy", "stockouts")])).alias("missing"))
    return {"entries": into.unionByName(out), "occupancy": occupancy, "visits": visits,
            "stockouts": stockouts, "missing": missing.where(F.size("missing") > 0)}
