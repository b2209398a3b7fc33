"""Point to zone through a rasterised floor: an equi-join, not a spatial one."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislemetry.schema import HEAT_CELL_M

PAD_M = 1.0


def _with_origin(df, origin, keys):
    """Add the raster origin of the row's store, or of the one store there is."""
    if keys:
        return df.join(origin, keys)
    return df.withColumns({c: origin.select(c).scalar() for c in ("ox", "oy")})


def zone_raster(zones: DataFrame, keys=()) -> tuple[DataFrame, DataFrame]:
    """Cells whose centre lies in a polygon, and the raster origin.

    zones: keys, position, id, polygon. A later polygon overrides an earlier one.
    """
    keys = list(keys)
    corner = zones.select(*keys, F.explode("polygon").alias("p"))
    origin = corner.groupBy(*keys).agg((F.min(F.col("p")[0]) - PAD_M).alias("ox"),
                                       (F.min(F.col("p")[1]) - PAD_M).alias("oy"))
    z = _with_origin(zones, origin, keys)

    def span(i, o):
        lo = F.array_min(F.transform("polygon", lambda p: p[i]))
        hi = F.array_max(F.transform("polygon", lambda p: p[i]))
        return F.sequence(F.floor((lo - F.col(o)) / HEAT_CELL_M).cast("bigint"),
                          F.ceil((hi - F.col(o)) / HEAT_CELL_M).cast("bigint"))

    z = z.withColumn("gx", F.explode(span(0, "ox"))).withColumn("gy", F.explode(span(1, "oy")))
    px = F.col("ox") + (F.col("gx") + 0.5) * HEAT_CELL_M
    py = F.col("oy") + (F.col("gy") + 0.5) * HEAT_CELL_M
    n = F.size("polygon")
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        F.col("polygon")[i].alias("a"), F.col("polygon")[(i + 1) % n].alias("b")))

    def hits(e):
        ax, ay, bx, by = e["a"][0], e["a"][1], e["b"][0], e["b"][1]
        cut = (bx - ax) * F.try_divide(py - ay, by - ay) + ax
        return ((ay > py) != (by > py)) & (px < cut)

    inside = F.size(F.filter(edges, hits)) % 2 == 1
    cells = z.where(inside).groupBy(*keys, "gx", "gy").agg(F.max_by("id", "position").alias("zone"))
    return cells, origin


def zone_of(points: DataFrame, zones: DataFrame, x="X", y="Y", keys=()) -> DataFrame:
    """Add `zone`, NULL outside every polygon.

    The raster's size is the floor area in 0.25 m cells. Nothing is hinted:
    Spark broadcasts it when it measures small and joins by cell otherwise.
    """
    keys = list(keys)
    cells, origin = zone_raster(zones, keys)
    p = _with_origin(points, origin, keys)
    p = p.withColumns({"gx": F.floor((F.col(x) - F.col("ox")) / HEAT_CELL_M).cast("bigint"),
                       "gy": F.floor((F.col(y) - F.col("oy")) / HEAT_CELL_M).cast("bigint")})
    return p.join(cells, [*keys, "gx", "gy"], "left").select(*points.columns, "zone")
