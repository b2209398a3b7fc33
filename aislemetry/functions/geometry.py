"""Image and floor geometry as column expressions."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from aislemetry.schema import FULL_H, FULL_W, HEAT_CELL_M


def foot_point(x, y, w, h):
    """Ground contact of a box in whole pixels."""
    return (F.col(x) + F.floor(F.col(w) / 2)).cast("bigint"), (F.col(y) + F.col(h)).cast("bigint")


def foot_point_float(x, y, w, h):
    return F.col(x) + F.col(w) / 2.0, F.col(y) + F.col(h)


def project(matrix, u: Column, v: Column):
    """Apply a 3x3 projective map given as nine numbers (row major)."""
    m = [float(c) for row in np.asarray(matrix, dtype=float).reshape(3, 3) for c in row]
    num = [u * m[3 * i] + v * m[3 * i + 1] + F.lit(m[3 * i + 2]) for i in range(3)]
    return F.try_divide(num[0], num[2]), F.try_divide(num[1], num[2])


def image_to_floor(matrix, u, v):
    return project(matrix, u, v)


def floor_to_image(matrix, x, y):
    return project(np.linalg.inv(np.asarray(matrix, dtype=float).reshape(3, 3)), x, y)


def heatmap_index(x: Column, y: Column):
    return F.floor(x / HEAT_CELL_M).cast("bigint"), F.floor(y / HEAT_CELL_M).cast("bigint")


def box_iou(a, b) -> Column:
    """IoU of two (x, y, w, h) column tuples; 0 when disjoint or degenerate."""
    ax, ay, aw, ah = a
    bx, by, bw, bh = b
    iw = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    ih = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    inter = iw * ih
    union = aw * ah + bw * bh - inter
    return F.when(union > 0, F.try_divide(inter, union)).otherwise(F.lit(0.0))


def cross(ox, oy, ax, ay, bx, by) -> Column:
    return (ax - ox) * (by - oy) - (ay - oy) * (bx - ox)


def segments_cross(p1, p2, q1, q2) -> Column:
    """Strict sign change on both segments."""
    d1, d2 = cross(*q1, *q2, *p1), cross(*q1, *q2, *p2)
    d3, d4 = cross(*p1, *p2, *q1), cross(*p1, *p2, *q2)
    return ((d1 > 0) != (d2 > 0)) & ((d3 > 0) != (d4 > 0))


def signed_distance(q1, q2, u: Column, v: Column) -> Column:
    dx, dy = q2[0] - q1[0], q2[1] - q1[1]
    length = F.sqrt(dx * dx + dy * dy)
    return F.coalesce(F.try_divide(dx * (v - q1[1]) - dy * (u - q1[0]), length), F.lit(0.0))


def side_of(q1, q2, u: Column, v: Column) -> Column:
    d = cross(*q1, *q2, u, v)
    return F.when(d > 0, 1).when(d < 0, -1).otherwise(0)


def crossing_direction(q1, q2, in_dir: Column, moved_to_positive: Column) -> Column:
    """'in' when the movement agrees with the configured inward direction.

    Image v grows downwards, so "up" is decreasing v.
    """
    nx, ny = -(q2[1] - q1[1]), q2[0] - q1[0]
    agrees = (F.when(in_dir == "up", -ny).when(in_dir == "down", ny)
              .when(in_dir == "left", -nx).when(in_dir == "right", nx)) > 0
    return F.when(moved_to_positive == agrees, "in").otherwise("out")


def content_rect(src_w, src_h):
    """Where a letterboxed video sits inside the full frame (plain numbers)."""
    scale = min(FULL_W / src_w, FULL_H / src_h)
    w, h = round(src_w * scale), round(src_h * scale)
    x0, y0 = (FULL_W - w) // 2, (FULL_H - h) // 2
    return x0, y0, x0 + w, y0 + h


def near_edge(u: Column, v: Column, rect, band=24) -> Column:
    x0, y0, x1, y1 = rect
    return (u <= x0 + band) | (u >= x1 - band) | (v <= y0 + band) | (v >= y1 - band)


def region_of(u: Column, v: Column, rect) -> Column:
    """One of nine named image regions, clamped at the borders."""
    x0, y0, x1, y1 = rect

    def third(value, lo, hi):
        step = max((hi - lo) / 3, 1)
        return F.least(F.lit(2), F.greatest(F.lit(0), ((value - lo) / step).cast("int"))) + 1

    rows = F.array(*map(F.lit, ("top", "middle", "bottom")))
    cols = F.array(*map(F.lit, ("left", "centre", "right")))
    return F.concat_ws("-", F.element_at(rows, third(v, y0, y1)),
                       F.element_at(cols, third(u, x0, x1)))
