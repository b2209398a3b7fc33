import math

import pytest
from pyspark.sql import functions as F

from aislemetry.functions import geometry as G
from aislemetry.functions import labels as L
from aislemetry.functions import queueing as Q
from aislemetry.functions import timebuckets as TB
from aislemetry.plans import kpis as K


def one(spark, *cols):
    r = spark.range(1).select(*cols).first()
    return r[0] if len(cols) == 1 else tuple(r)


def lit(*vs):
    return [F.lit(v) for v in vs]


def test_erlang_textbook_values(spark):
    c, w, sat, inf = one(spark, Q.erlang_c(*lit(0.5, 1)), Q.erlang_wait(*lit(0.5, 1, 2.0)),
                         Q.erlang_c(*lit(3.0, 2)), Q.erlang_wait(*lit(3.0, 2, 1.0)))
    assert c == pytest.approx(0.5) and w == pytest.approx(0.5) and sat == 1.0 and math.isinf(inf)
    assert one(spark, Q.erlang_c(*lit(1.0, 2))) == pytest.approx(1 / 3)


def test_invalid_queue_input_is_null(spark):
    assert one(spark, Q.erlang_c(*lit(1.0, 0)), Q.erlang_c(*lit(-1.0, 1)), Q.erlang_wait(*lit(0.5, 1, 0.0))) == (None,) * 3


def test_required_servers(spark):
    got = one(spark, *[Q.required_servers(*lit(*a)) for a in
                       ((0.9, 1.0, 180.0), (0.9, 1.0, 5.0), (0.0, 1.0, 5.0), (100.0, 1.0, 1.0))])
    assert got == (1, 2, 1, 16)


def test_staffing_advice_only_adds(spark):
    a = one(spark, Q.staffing_advice(*lit(1, 0.9, 1.0, 5.0)))
    assert (a.open, a.lambda_per_min, a.mu_per_min) == (2, 54.0, 60.0)
    assert one(spark, Q.staffing_advice(*lit(2, 0.9, 1.0, 5.0))) is None


def test_counts(spark):
    cells = F.array(*lit(41, 40, 90, 0))
    assert one(spark, Q.naive_count(cells), Q.predict_count(cells, 0.01, -9.0)) == (1.6, 0.0)


def test_regression_cases(spark):
    d = spark.createDataFrame([("line", 1.0, 3.0), ("line", 2.0, 5.0), ("line", 4.0, 9.0), ("flat", 1.0, 4.0),
                               ("flat", 2.0, 4.0), ("wall", 3.0, 1.0), ("wall", 3.0, 5.0)], "run_id string, x double, y double")
    got = {r.run_id: (r.a, r.b, r.r2, r.mae) for r in K.fit_count_regression(d).collect()}
    assert got["line"] == (2.0, 1.0, 1.0, 0.0)
    assert got["flat"] == (0.0, 4.0, 1.0, 0.0)
    assert got["wall"] == (0.0, 3.0, 0.0, 2.0)


def test_iou_and_foot(spark):
    a, b, far = lit(0.0, 0.0, 10.0, 10.0), lit(5.0, 0.0, 10.0, 10.0), lit(20.0, 0.0, 5.0, 5.0)
    none = lit(0.0, 0.0, 0.0, 0.0)
    assert one(spark, G.box_iou(a, b), G.box_iou(a, far), G.box_iou(none, none)) == (pytest.approx(1 / 3), 0.0, 0.0)


def test_homography_round_trip(spark):
    h = [[0.01, 0.002, 1.0], [0.0, -0.02, 6.0], [0.0001, 0.0, 1.0]]
    x, y = G.image_to_floor(h, F.lit(100.0), F.lit(50.0))
    u, v = G.floor_to_image(h, x, y)
    assert one(spark, u, v) == (pytest.approx(100.0), pytest.approx(50.0))


def test_heatmap_index_floors_negatives(spark):
    assert one(spark, *G.heatmap_index(F.lit(-0.1), F.lit(0.26))) == (-1, 1)


def test_content_rect_letterbox():
    assert G.content_rect(1920, 1080) == (0, 60, 640, 420)


def test_local_midnight_with_dst(spark):
    # 2024-03-31 is the 23 h spring day in Berlin; 12:00 UTC is 14:00 there.
    t = 1711886400.0
    assert one(spark, TB.local_midnight(F.lit(t), "Europe/Berlin")) == 1711839600.0
    assert one(spark, TB.local_midnight(F.lit(t), "Asia/Kolkata")) == 1711823400.0


def test_labels(spark):
    assert one(spark, *[L.shelf_state(F.lit(v)) for v in (59, 60, 109, 110, 180)]) == (
        "empty", "low", "low", "partial", "full")
    assert one(spark, L.shelf_state(F.lit(None).cast("double"))) == "unknown"
    assert one(spark, L.pct_capped(*lit(5, 0)), L.pct_capped(*lit(1, 3)), L.pct_capped(*lit(9, 3))) == (0.0, 33.3, 100.0)
    assert one(spark, L.format_duration(F.lit(3725.0)), L.format_duration(F.lit(65.4)), L.format_wait(F.lit(65.0))) == (
        "1h 2m", "1m 05s", "1:05")
    s = L.kpi_status(*lit(22, 21, 6.0, 9.0))
    assert one(spark, *s.values()) == ("amber", "", "amber", "red")
