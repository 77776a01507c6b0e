"""Golden values of pose, openness and boxes."""

import math

import pytest
from pyspark.sql import functions as F

from attesta.functions import pose
from attesta.operators import layout

POINT = "array<struct<x: double, y: double>>"
FRONT = [(-30.0, 0.0), (30.0, 0.0), (0.0, 32.0), (-20.0, 62.0), (20.0, 62.0)]


def turned(points, degrees):
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return [(x * c - y * s + 100, x * s + y * c + 50) for x, y in points]


def frames(spark, *rows):
    return pose.measure_frames(spark.createDataFrame(rows, f"id int, kps {POINT}, points {POINT}")).orderBy("id").collect()


def test_head_pose(spark):
    side = [*FRONT[:2], (30 * 0.8 * math.tan(math.radians(30)), 32.0), *FRONT[3:]]
    chin = [*FRONT[:2], (0.0, 26.0), *FRONT[3:]]
    same = [(0.0, 0.0)] * 5
    got = frames(spark, (0, FRONT, None), (1, turned(FRONT, 20), []), (2, turned(side, -15), None), (3, chin, None), (4, same, None), (5, FRONT[:3], None), (6, None, None))
    want = [(0, 0, 0), (0, 0, 20), (30, 0, -15)]
    for r, (yaw, pitch, roll) in zip(got, want, strict=False):
        assert (r.yaw, r.pitch, r.roll) == pytest.approx((yaw, pitch, roll), abs=1e-9)
    q = 26 / 62
    assert got[3].pitch == pytest.approx(-math.degrees(math.atan((62 * q - 32) / (24 - 2 * q)))) and got[3].pitch > 0
    assert (got[4].yaw, got[4].roll) == (0, 0) and got[4].pitch == pytest.approx(0)
    assert all(r[k] is None for r in got[5:] for k in ("yaw", "pitch", "roll", "mouth"))


def test_openness(spark):
    points = [(0.0, 0.0)] * 106
    points[35], points[39] = (0.0, 0.0), (10.0, 0.0)
    for (a, b), gap in zip(pose.LEFT_EYE[1], (2.0, 3.0, 4.0), strict=True):
        points[a], points[b] = (5.0, -gap / 2), (5.0, gap / 2)
    r = frames(spark, (0, FRONT, points))[0]
    assert (r.left_eye, r.right_eye, r.mouth) == pytest.approx((0.3, 0, 0))


def test_layout(spark):
    rows = [(1, "a", 0.9, 0, 0, 10, 5), (1, "a", 0.1, 90, 90, 95, 99), (1, "b", 0.5, 20, 0, 30, 20), (2, "a", 0.5, 0, 0, 4, 4), (3, "z", 0.5, 0, 0, 4, 4)]
    df = spark.createDataFrame([(i, c, s, *map(float, b)) for i, c, s, *b in rows], "image int, class string, score double, x1 double, y1 double, x2 double, y2 double")
    got = layout.layout_fit(df, [("a", "left_of", "b"), ("b", "above", "a"), ("a", "above", "c")], ["a", "b"])
    assert sorted(map(tuple, got.collect())) == [(1, 0.5, 0.5), (2, 0.0, 0.0), (3, 0.0, 0.0)]
    assert layout.layout_fit(df.limit(0), [("a", "above", "b")], []).count() == 0


def test_boxes(spark):
    df = spark.createDataFrame([(0, (10.0, 20.0, 30.0, 40.0)), (1, (95.0, 20.0, 150.0, 40.0)), (2, (99.5, 0.0, 120.0, 9.0)), (3, None)], "id int, b struct<x1: double, y1: double, x2: double, y2: double>")
    shift = [[1.0, 0.0, 5.0], [0.0, 1.0, -25.0], [0.0, 0.0, 1.0]]
    got = df.select("id", layout.project_box(F.col("b"), shift, 110, 100).alias("p"), layout.to_yolo(F.col("b"), 100, 100).alias("y")).orderBy("id").collect()
    assert [r.p and tuple(r.p) for r in got] == [(15.0, 0.0, 35.0, 15.0), (100.0, 0.0, 110.0, 15.0), None, None]
    assert tuple(got[0].y) == pytest.approx((0.2, 0.3, 0.2, 0.2))
    outline = spark.createDataFrame([([(1.0, 5.0), (3.0, 2.0)],), ([],), (None,)], f"o {POINT}")
    assert [r.b and tuple(r.b) for r in outline.select(layout.bounds(F.col("o")).alias("b")).collect()] == [(1.0, 2.0, 3.0, 5.0), None, None]
