"""Head pose and openness of eyes and mouth from landmarks, as Column builders (FN16). A point is a struct of x and y."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Proportions of a face, and numbers of landmarks: corners, then pairs of upper and lower points.
EYE_HALF_WIDTH = 30.0
EYE_DEPTH = 24.0
EYE_HEIGHT = 32.0
MOUTH_DROP = 30.0
MOUTH_DEPTH = 22.0
LEFT_EYE = ((35, 39), ((41, 36), (40, 33), (42, 37)))
RIGHT_EYE = ((89, 93), ((95, 90), (94, 87), (96, 91)))
MOUTH = ((52, 61), ((66, 54), (62, 60), (70, 57)))

#: Lengths up to this are taken as none.
TINY = 1e-6


def _distance(points: Column, i: int, j: int) -> Column:
    a, b = F.get(points, F.lit(i)), F.get(points, F.lit(j))
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def openness(points: Column, part: tuple) -> Column:
    """Mean gap of the pairs over the distance of the corners; 0 where the corners meet, null where a landmark is missing."""
    corners, pairs = part
    width = _distance(points, *corners)
    gap = reduce(add, (_distance(points, *p) for p in pairs)) / len(pairs)
    return F.when(width <= TINY, 0.0).otherwise(F.try_divide(gap, width))


def head_pose(kps: Column) -> dict[str, Column]:
    """yaw, pitch, roll in degrees from eyes, nose and mouth corners; all null where a point is missing.

    Nose and mouth are measured along the line of the eyes and across it, from the middle between the eyes.
    """
    eye_l, eye_r, nose, mouth_l, mouth_r = (F.get(kps, F.lit(i)) for i in range(5))
    turn = F.atan2(eye_r["y"] - eye_l["y"], eye_r["x"] - eye_l["x"])
    half = F.hypot(eye_r["x"] - eye_l["x"], eye_r["y"] - eye_l["y"]) / 2
    mid_x, mid_y = (eye_l["x"] + eye_r["x"]) / 2, (eye_l["y"] + eye_r["y"]) / 2
    along = lambda x, y: (x - mid_x) * F.cos(turn) + (y - mid_y) * F.sin(turn)
    across = lambda x, y: (y - mid_y) * F.cos(turn) - (x - mid_x) * F.sin(turn)
    side = F.when(2 * half > TINY, F.try_divide(along(nose["x"], nose["y"]), half)).otherwise(0.0)
    drop = across((mouth_l["x"] + mouth_r["x"]) / 2, (mouth_l["y"] + mouth_r["y"]) / 2)
    face = EYE_HEIGHT + MOUTH_DROP
    share = F.when(F.abs(drop) > TINY, F.try_divide(across(nose["x"], nose["y"]), drop)).otherwise(EYE_HEIGHT / face)
    slope = F.try_divide(face * share - EYE_HEIGHT, EYE_DEPTH - (EYE_DEPTH - MOUTH_DEPTH) * share)
    pitch = -F.degrees(F.atan(F.coalesce(slope, F.lit(float("inf")))))
    there = turn.isNotNull() & nose.isNotNull() & drop.isNotNull()
    found = {"yaw": F.degrees(F.atan(side * EYE_HALF_WIDTH / EYE_DEPTH)), "pitch": pitch, "roll": F.degrees(turn)}
    return {k: F.when(there, v) for k, v in found.items()}


def measure_frames(df: DataFrame, kps: str = "kps", points: str = "points") -> DataFrame:
    """``df`` with yaw, pitch, roll, and how open both eyes and the mouth are."""
    parts = {"left_eye": LEFT_EYE, "right_eye": RIGHT_EYE, "mouth": MOUTH}
    return df.withColumns(head_pose(F.col(kps)) | {k: openness(F.col(points), v) for k, v in parts.items()})
