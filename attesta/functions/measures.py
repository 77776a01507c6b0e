"""Scores and geometry as Column builders (FN14, FN15, FN18-FN20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clip(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def quality_score(sharpness: Column, yaw: Column, pitch: Column, roll: Column, det: Column, eyes: Column, limits: dict[str, float]) -> Column:
    """Mean clipped headroom of five parts; of six where the eyes were measured."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    parts = clip(zero(sharpness) / (4 * limits["sharpness"])) + clip(zero(det))
    parts += sum(clip(1 - F.abs(zero(c)) / limits[k]) for c, k in ((yaw, "yaw"), (pitch, "pitch"), (roll, "roll")))
    return F.when(eyes.isNull(), parts / 5).otherwise((parts + clip(eyes / (2 * limits["eyes"]))) / 6)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-9)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x))


def to_corners(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return F.struct((cx - w / 2).alias("x1"), (cy - h / 2).alias("y1"), (cx + w / 2).alias("x2"), (cy + h / 2).alias("y2"))


def iou(a: Column, b: Column) -> Column:
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    area = lambda x: (x["x2"] - x["x1"]) * (x["y2"] - x["y1"])
    both = side("x1", "x2") * side("y1", "y2")
    return both / (area(a) + area(b) - both)


def context_scale(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """The largest factor by which a box grows about its centre and still fits the frame; sides count as 1 at least."""
    cx, cy = x1 + x2, y1 + y2  # twice the centre
    w, h = F.greatest(x2 - x1, F.lit(1.0)), F.greatest(y2 - y1, F.lit(1.0))
    return F.least(cx / w, (2 * width - cx) / w, cy / h, (2 * height - cy) / h)


def jitter_boxes(df: DataFrame, amount: float) -> DataFrame:
    """Nine shifted copies of each box (x1, y1, x2, y2), row by row; only the box itself where ``amount`` is not above 0."""
    steps = [0] if amount <= 0 else [-1, 0, 1]
    shifts = F.array(*(F.struct(F.lit(float(x * amount)).alias("dx"), F.lit(float(y * amount)).alias("dy")) for y in steps for x in steps))
    out = df.withColumn("shift", F.explode(shifts))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    dx, dy = F.col("shift.dx") * w, F.col("shift.dy") * h
    return out.select(*df.columns, (F.col("x1") + dx).alias("jx1"), (F.col("y1") + dy).alias("jy1"), (F.col("x2") + dx).alias("jx2"), (F.col("y2") + dy).alias("jy2"))


def task_tests(yaw: Column, eyes: Column, mouth: Column, height: Column, base_eyes: Column, base_mouth: Column, base_height: Column, limits: dict[str, float]) -> dict[str, Column]:
    """What one frame says relative to the session's baseline."""
    frontal = F.abs(yaw) <= limits["frontal"]
    return {
        "frontal": frontal, "closed": eyes < limits["closed"] * base_eyes, "opened": eyes >= limits["open"] * base_eyes, "turned_left": yaw >= limits["turn"],
        "turned_right": yaw <= -limits["turn"], "smiling": frontal & (mouth >= limits["smile"] * base_mouth), "closer": height >= limits["closer"] * base_height,
    }
