"""Boxes of detected fields: fit to a layout, and projection (FN17, FN18)."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("x1", "y1", "x2", "y2")


def layout_fit(detections: DataFrame, rules: list[tuple[str, str, str]], wide: list[str], image: str = "image") -> DataFrame:
    """Rows of (image, class, score, x1, y1, x2, y2) -> for each image the share of the rules that its boxes keep, and the
    share of the ``wide`` classes found whose box is wider than tall; 0 where there is nothing to look at.

    A rule is (class, left_of or above, class), held against centres. Of several boxes of a class the one with the
    largest (score, x1, y1, x2, y2) counts. One grouping with partial maxima; no join of an image's boxes.
    """
    classes = sorted({c for a, _, b in rules for c in (a, b)} | set(wide))
    box = {c: F.col(f"_box{i}") for i, c in enumerate(classes)}
    best = [F.max(F.when(F.col("class") == c, F.struct("score", *SIDES))).alias(f"_box{i}") for i, c in enumerate(classes)]

    def share(tests: list[Column]) -> Column:
        kept = reduce(add, (F.coalesce(t.cast("int"), F.lit(0)) for t in tests), F.lit(0))
        seen = reduce(add, (t.isNotNull().cast("int") for t in tests), F.lit(0))
        return F.coalesce(F.try_divide(kept.cast("double"), seen.cast("double")), F.lit(0.0))

    axis = {"left_of": ("x1", "x2"), "above": ("y1", "y2")}
    centre = lambda c, relation: sum((box[c][s] for s in axis[relation]), F.lit(0.0)) / 2
    kept = share([centre(a, r) < centre(b, r) for a, r, b in rules])
    broad = share([box[c]["x2"] - box[c]["x1"] > box[c]["y2"] - box[c]["y1"] for c in wide])
    return detections.groupBy(image).agg(*best).select(image, kept.alias("layout_score"), broad.alias("wide_fraction"))


def bounds(points: Column) -> Column:
    """An outline's box: array of (x, y) -> x1, y1, x2, y2; null for an empty one."""
    axis = lambda k: F.transform(points, lambda p: p[k])
    x, y = axis("x"), axis("y")
    found = F.struct(F.array_min(x).alias("x1"), F.array_min(y).alias("y1"), F.array_max(x).alias("x2"), F.array_max(y).alias("y2"))
    return F.when(F.size(points) > 0, found)


def to_yolo(box: Column, width: float, height: float) -> Column:
    """Corners -> centre and size as shares of the frame."""
    parts = {"cx": (box["x1"] + box["x2"]) / 2 / width, "cy": (box["y1"] + box["y2"]) / 2 / height, "w": (box["x2"] - box["x1"]) / width, "h": (box["y2"] - box["y1"]) / height}
    return F.struct(*(v.alias(k) for k, v in parts.items()))


def project_outline(points: Column, m: list[list[float]], width: float, height: float) -> Column:
    """The box around an outline moved by the 3 x 3 matrix ``m``, cut to the frame; null below one pixel or for no points."""
    row = lambda r, p: m[r][0] * p["x"] + m[r][1] * p["y"] + m[r][2]
    moved = lambda r, p: F.coalesce(F.try_divide(row(r, p), row(2, p)), F.lit(0.0))
    b = bounds(F.transform(points, lambda p: F.struct(moved(0, p).alias("x"), moved(1, p).alias("y"))))
    low = {k: F.greatest(F.lit(0.0), b[k]) for k in ("x1", "y1")}
    high = {k: F.least(F.lit(float(n)), b[k]) for k, n in (("x2", width), ("y2", height))}
    big = b.isNotNull() & (high["x2"] - low["x1"] >= 1) & (high["y2"] - low["y1"] >= 1)
    return F.when(big, F.struct(*((low | high)[k].alias(k) for k in SIDES)))


def project_box(box: Column, m: list[list[float]], width: float, height: float) -> Column:
    """All four corners are moved, since each goes its own way."""
    corner = lambda x, y: F.struct(box[x].cast("double").alias("x"), box[y].cast("double").alias("y"))
    points = F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2"))
    return F.when(box.isNotNull(), project_outline(points, m, width, height))
