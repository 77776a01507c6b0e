"""Measures of images, scorers given by the caller, and suppression of overlapping boxes.

Images come as ``spark.read.format("image")`` gives them: height, width, nChannels
and BGR bytes. A task measures one image at a time in numpy.

Defined results: a null or empty image, or one with other channels than 1, 3 or
4, has null measures; a fourth channel is not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, reduce
from math import isqrt

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Side of a tile in pixels, tiles of an image at most, band of cycles a pixel that is searched,
# floors under power and under fine detail, percentiles of the span, standard deviation of the blur in pixels.
TILE = 256
TILES = 16
BAND = (0.06, 0.48)
POWER_FLOOR = 1e-6
DETAIL_FLOOR = 1e-3
SPAN = (1, 99)
SIGMA = 1.5

QUALITY = "sharpness double, brightness double, glare double"
RECAPTURE = "spectral_peak double, chroma_peak double, chroma_hf double, dynamic_range double"


def pixels(height: int, width: int, channels: int, data: bytes | None) -> np.ndarray | None:
    """height x width x channels (1 or 3)."""
    if data is None or channels not in (1, 3, 4) or not height or not width or len(data) != height * width * channels:
        return None
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)[:, :, :3]


def luma(image: np.ndarray) -> np.ndarray:
    """Whole grey levels, weighted as in television standards."""
    if image.shape[2] == 1:
        return image[:, :, 0].astype(float)
    return np.rint(image.astype(float) @ np.array([0.114, 0.587, 0.299]))


def laplacian(gray: np.ndarray) -> np.ndarray:
    """Each pixel's four neighbours less four times itself; edges are mirrored."""
    g = np.pad(gray, 1, mode="reflect" if min(gray.shape) > 1 else "edge")
    return g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * gray


def image_quality(image: np.ndarray, blown: int = 250) -> tuple[float, float, float]:
    """Variance of the Laplacian, mean luma, share of near-white pixels."""
    gray = luma(image)
    return float(laplacian(gray).var()), float(gray.mean()), float((gray >= blown).mean())


def planes_of(image: np.ndarray) -> np.ndarray:
    """BGR -> 3 x height x width: luma, and how far red and blue lie from it, around 128, in whole levels."""
    y = luma(image)
    away = (image[:, :, [2, 0]] - y[:, :, None]) * (0.713, 0.564) + 128
    return np.stack([y, *np.moveaxis(np.rint(away).clip(0, 255), 2, 0)])


def detail(planes: np.ndarray) -> np.ndarray:
    """For each plane the mean distance of a pixel from its surroundings, which a Gaussian weighs."""
    reach = round(4 * SIGMA)
    weight = np.exp(-((np.arange(reach + 1) / SIGMA) ** 2) / 2)
    weight /= weight[0] + 2 * weight[1:].sum()
    around = planes
    for axis in (1, 2):
        n = planes.shape[axis]
        mirrored = np.pad(around, [(reach, reach) if k == axis else (0, 0) for k in range(3)], mode="reflect")
        shifted = lambda by: np.take(mirrored, range(reach + by, reach + by + n), axis)  # noqa: B023, E731
        around = weight[0] * shifted(0) + sum(w * (shifted(d) + shifted(-d)) for d, w in enumerate(weight[1:], 1))
    return np.abs(planes - around).mean(axis=(1, 2))


@cache
def _half_plane() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a real tile's transform, which is told by half of its plane: each coefficient's ring, how often it stands
    in the whole plane, where rings begin among all coefficients in order of rings, and which lie in the band.

    Squared wave numbers are whole, so rings and band are exact.
    """
    across, down = np.arange(TILE // 2 + 1), np.fft.fftfreq(TILE, 1 / TILE).astype(int)
    square = np.add.outer(down**2, across**2).ravel()
    ring = np.minimum(np.array([isqrt(k) for k in square.tolist()]), TILE // 2)
    times = np.tile(np.where(across % (TILE // 2), 2, 1), TILE)
    begin = np.r_[0, np.bincount(ring, times).astype(int).cumsum()]
    return ring, times, begin, (square >= (BAND[0] * TILE) ** 2) & (square <= (BAND[1] * TILE) ** 2)


def spectral_peaks(planes: np.ndarray) -> np.ndarray:
    """For each plane how far a wave of the band stands out from the median of its ring, at most, in log10 of the
    power that tiles have on average; 0 without a tile."""
    if min(planes.shape[1:]) < TILE:
        return np.zeros(len(planes))
    tiles = sliding_window_view(planes, (TILE, TILE), (1, 2))[:, ::TILE, ::TILE]
    down, across = np.divmod(np.arange(tiles.shape[1] * tiles.shape[2]), tiles.shape[2])
    if len(down) > TILES:
        spread = np.linspace(0, len(down) - 1, TILES).astype(int)
        down, across = down[spread], across[spread]
    ring, times, begin, band = _half_plane()
    fade = np.hanning(TILE)
    out = []
    for plane in tiles:
        some = plane[down, across]
        waves = np.fft.rfft2((some - some.mean(axis=(1, 2), keepdims=True)) * fade * fade[:, None])
        level = np.log10(np.square(np.abs(waves)).mean(axis=0).ravel() + POWER_FLOOR)
        order = np.lexsort((level, ring))
        ranked = np.repeat(level[order], times[order])
        middle = (ranked[(begin[:-1] + begin[1:] - 1) // 2] + ranked[(begin[:-1] + begin[1:]) // 2]) / 2
        out.append((level - middle[ring])[band].max())
    return np.array(out)


def recapture(image: np.ndarray) -> tuple[float, float, float, float] | None:
    """Peaks of luma and of colour, fine colour against fine luma (log), and the span of luma without its extremes."""
    if image.shape[2] != 3 or min(image.shape[:2]) < TILE:
        return None
    planes = planes_of(image)
    peak, fine = spectral_peaks(planes), detail(planes)
    against = np.log((fine[1:].sum() + DETAIL_FLOOR) / (fine[0] + DETAIL_FLOOR))
    return float(peak[0]), float(peak[1:].max()), float(against), float(np.diff(np.percentile(planes[0], SPAN))[0])


def _measured(images: DataFrame, keep: list[str], measure: Callable, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            got = []
            for h, w, c, data in zip(pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"], strict=True):
                image = pixels(h, w, c, data)
                got.append((None if image is None else measure(image)) or (None,) * len(names))
            yield pd.concat([pdf[keep].reset_index(drop=True), pd.DataFrame(got, columns=names, dtype=float)], axis=1)

    kept = ", ".join(f"`{k}` {images.schema[k].dataType.simpleString()}" for k in keep)
    return images.select(*keep, "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(run, f"{kept}, {schema}")


def quality_of_images(images: DataFrame, keep: list[str]) -> DataFrame:
    """EXT4: rows with an ``image`` -> the columns ``keep``, sharpness, brightness, glare."""
    return _measured(images, keep, image_quality, QUALITY)


def recapture_of_images(images: DataFrame, keep: list[str]) -> DataFrame:
    """EXT5: rows with an ``image`` -> the columns ``keep`` and the features that a picture of a screen or print shows."""
    return _measured(images, keep, recapture, RECAPTURE)


def score_with(df: DataFrame, factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """EXT3: rows scored by what the caller's ``factory`` makes, once for each task: a model, or a fake in tests."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in parts:
            yield model(pdf)

    return df.mapInPandas(run, schema)


def suppress_overlaps(detections: DataFrame, image: str, order: str, least: float) -> DataFrame:
    """EXT6: detections(image, x1, y1, x2, y2, score) -> those that no better one of their image overlaps by more than ``least``.

    Of equal scores the smaller ``order`` is better, then the smaller corners; null scores come last. Boxes with a null corner overlap nothing,
    nor do those of no image. An image's boxes meet in one row: they are as many as a detector gives. Every column must
    be of a type that can be ordered.
    """
    corners = ["x1", "y1", "x2", "y2"]
    row = F.struct(*detections.columns)
    entry = F.struct(F.col("score").isNull().alias("last"), (-F.col("score")).alias("minus"), F.col(order).alias("tie"), *(F.col(c).cast("double").alias(c) for c in corners), row.alias("row"))
    boxes = detections.where(F.col(image).isNotNull()).groupBy(F.col(image).alias("_image")).agg(F.sort_array(F.collect_list(entry)).alias("_boxes"))

    def overlap(a: Column, b: Column) -> Column:
        side = lambda low, high: F.greatest(F.least(a[high], b[high]) - F.greatest(a[low], b[low]), F.lit(0.0))
        area = lambda x: (x["x2"] - x["x1"]) * (x["y2"] - x["y1"])
        both = side("x1", "x2") * side("y1", "y2")
        whole = reduce(Column.__and__, (x[c].isNotNull() for x in (a, b) for c in corners))
        return whole & (both / (area(a) + area(b) - both + 1e-9) > least)

    none = F.filter("_boxes", lambda b: F.lit(False))
    kept = F.aggregate("_boxes", none, lambda got, b: F.when(F.exists(got, lambda a: overlap(a, b)), got).otherwise(F.concat(got, F.array(b))))
    best = boxes.select(F.explode(kept).alias("b")).select("b.row.*")
    return best.union(detections.where(F.col(image).isNull()))
