"""Measures of images against plain loops, a given scorer, suppression of boxes."""

import numpy as np
import pandas as pd
import pytest

from attesta.operators import images

IMAGE = "id int, image struct<height:int,width:int,nChannels:int,data:binary>"


def test_quality(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (7, 9, 3)).astype(np.uint8)
    grey = np.array([[round(0.114 * p[0] + 0.587 * p[1] + 0.299 * p[2]) for p in row] for row in a.astype(float)])
    at = lambda y, x: grey[abs(y) if y < 7 else 12 - y, abs(x) if x < 9 else 16 - x]
    lap = [at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * grey[y, x] for y in range(7) for x in range(9)]
    flat = np.full((5, 5, 1), 250, np.uint8)
    rows = [(1, (7, 9, 3, bytearray(a.tobytes()))), (2, (5, 5, 1, bytearray(flat.tobytes()))), (3, (0, 0, 3, bytearray())), (4, None)]
    got = {r.id: r for r in images.quality_of_images(spark.createDataFrame(rows, IMAGE), ["id"]).collect()}
    assert got[1].sharpness == pytest.approx(np.var(lap)) and got[1].brightness == pytest.approx(grey.mean())
    assert (got[2].sharpness, got[2].brightness, got[2].glare) == (0.0, 250.0, 1.0)
    assert got[3].sharpness is None and got[4].glare is None


def test_recapture(spark):
    rng = np.random.default_rng(4)
    y, x = np.mgrid[:300, :600]
    noise = rng.normal(128, 10, (300, 600, 3))
    striped = noise + 40 * np.sin(2 * np.pi * x / 8)[:, :, None]
    tint = noise + 40 * np.sin(2 * np.pi * x / 8)[:, :, None] * np.array([1, 0, -1])
    rows = [(k, (300, 600, 3, bytearray(np.clip(a, 0, 255).astype(np.uint8).tobytes()))) for k, a in enumerate((noise, striped, tint))] + [(3, (100, 600, 3, bytearray(180_000)))]
    got = {r.id: r for r in images.recapture_of_images(spark.createDataFrame(rows, IMAGE), ["id"]).collect()}
    assert got[1].spectral_peak > got[0].spectral_peak + 1 and got[2].chroma_peak > got[0].chroma_peak + 1
    assert got[1].dynamic_range > got[0].dynamic_range and got[2].chroma_hf > got[1].chroma_hf
    assert got[3].spectral_peak is None
    # one tile by hand
    tile = noise[:256, :256, 1]
    f = np.fft.fftfreq(256)
    far = np.sqrt(f[:, None] ** 2 + f**2)
    p = np.log10(abs(np.fft.fft2((tile - tile.mean()) * np.outer(np.hanning(256), np.hanning(256)))) ** 2 + 1e-6)
    ring = np.minimum((far * 256).astype(int), 128)
    over = p - np.array([np.median(p[ring == r]) for r in range(129)])[ring]
    assert images.spectral_peaks(tile[None])[0] == pytest.approx(over[(far >= 0.06) & (far <= 0.48)].max())
    assert images.spectral_peaks(noise[None, :100, :, 0])[0] == 0.0


def test_scorer_made_once_a_task(spark):
    def factory():
        made = [0]

        def model(pdf: pd.DataFrame) -> pd.DataFrame:
            made[0] += 1
            return pd.DataFrame({"id": pdf["id"], "score": pdf["id"] * 2.0})

        return model

    assert sorted(tuple(r) for r in images.score_with(spark.range(20), factory, "id long, score double").collect()) == [(i, 2.0 * i) for i in range(20)]


def test_suppression(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        x, y = rng.integers(0, 30, 2)
        rows.append((int(i % 4), i, float(x), float(y), float(x + rng.integers(0, 12)), float(y + 8), float(rng.integers(0, 5))))
    df = spark.createDataFrame(rows, "image int, n int, x1 double, y1 double, x2 double, y2 double, score double")

    def iou(a, b):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        both = max(w, 0) * max(h, 0)
        return both / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - both + 1e-9)

    want = []
    for k in range(4):
        kept = []
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[6], r[1])):
            if all(iou(a, r) <= 0.4 for a in kept):
                kept.append(r)
        want += [r[1] for r in kept]
    assert sorted(r.n for r in images.suppress_overlaps(df.repartition(3), "image", "n", 0.4).collect()) == sorted(want)
    assert images.suppress_overlaps(df.limit(0), "image", "n", 0.4).count() == 0


def test_suppression_of_odd_rows(spark):
    df = spark.createDataFrame(
        [
            (1, 1, 0.0, 0.0, 10.0, 10.0, 0.5), (1, 2, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 3, 0.0, None, 10.0, 10.0, 0.1), (1, 4, 0.0, 0.0, 10.0, 10.0, None),
            (2, 5, 0.0, 0.0, 10.0, 10.0, None), (2, 5, 0.0, 0.0, 10.0, 10.0, None), (None, 6, 0.0, 0.0, 10.0, 10.0, 0.9), (None, 7, 0.0, 0.0, 10.0, 10.0, 0.9),
        ],
        "image int, n int, x1 double, y1 double, x2 double, y2 double, score double",
    )
    out = images.suppress_overlaps(df.withColumns({"row": df.n, "_boxes": df.n}), "image", "n", 0.4)
    assert out.columns == [*df.columns, "row", "_boxes"]
    assert sorted(r.n for r in out.collect()) == [2, 3, 5, 6, 7]
