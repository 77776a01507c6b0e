"""References, limits and scores of regions against plain Python, and what their steps move."""

import random
from statistics import median

import pytest

from attesta.operators import statistics as S
from attesta.sources.scratch import written

FEATURES = ["a", "b", "same"]
ROWS = "photo long, region string, a double, b double, same double"


def made():
    rng = random.Random(4)
    rows = [(rng.randrange(60), "xy"[rng.randrange(2)], rng.choice([None, *range(9)]), rng.random(), 1.0) for _ in range(400)]
    rows += [(p % 19, "few", 1.0, 2.0, 1.0) for p in range(90)]  # 19 photos: no reference
    rows += [(p % 20, "enough", float(p % 7), None, 1.0) for p in range(90)]  # b is never measured
    rows += [(None, "few", 3.0, 1.0, 1.0), (None, "x", 90.0, 1.0, 1.0), (3, None, 5.0, 1.0, 1.0), (77, "enough", None, None, None)]
    return [(p, r, None if a is None else float(a), b, c) for p, r, a, b, c in rows]


def at(values, share):
    values = sorted(values)
    place = (len(values) - 1) * share
    low = int(place)
    return values[low] if place == low else (low + 1 - place) * values[low] + (place - low) * values[low + 1]


def plain(rows, least=20, fpr=0.02):
    photos, values = {}, {}
    for p, r, *cells in rows:
        if r is not None:
            photos.setdefault(r, set()).add(p)
            for f, v in zip(FEATURES, cells, strict=True):
                if v is not None:
                    values.setdefault((r, f), []).append(v)
    ref = {k: (median(v), max(median(abs(x - median(v)) for x in v) * 1.4826, 0.001), len(v)) for k, v in values.items() if len(photos[k[0]] - {None}) >= least}
    dev = {}
    for p, r, *cells in rows:
        for f, v in zip(FEATURES, cells, strict=True):
            if (r, f) in ref:
                m, s, _ = ref[r, f]
                d = None if v is None else abs(v - m) / s
                old = dev.get((p, r, f))
                dev[p, r, f] = d if old is None else old if d is None else max(old, d)
    n = len({f for (_, _, f), d in dev.items() if d is not None})
    limits = {k: round(at([d for (_, r, f), d in dev.items() if (r, f) == k and d is not None], 1 - fpr / n), 3) for k in ref}
    limits = {k: v for k, v in limits.items() if v > 0}
    scores = {}
    for (p, r, f), d in dev.items():
        if (r, f) in limits:
            score = None if d is None else d / limits[r, f]
            one = (score is None, -(score or 0), f, score)
            scores[p, r] = min(scores.get((p, r), one), one, key=lambda x: x[:3])
    return ref, limits, {k: (v[2], v[3], None if v[3] is None else v[3] >= 1) for k, v in scores.items()}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(made(), ROWS).repartition(3)


def test_region_score_against_plain_python(rows):
    ref, limits, scores = plain(made())
    assert {r for r, _ in ref} == {"x", "y", "enough"} and ("x", "same") not in limits
    reference = S.fit_reference(S.cells_of(rows, FEATURES))
    got = {(r.region, r.feature): (r.median, r.scale, r.n) for r in reference.collect()}
    assert got.keys() == ref.keys() and all(got[k] == pytest.approx(ref[k]) for k in ref)
    dev = written(S.deviations(rows, FEATURES, reference), "deviations")
    fitted = S.fit_limits(dev, FEATURES, 0.02)
    assert {(r.region, r.feature): r.limit for r in fitted.collect()} == pytest.approx(limits)
    got = {(r.photo, r.region): (r.feature, r.score, r.warns) for r in S.region_score(dev, FEATURES, fitted).collect()}
    assert got.keys() == scores.keys() and (77, "enough") in got
    assert all(got[k] == (f, None if s is None else pytest.approx(s), w) for k, (f, s, w) in scores.items())


def exchanges(df):
    df.collect()
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n") if "Exchange hashpartitioning" in x]


def test_deviations_move_once_and_scores_not(rows):
    reference = S.fit_reference(S.cells_of(rows, FEATURES))
    dev = S.deviations(rows, FEATURES, reference)
    assert len(exchanges(dev)) == 1 and "feature" not in exchanges(dev)[0]
    dev = written(dev, "deviations")
    assert not exchanges(S.region_score(dev, FEATURES, S.fit_limits(dev, FEATURES, 0.02)))


def test_photos_are_counted_by_slots(spark):
    """What is dealt out doesn't grow with the photos; regions near the least have theirs counted."""
    df = spark.range(50_000).selectExpr("id AS photo", "'many' AS region").union(spark.range(20).selectExpr("id", "'twenty'")).union(spark.range(19).selectExpr("id", "'nineteen'")).repartition(3)
    assert sorted(r.region for r in S._with_photos(df, 20).collect()) == ["many", "twenty"]
    assert sorted(r.region for r in S._with_photos(df, 20_000).collect()) == ["many"]
