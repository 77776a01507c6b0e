"""Quantiles and prefix sums of groups, narrowed in rounds, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.operators import selection, statistics


def made(spark, seed):
    """Groups with heavy ties, wide ranges, one value, two values, nulls only; a null group."""
    rng = np.random.default_rng(seed)
    groups = {
        "ties": rng.integers(0, 30, 900).astype(float), "wide": np.r_[rng.normal(size=700) * 10.0 ** rng.integers(-200, 200, 700), 0.0], "one": np.array([5.0]), "two": np.array([1.0, 2.0]),
        "most": np.r_[np.full(800, 3.0), rng.normal(size=300)], "even": np.arange(1000.0), None: rng.normal(size=50),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("ties", None), ("none", None)]
    return groups, spark.createDataFrame(rows, "grp string, v double").repartition(3)


@pytest.mark.parametrize(("small", "pivots", "few"), [(4, 3, 10_000), (16, 8, 0), (4096, 256, 10_000)])
def test_quantile(spark, monkeypatch, small, pivots, few):
    for name, x in (("SMALL", small), ("PIVOTS", pivots), ("FEW", few)):
        monkeypatch.setattr(selection, name, x)
    groups, df = made(spark, small)
    counts = selection.counted(df, ["grp"], "v")
    for share in (0.0, 0.1, 0.5, 0.997, 1.0) if small == 4 else (0.1, 0.5):
        got = {r.grp: (r.q, r.n) for r in selection.quantile(counts, ["grp"], "v", share, "q", "n").collect()}
        assert got.keys() == groups.keys()
        for k, v in groups.items():
            assert got[k][1] == len(v) and np.isclose(got[k][0], np.quantile(v, share), rtol=1e-12, atol=1e-300), (k, share)


def test_quantile_of_nothing(spark):
    df = spark.createDataFrame([], "grp string, v double")
    assert not selection.quantile(selection.counted(df, ["grp"], "v"), ["grp"], "v", 0.5, "q").head(1)
    assert [tuple(r) for r in statistics.describe_by(spark.createDataFrame([("a", None)], "grp string, v double"), "grp", "v").collect()] == [("a", 0, None, None, None, None)]


def test_below(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(v), int(rng.integers(0, 5))) for g in ("a", "b", None) for v in rng.permutation(300)]
    got = selection.below(spark.createDataFrame(rows, "grp string, v double, n long").repartition(5), ["grp"], "v", "n", "before").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.before == sum(n for g, v, n in rows if g == r.grp and v < r.v)


def test_auc_with_ties_across_ranges(spark):
    rng = np.random.default_rng(9)
    rows = [(g, float(rng.integers(0, 40)), bool(rng.integers(0, 2))) for g in ("x", "y") for _ in range(400)] + [("z", 1.0, True)]
    got = {r.grp: r.auc for r in statistics.auc(spark.createDataFrame(rows, "grp string, s double, a boolean").repartition(4), "grp", "s", F.col("a")).collect()}
    for g in ("x", "y"):
        a, b = ([s for k, s, x in rows if k == g and x is kind] for kind in (True, False))
        assert np.isclose(got[g], np.mean([x > y for x in a for y in b]))
    assert got.keys() == {"x", "y"}
