"""Mean class probabilities whose ties don't depend on the order of sums."""

import functools
import itertools
import operator

from attesta.operators import statistics

CLASSES = ["real", "unsure", "fake"]


def test_equal_means_are_equal_in_any_order(spark):
    parts = [0.93, 0.38, 0.16, 0.53]  # they and what is left to 1 sum up to 2
    ways = [[p for p in w] for w in itertools.permutations(parts)]
    plain = lambda w: functools.reduce(operator.add, w)
    made = [(k, p, 1 - p, 0.01) for k, w in enumerate(ways) for p in w]
    assert len({plain(w) for w in ways}) > 1  # as doubles they differ
    df = spark.createDataFrame(made, "k int, real double, unsure double, fake double").coalesce(1)
    got = statistics.fuse_classes(df, "k", CLASSES).collect()
    assert {(r.real, r.unsure, r.label) for r in got} == {(0.5, 0.5, "real")} and len(got) == len(ways)


def test_what_is_no_probability_is_not_there(spark):
    made = [(1, 0.2, None, float("nan")), (1, 0.4, None, 0.5), (2, None, None, float("inf"))]
    df = spark.createDataFrame(made, "k int, real double, unsure double, fake double")
    got = {r.k: (r.real, r.unsure, r.fake, r.label) for r in statistics.fuse_classes(df, "k", CLASSES).collect()}
    assert got == {1: (0.3, None, 0.5, "fake"), 2: (None, None, None, None)}
