"""Rows of the survey without a query of their own: STR7, JN7, JN6's scored branch, FN19's context scale."""

import math

from pyspark.sql import functions as F

from attesta.functions import measures
from attesta.operators import matching
from attesta.streaming import machines


def test_sticky_hint(spark):
    codes = [["dark"], ["dark"], ["dark", "no_face"], ["no_face"], ["no_face"], ["far"], ["close"], ["dim"], [], [], [], ["dark"]]
    # dark stays while steady though no_face goes first; silent, not gone, when only other codes come singly
    want = [None, "dark", "dark", "dark", "no_face", "no_face", "no_face", None, None, None, None, None]
    df = spark.createDataFrame([(1, i, float(i), c) for i, c in enumerate(codes)], "session_id long, event_id long, ts double, codes array<string>")
    got = machines.hint_batch(df.repartition(3), ("no_face", "dark")).orderBy("event_id").collect()
    assert [r.hint for r in got] == want


def test_score_lexicon_and_resolve(spark):
    sharp = [[math.log(x) for x in (0.05, 0.9, 0.05)], [math.log(x) for x in (0.05, 0.05, 0.9)]]
    vague = [[math.log(1 / 3)] * 3] * 2
    df = spark.createDataFrame([(c, t, p) for c, rows in (("ab?", sharp), ("vague", vague)) for t, p in enumerate(rows)], "crop string, t int, logp array<double>")
    accept = lambda least, lead, names=("ab", "ba"): {r.crop: r.value for r in matching.score_lexicon(df, "crop", list(names), ["_", "a", "b"], least, lead, letters=lambda c: c).collect()}
    assert accept(-5.0, 1.0) == {"ab?": "ab"}
    assert accept(-0.1, 1.0) == {} and accept(-5.0, 9.0) == {}
    assert accept(-5.0, 0.0, ("ab",)) == {}  # no runner-up
    names = spark.createDataFrame([(n, n, n) for n in ("ab", "ab?", "bx", "")], "name string, key string, fold string")
    words = spark.createDataFrame([(1, "ab", "ab", "ab"), (2, "bb", "bb", "bb")], "ord long, word string, key string, fold string")
    scored = spark.createDataFrame([("ab?", "ab")], "name string, value string")
    flat = lambda df: {r.name: (r.value, r.method, r.flag) for r in df.collect()}
    assert flat(matching.resolve_names(names, words, scored)) == {"ab": ("ab", "exact", None), "ab?": ("ab", "ctc", None), "bx": (None, "none", "name_not_in_list"), "": (None, "none", None)}
    assert flat(matching.resolve_names(names, words))["bx"] == ("bb", "nearest", None)


def test_context_scale(spark):
    df = spark.createDataFrame([(40.0, 40.0, 60.0, 60.0, 100, 100), (0.0, 40.0, 20.0, 60.0, 100, 100), (70.0, 10.0, 90.0, 50.0, 100, 100), (5.0, 5.0, 5.0, 5.0, 20, 20)], "a double, b double, c double, d double, w int, h int")
    assert [r[0] for r in df.select(measures.context_scale(*(F.col(c) for c in "abcdwh"))).collect()] == [5.0, 1.0, 1.5, 10.0]
