"""Running values over a key with most of all rows, against one pass in plain Python."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from attesta.operators import segments
from attesta.operators import sessions as S

ORDER = ["ts", "n"]


@pytest.fixture(scope="module")
def made(spark):
    """Key 1 has two thirds of the rows; some rows have no key; a time is shared by two rows."""
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, None]), (n // 2) * 7.0, n, rng.random() < (0.97 if n < 900 else 0.5), round(rng.random(), 3), rng.sample("abc", rng.randrange(3))) for n in range(2000)]
    df = spark.createDataFrame(rows, "key int, ts double, n int, ok boolean, v double, codes array<string>").repartition(7)
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would put so few rows into one range
    yield df, by
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_hot_key_has_several_segments(spark, made):
    sizes = [r["count"] for r in segments.cut(made[0], "key", ORDER).groupBy("key", segments.SEGMENT).count().where("key = 1").collect()]
    assert len(sizes) > 1 and max(sizes) < 1000


def test_streaks(made):
    df, by = made
    got = {r.n: (r.island, r.streak, r.qualified) for r in S.ok_streak(df, "key", ORDER, F.col("ok"), 3).collect()}
    for rows in by.values():
        island = streak = 0
        for _, _, n, ok, *_ in rows:
            island, streak = (island, streak + 1) if ok else (island + 1, 0)
            assert got[n] == (island, streak, streak >= 3)
    assert len(got) == 2000 and max(s for _, s, _ in got.values()) > 30


def test_running_max_and_lost_faces(made):
    df, by = made
    best = {r.n: r.reference for r in S.running_max(df, "key", ORDER, "v").collect()}
    lost = {r.n: (r.gap_s, r.lost) for r in S.face_lost(df, "key", ORDER, "ts", F.col("v") > 0.9, 60.0).collect()}
    for rows in by.values():
        seen, face = [], rows[0][1]
        for _, ts, n, _, v, _ in rows:
            assert best[n] == (max(seen) if len(seen) >= 2 else None)
            assert lost[n] == (pytest.approx(ts - face), v <= 0.9 and ts - face > 60)
            seen.append(v)
            face = ts if v > 0.9 else face


def test_every_nth(made):
    df, by = made
    got = {(r.n, r.frame_no) for r in S.every_nth(df, "key", ORDER, 5, F.col("v") > 0.6).collect()}
    want = set()
    for rows in by.values():
        had = False
        for i, (_, _, n, _, v, _) in enumerate(rows, 1):
            if v > 0.6:
                want |= {(n, i)} if i % 5 == 0 or not had else set()
                had = True
    assert got == want


@pytest.mark.parametrize("window,least", [(1, 1), (3, 2), (5, 3)])
def test_steady_hints(made, window, least):
    df, by = made
    got = {r.n: r.hint for r in S.steady_hints(df, "key", ORDER, "codes", ("c", "a", "b"), window, least).collect()}
    for rows in by.values():
        for i, r in enumerate(rows):
            seen = collections.Counter(c for x in rows[max(0, i - window + 1) : i + 1] for c in x[5])
            assert got[r[2]] == next((c for c in "cab" if seen[c] >= least), None)


def test_empty(made):
    assert S.ok_streak(made[0].limit(0), "key", ORDER, F.col("ok"), 3).count() == 0
