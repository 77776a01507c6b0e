"""Requests against all captures of their key."""

import random

from attesta.operators import sessions


def test_with_valid_capture(spark):
    rng = random.Random(4)
    captures = [(k, rng.randrange(0, 4000)) for k in (1, 1, 1, 1, 1, 2, 2, 2, 9)] + [(1, 100), (1, 100), (1, None)]
    requests = [(k, i, rng.randrange(0, 4000)) for i, k in enumerate(rng.choices((1, 2, 3, None), k=300))] + [(1, 900, 100), (1, 901, 150), (1, 902, None)]
    c = spark.createDataFrame(captures, "user long, s long").selectExpr("user", "timestamp_seconds(s) AS created").repartition(3)
    r = spark.createDataFrame(requests, "user long, id long, s long").selectExpr("user", "id", "timestamp_seconds(s) AS ts")
    want = {}
    for k, i, s in requests:
        ages = [s - t for u, t in captures if k is not None and u == k and s is not None and t is not None and 0 <= s - t <= 50]
        if ages:
            want[i] = s - min(ages)
    got = sessions.with_valid_capture(r, c, "user", "ts", "created", 10).selectExpr("id", "unix_seconds(created) AS created").collect()
    assert len(got) == len(want) > 10
    assert {x.id: x.created for x in got} == want


def test_query_takes_older_captures(spark, sf):
    from attesta.plans import catalog

    e = [(r.user_id, r.event_id, r.ts, r.event_type) for r in spark.read.parquet(f"{sf}/events.parquet").collect()]
    want = sorted(i for u, i, t, _ in e if any(v == u and k == "purchase" and 0 <= (t - s).total_seconds() <= 18000 for v, _, s, k in e))
    assert sorted(r.event_id for r in catalog.queries()["jn10_valid_captures"](spark, sf).collect()) == want
