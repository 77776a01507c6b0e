"""The edit-distance index against all pairs."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.operators import spelling


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("ab", min_size=1, max_size=9), st.text("ab", min_size=1, max_size=12), st.integers(1, 4))
def test_places_suffice(word, name, bound):
    if distance(name, word) > bound:
        return
    cut = spelling.cuts(len(word), bound)
    assert "".join(word[a : a + n] for a, n in cut) == word
    assert any(n == len(name) and name[at : at + size] == word[cut[k][0] : cut[k][0] + size] for n, k, at, size in spelling.places(len(word), bound))


def plain(names, lexicon):
    out = {}
    for n in names:
        if n:
            d, _, w = min((distance(n, w), o, w) for o, w in lexicon if w)
            if d <= max(1, len(w) // 3):
                out[n] = (w, d)
    return out


@pytest.mark.parametrize("few", [0, 200_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_nearest(spark, monkeypatch, few, seed):
    """Short and long words of few letters, so that near but unacceptable words come in between."""
    monkeypatch.setattr(spelling, "FEW", few)
    rng = np.random.default_rng(seed)
    make = lambda most: "".join(rng.choice(list("abé"), rng.integers(1, most)))
    lexicon = list(enumerate(dict.fromkeys(["a", "ab", "", *(make(14) for _ in range(25))])))
    names = sorted({"", *(make(17) for _ in range(300))})
    df = spark.createDataFrame([(n,) for n in names], "key string")
    got = spelling.nearest(df, spark.createDataFrame([(o, w, w) for o, w in lexicon], "ord int, key string, word string")).collect()
    assert {r.key: (r.value, r.distance) for r in got} == plain(names, lexicon) and len(got) == len(plain(names, lexicon))
    assert not spelling.nearest(df, spark.createDataFrame([], "ord int, key string, word string")).head(1)


def test_no_exchange_on_length(spark):
    df = spark.createDataFrame([("abc",)], "key string")
    words = spark.createDataFrame([(1, "abd", "abd")], "ord int, key string, word string")
    plan = spelling.nearest(df, words)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "hashpartitioning(length" not in plan.replace(" ", "")
