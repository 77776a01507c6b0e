"""Names under a recogniser's frames: the trie against all paths, letters keys, ties."""

import itertools
import math

import numpy as np

from attesta.operators import matching, trie


def frames_of(spark, crops):
    return spark.createDataFrame([(c, t, [float(x) for x in row]) for c, p in crops.items() for t, row in enumerate(p)], "crop string, t int, logp array<double>")


def paths(p, symbols):
    said = {}
    for path in itertools.product(range(len(symbols)), repeat=len(p)):
        text = "".join(symbols[k] for k, _ in itertools.groupby(path)).replace("_", "")
        said[text] = said.get(text, 0.0) + math.exp(sum(p[t, k] for t, k in enumerate(path)))
    return said


def test_every_path(spark):
    rng = np.random.default_rng(7)
    symbols = ["_", "ا", "ب", "پ"]
    names = ["".join(rng.choice(symbols[1:], rng.integers(1, 6))) for _ in range(30)]
    names = [*dict.fromkeys(names), "ا ب", "ب‌ب", "تا", "x", " ", ""]
    letters = lambda n: n.replace(" ", "").replace("‌", "")
    crops = {f"c{k}": np.log(rng.dirichlet(np.ones(4), t)) for k, t in enumerate((1, 2, 5, 6))}
    got = {(r.crop, r.name): r.score for r in matching.ctc_scores(frames_of(spark, crops).repartition(3), "crop", names, symbols).collect()}
    usable = [n for n in names if letters(n) and "x" not in n and "ت" not in n]
    assert got.keys() == {(c, n) for c in crops for n in usable}
    for c, p in crops.items():
        want = paths(p, symbols)
        for n in usable:
            assert math.isclose(math.exp(got[c, n]), want.get(letters(n), 0.0), rel_tol=1e-9, abs_tol=1e-300)


def test_best_and_runner_up(spark):
    rng = np.random.default_rng(3)
    symbols = ["_", "ا", "ب"]
    crops = {k: np.log(rng.dirichlet(np.ones(3), 4)) for k in "pqrs"}
    df = frames_of(spark, crops)
    names = ["اب", "با", "ا", "ب", "ابا"]
    got = {r.crop: r for r in matching.score_lexicon(df, "crop", names, symbols, -99.0, 0.0).collect()}
    for c, p in crops.items():
        want = sorted(((math.log(paths(p, symbols)[n]), -k) for k, n in enumerate(names)), reverse=True)
        assert got[c].value == names[-want[0][1]] and math.isclose(got[c].margin, want[0][0] - want[1][0], abs_tol=1e-9)
    # names of the same letters don't lead each other; a single name has no runner-up
    assert not matching.score_lexicon(df, "crop", ["ا ب", "اب"], symbols, -99.0, 1e-9).head(1)
    assert {r.value for r in matching.score_lexicon(df, "crop", ["ا ب", "اب"], symbols, -99.0, 0.0).collect()} == {"ا ب"}
    assert not matching.score_lexicon(df, "crop", ["اب"], symbols, -99.0, 0.0).head(1)


def test_shared_prefixes_share_nodes():
    t = trie.Trie([("abc", "abc"), ("abd", "abd"), ("ab", "ab"), ("zz", "zz"), ("az", "az")], ["_", *"abcd"])
    assert len(t.parent) == 5 and t.names == ["abc", "abd", "ab"]


def test_scores_come_along(spark):
    names = spark.createDataFrame([(n, n, n) for n in ("ab", "ab?")], "name string, key string, fold string")
    words = spark.createDataFrame([(1, "ab", "ab", "ab")], "ord long, word string, key string, fold string")
    scored = spark.createDataFrame([("ab?", "ab", -1.5, 0.25), ("ab", "ab", -9.0, 0.1)], "name string, value string, score double, margin double")
    got = {r.name: (r.value, r.method, r.score, r.margin) for r in matching.resolve_names(names, words, scored).collect()}
    assert got == {"ab": ("ab", "exact", None, None), "ab?": ("ab", "ctc", -1.5, 0.25)}
