"""Decontamination of rows that share an id or have none, by a broadcast benchmark and by one that stays in Spark."""

import brute
import pytest

from attesta.llm import decontaminate


@pytest.mark.parametrize("block", [1, 2, 5, 100])
def test_rows_stay_apart(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    w = [f"w{i}" for i in range(40)]
    docs = [(None, " ".join(w[:12])), (None, "nothing here"), (None, None), (7, " ".join(w[20:32])), (7, " ".join(w[:25]) + " x"), (7, ""), (7, " ".join(w[20:32])), (8, "w1 w2 w3"), (9, " ".join(w))]
    items = [(1, " ".join(w[:11])), (2, " ".join(w[20:31])), (3, "w2 W3"), (4, None), (5, " ".join(w[8:22])), (2, " ".join(w[28:39]))]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    b = spark.createDataFrame(items, "item_id long, text string")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = [tuple(r[n] for n in names) for r in decontaminate.report(decontaminate.scan(d, b)).collect()]
    assert sorted(got, key=repr) == sorted(brute.contamination(docs, items), key=repr)


@pytest.mark.parametrize("block", [0, 100])
def test_items_without_an_id_and_a_window_that_most_rows_have(spark, monkeypatch, block):
    """Half of the rows hold one window; two items have no id."""
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    w = [f"v{i}" for i in range(30)]
    docs = [(i, " ".join(w[:12]) if i % 2 else f"row {i} of its own") for i in range(3000)]
    items = [(None, " ".join(w[:10])), (None, " ".join(w[1:11])), (4, " ".join(w[2:12])), (5, "of its own"), (6, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in decontaminate.report(decontaminate.scan(d, spark.createDataFrame(items, "item_id long, text string"))).collect()}
    want = {r[0]: r for r in brute.contamination(docs, items)}
    assert len(got) == 3000
    for i, r in got.items():
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (*want[i][1:4], want[i][5])
        assert r.items_sha256 == brute.sha("4" if i % 2 else "5")
