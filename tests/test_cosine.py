"""The cosine query sees pairs of different rows."""

from attesta.plans import catalog

def test_cosine_sees_two_rows(spark, sf):
    got = {r.vec_id: r for r in catalog.queries()["fn15_cosine"](spark, sf).collect()}
    cases = {r.case_id: r.similarity for r in catalog.queries()["jn8_verify_pairs"](spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert all(got[2 * k].pair == got[2 * k + 1].pair == x for k, x in cases.items())
