"""Queries over whole texts, not their first line or word, against plain Python."""

import hashlib
import unicodedata

from attesta.plans import catalog


def test_transcripts_and_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL").collect()
    want = []
    for r in docs:
        for i, t in enumerate(r.text.split("\n")):
            bad = r.n_chars % 9 == 0 or "\t" in t
            want.append((r.doc_id, i, bad, None if bad else r.source, None if bad else unicodedata.normalize("NFC", t).strip(" ")))
    got = [tuple(r) for r in catalog.queries()["src2_transcripts"](spark, sf).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    plain = {r.doc_id: " ".join(r.text.split()) for r in docs if r.text.isascii() and r.text.isprintable()}
    clean = {r.doc_id: r.clean for r in catalog.queries()["fn4_normalize_text"](spark, sf).collect()}
    assert len(clean) == len({r.doc_id for r in docs}) and plain
    assert {k: clean[k] for k in plain} == {k: hashlib.md5(t.encode()).hexdigest() for k, t in plain.items()}
