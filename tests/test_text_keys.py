"""Composition only where it may change a text, and match keys against the names they are the letters of."""

import unicodedata

from pyspark.sql import functions as F

from attesta.functions import text


def test_settled_characters_stay_as_they_are():
    parts = [unicodedata.decomposition(chr(c)).split() for c in range(0x110000)]
    second = {int(p[1], 16) for p in parts if len(p) == 2 and "<" not in p[0]} | set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    for a, b in ((0, 0x2FF), *text.SETTLED):
        for c in range(a, b + 1):
            assert unicodedata.is_normalized("NFC", chr(c)) and not unicodedata.combining(chr(c)) and c not in second


def test_only_unsettled_text_goes_to_python(spark):
    made = ["plain", "naïve é", "été", "می‌رود", "آب", "Ω", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(made)], "k int, t string")
    got = {r.k: r.out for r in df.select("k", text.nfc(F.col("t")).alias("out")).collect()}
    assert got == {k: t and unicodedata.normalize("NFC", t) for k, t in enumerate(made)}
    plan = df.select(text.nfc(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "_nfc(CASE WHEN" in plan  # what Python is given is null where nothing can change


def test_match_key_is_the_letters_of_the_name(spark):
    every = [chr(c) for c in (*range(0x20, 0x250), *range(0x600, 0x700), *range(0x2000, 0x2070), 0xFEFF, 0xFB50, 0xFE8D, 0x1F600)]
    made = ["ب" + "".join(every[k : k + 7]) + " پ‌ ج" for k in range(len(every))] + ["", None, "‌ ", "آً ٰب", "هٔ"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(made)], "k int, t string")
    name = F.translate(text.normalize_name(F.col("t")), " " + text.ZWNJ, "")
    assert df.select("k", text.match_key(F.col("t")).alias("key"), name.alias("name")).where("NOT key <=> name").collect() == []
