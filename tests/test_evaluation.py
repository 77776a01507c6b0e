"""Evaluation, decision and matching operators on small tables with nulls, ties and repeated rows."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.functions import text
from attesta.operators import decisions, evaluation, matching, sessions
from attesta.streaming import flows, machines


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_text_keys(spark):
    df = spark.createDataFrame([("گەڕێ ۆڵڤ",), ("می‌ رود\t x",), (None,), ("",)], "t string")
    got = df.select(text.base_key(F.col("t")), text.label_of(F.col("t"))).collect()
    assert got[0][0] == "کهریولف" and got[1][1] == "می رود x"
    assert got[2][1] == got[3][1] == got[2][0] == ""


def test_crop_keys_and_labels(spark):
    df = spark.createDataFrame([("a__b/train_3__x__first_name.png", "abc"), ("val_1.png", "abcd"), (None, None)], "path string, label string")
    assert [tuple(r) for r in evaluation.crop_keys(df, "path").select("field", "split").collect()] == [("first_name", "train"), ("val_1", "val"), (None, None)]
    kept, counts = evaluation.fit_labels(df, "label", 3)
    assert kept.count() == 1 and tuple(counts.first()) == (1, 2)
    assert tuple(evaluation.fit_labels(df.limit(0), "label", 3)[1].first()) == (0, 0)


def test_truth_join(spark):
    truth = spark.createDataFrame([(1, "name", "علی"), (2, "name", "علی"), (3, "digits", "12"), (4, "digits", "12"), (5, "name", "علی"), (6, "name", None)], "id long, kind string, truth string")
    read = spark.createDataFrame([(1, "على "), (2, "ولی"), (3, "۱۲"), (4, "12")], "id long, read string")
    assert [r.right for r in evaluation.truth_join(truth, read, ["id"]).orderBy("id").collect()] == [True, False, False, True, False, False]


def test_group_accuracy(spark):
    df = spark.createDataFrame([("m1", "ەل", "ەل"), ("m1", "گل", "کل"), ("m2", "گل", None)], "backend string, truth string, read string")
    got = {(r.backend, r.group): (r.n, r.letters, r.base) for r in evaluation.group_accuracy(df, {"kurdish": evaluation.kurdish("truth")}, evaluation.name_keys("truth", "read"), ("backend",)).collect()}
    assert got == {("m1", "all"): (2, 0.5, 1.0), ("m1", "kurdish"): (1, 1.0, 1.0), ("m2", "all"): (1, 0.0, 0.0)}


def test_checks(spark):
    f = spark.createDataFrame([("mask", ["a", "b"]), ("mask", []), ("mask", None), ("normal", ["b", "c"]), ("normal", ["b"]), ("odd", ["a"])], "label string, codes array<string>")
    rates, others = evaluation.check_rates(f, "label", "codes", spark.createDataFrame([("mask", "a")], "label string, code string"))
    assert rows(rates) == [("mask", "a", 3, 1)] and rows(others) == [("mask", "b", 1)]
    assert [tuple(r) for r in evaluation.wrong_blocks(f, "label", "codes", ("normal",)).collect()] == [("normal", "b", 2), ("normal", "c", 1)]
    fields = spark.createDataFrame([(1, "x"), (2, "x"), (1, "y")], "doc int, field string")
    found = spark.createDataFrame([(1, "x"), (1, "x"), (3, "y")], "doc int, field string")
    assert rows(evaluation.location_rates(fields, found, ["doc", "field"], "field")) == [("x", 1, 1), ("y", 0, 1)]
    assert rows(evaluation.run_counts(found, "doc", "field")) == [("doc", "1", 2), ("doc", "3", 1), ("field", "x", 2), ("field", "y", 1)]


def test_rounds(spark):
    df = spark.createDataFrame([("a_r2",), ("a_r10",), ("b",), (None,)], "name string")
    assert evaluation.next_round(df, "name").first()[0] == 11 and evaluation.next_round(df.limit(0), "name").first()[0] == 1
    a, b = (spark.createDataFrame([(c,) for c in x], "ch string") for x in ("aab", "bc"))
    assert rows(evaluation.alphabet_gap(a, b)) == [("a",)]
    s = spark.createDataFrame([(1, "test"), (2, "train"), (3, None), (4, "test")], "id int, split string")
    held, pool = evaluation.separate_eval(s, "split", "id", 1, s.where("id = 4"))
    assert rows(held) == [(1, "test")] and rows(pool) == [(2, "train"), (3, None)]
    assert evaluation.separate_eval(s, "split", "id", 2)[0].count() == 0
    with pytest.raises(ValueError, match="training pool"):
        evaluation.separate_eval(s.union(s.selectExpr("id", "'train'")), "split", "id", 2)


def test_join_words(spark):
    df = spark.createDataFrame([(1, 5.0, " b ", 0.5), (1, 9.0, "aa", 1.0), (1, 7.0, " ", 0.1), (2, 5.0, "x", 2.0), (2, 5.0, "w", 2.0), (3, 1.0, "", 1.0), (4, None, None, None)], "k int, x double, w string, c double")
    rtl = evaluation.join_words(df, ["k"], "x", "w", "c", F.lit(False))
    assert rows(rtl) == [(1, "aa b", pytest.approx(2.5 / 3)), (2, "w x", 1.0), (3, "", 0.0), (4, "", 0.0)]
    assert evaluation.join_words(df, ["k"], "x", "w", "c", F.col("x").isNotNull()).where("k = 1").first().text == "b aa"


def test_field_findings_and_reuse(spark):
    r = spark.createDataFrame([("id", "12", 0.1), ("id", "123", 0.9), ("id", "", 0.1), ("id", None, None), ("other", "x", 0.2), (None, "x", 0.9)], "field string, value string, confidence double")
    spec = spark.createDataFrame([("id", 3)], "field string, exact_len int")
    got = {(x.field, x.value): x.findings for x in decisions.field_findings(r, spec, 0.3).collect()}
    assert got == {("id", "12"): ["field_low_confidence", "field_length_mismatch"], ("id", "123"): [], ("id", ""): [], ("id", None): [], ("other", "x"): ["field_low_confidence"], (None, "x"): []}
    cases = spark.createDataFrame([(1, "s", "c"), (1, "s", "new"), (2, None, "c")], "case_id int, capture_id string, card string")
    made = spark.createDataFrame([(1, "s", "c", 7, 1), (1, "s", "c", 8, 2), (2, "s", "c", 9, 1)], "case_id int, capture_id string, card string, match_id int, made int")
    assert rows(decisions.reuse_match(cases, made).select("card", "match_id")) == [("c", 8), ("c", None), ("new", None)]
    m = spark.createDataFrame([("Adobe PHOTOSHOP 24",), ("paintXnet",), ("Paint.NET",), (None,)], "s string")
    assert [x.edited for x in decisions.flag_editors(m, "s").collect()] == [True, False, True, False]


def test_policy_as_of_keeps_all_rows(spark):
    day = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    p = spark.createDataFrame([("v1", day(2)), ("v2", day(2, 12)), ("v3", day(5)), ("v0", day(5)), ("none", None)], "version string, valid_from timestamp")
    v = spark.createDataFrame([(1, day(1)), (2, day(2, 3)), (2, day(2, 3)), (3, day(2, 12)), (4, day(4)), (5, day(9)), (6, None)], "id int, at timestamp")
    got = [(r.id, r.version) for r in decisions.policy_as_of(v, p, "at").orderBy("id").collect()]
    assert got == [(1, None), (2, "v1"), (2, "v1"), (3, "v2"), (4, "v2"), (5, "v3"), (6, None)]
    assert decisions.policy_as_of(v, p.limit(0), "at").where("version IS NULL").count() == 7


def test_names_that_share_a_key(spark):
    names = spark.createDataFrame([("ab cdef", "abcdef", "abcdef"), ("abcd ef", "abcdef", "abcdef"), ("abcd ef", "abcdef", "abcdef"), ("zzz", "zzz", "zzz"), (None, None, None), ("", "", "")], "name string, key string, fold string")
    lex = spark.createDataFrame([(1, "abcdeg", "abcdeg", "abcdeg"), (2, "abcdeh", "abcdeh", "abcdeh")], "ord long, word string, key string, fold string")
    got = rows(matching.resolve_names(names, lex).select("name", "value", "method", "flag"))
    assert got == sorted([("ab cdef", "abcdeg", "nearest", None), ("abcd ef", "abcdeg", "nearest", None), ("abcd ef", "abcdeg", "nearest", None), ("zzz", None, "none", "name_not_in_list"), (None, None, "none", None), ("", None, "none", None)], key=repr)
    assert matching.lexicon_nearest(names, lex).count() == 3
    assert matching.resolve_names(names, lex.limit(0)).where("value IS NULL").count() == 6


def test_groups_of_a_long_chain(spark):
    rng = np.random.default_rng(3)
    order = rng.permutation(400).tolist()
    links = [(order[i], order[i + 1], 1.0) for i in range(399)] + [(1000, 1001, 1.0), (1001, 1002, 0.1), (5, 5, 1.0)]
    got = {r.id: r.root for r in matching.identity_groups(spark.createDataFrame(links, "id long, other long, score double"), "score", 0.5).collect()}
    assert got == {**dict.fromkeys(range(400), 0), 1000: 1000, 1001: 1000}


def test_pairs_of_queries(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(50, 4))
    df = spark.createDataFrame([(i, i % 3 if i % 7 else None, v[i].tolist()) for i in range(50)] + [(60, 1, None)], "id long, identity int, embedding array<double>").repartition(4)
    want = {(a, b) if b % 20 or a < b else (b, a) for a in range(0, 50, 20) for b in range(50) if a != b}
    got = matching.evaluation_pairs(df).collect()
    assert len(got) == len(want) and {(r.id, r.other) for r in got} == want
    for r in got:
        assert r.similarity == pytest.approx(v[r.id] @ v[r.other] / np.sqrt((v[r.id] @ v[r.id]) * (v[r.other] @ v[r.other])))
        assert r.genuine == (r.id % 7 > 0 and r.other % 7 > 0 and r.id % 3 == r.other % 3)


def test_reap_expired(spark):
    t = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    df = spark.createDataFrame([(1, t(5)), (1, t(1)), (2, t(9))], "k int, ts timestamp")
    assert rows(sessions.reap_expired(df, "k", "ts", 10)) == [(1, t(1), t(11), t(21)), (2, t(9), t(19), t(29))]


def test_liveness_budget_and_identity():
    base = {"faces": 1, "yaw": 0.0, "eyes": 0.3, "mouth": 0.5, "height": 100.0, "similarity": 0.9}
    cfg = machines.LIVE | {"frames": 3, "samples": 99}
    state = None
    for n in range(5):
        state, said = machines.liveness_step(state, base | {"ts": float(n)}, ["BLINK"], cfg)
    assert state["state"] == "FAILED" and said["code"] == "session_closed" and state["frames"] == 4
    # the first frontal frame is compared, then every second
    state, codes = None, []
    for n, s in enumerate([0.9, 0.9, 0.1, 0.1]):
        state, said = machines.liveness_step(state, base | {"ts": float(n), "similarity": s}, ["BLINK"], machines.LIVE | {"samples": 99})
        codes.append(said["code"])
    assert codes == ["", "", "", "face_changed"]


def test_verdict_stream(spark, tmp_path):
    need = ("document", "selfie")
    t = lambda m: datetime.datetime(2024, 1, 1, 10, m)
    none = (None, None, None, None, None)
    ok = lambda step, said=None, decision="pass": (step, "done", decision, 0.8, said)
    events = [
        [(1, t(0), "opened", *none), (2, t(0), "opened", *none), (3, t(0), "opened", *none), (1, t(1), "result", *ok("document")), (1, t(2), "result", *ok("selfie")), (2, t(3), "result", *ok("document")), (3, t(2), "result", *ok("selfie", [("spoof", "error")], "fail"))],
        [(1, t(4), "result", *ok("document", None, "fail")), (3, t(5), "result", *ok("document")), (2, t(59), "result", *ok("selfie"))],
        [(9, t(59), "opened", *none)],
    ]
    schema = "case_id int, at timestamp, kind string, step string, status string, decision string, score double, reasons array<struct<code:string,severity:string>>"
    for n, part in enumerate(events):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = flows.verdict_stream(stream, need, ("spoof",))
    q = out.writeStream.format("memory").queryName("verdicts").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.case_id: (r.verdict, r.blocking, r.review_score) for r in spark.table("verdicts").collect()}
    assert got == {1: ("approved", "", 0.8), 2: ("manual_review", "selfie:step_missing", 0.8), 3: ("rejected", "selfie:spoof", 0.8)}
    q = flows.reap_expired(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "case_id", "at", 600).writeStream.format("memory").queryName("dropped").outputMode("append").option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("dropped")) == [(k, t(0), t(20)) for k in (1, 2, 3)]


def test_verdicts_of_odd_cases(spark):
    cases = spark.createDataFrame([(1,), (1,), (2,), (None,)], "case_id int")
    res = spark.createDataFrame([(1, "document", "done", "pass", None), (2, "document", "done", "review", 0.2), (2, "document", "done", "review", 0.4), (None, "document", "done", "pass", 0.9), (7, "document", "done", "pass", 0.9)], "case_id int, step string, status string, decision string, score double")
    why = spark.createDataFrame([(1, "document", "old", "warn"), (1, "document", "old", "warn"), (1, "selfie", "x", "error"), (None, "document", "y", "error"), (2, "document", "z", "info")], "case_id int, step string, code string, severity string")
    got = rows(decisions.case_verdict(cases, res, why, ("document",), ("x",)))
    assert got == sorted([(1, "manual_review", "document:old,document:old", 0.0)] * 2 + [(2, "manual_review", "document:document_review,document:document_review", 0.2), (None, "manual_review", "document:step_missing", 0.0)], key=repr)


def test_findings_of_a_frequent_field_stay_dealt(spark):
    r = spark.range(80, numPartitions=8).select(F.lit("name").alias("field"), F.col("id").cast("string").alias("value"), F.lit(0.9).alias("confidence"))
    spec = spark.createDataFrame([("name", 2)], "field string, exact_len int")
    got = decisions.field_findings(r, spec, 0.3).withColumn("part", F.spark_partition_id()).collect()
    assert len(got) == 80 and sum(x.findings == ["field_length_mismatch"] for x in got) == 10
    assert len({x.part for x in got}) == 8
