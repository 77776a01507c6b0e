"""Golden values and invariants of functions, decisions, machines and files."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.functions import dates, measures, text
from attesta.operators import curation, decisions, matching
from attesta.sources import archive, readers
from attesta.streaming import flows, machines


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize(("raw", "want"), [("3618472056", True), ("1000000011", True), ("3618472055", False), ("1000000010", False), ("7777777777", False), ("36184", False), ("36184x2056", False), ("", False), (None, False)])
def test_national_id(spark, raw, want):
    assert one(spark, raw, dates.valid_national_id) is want


def test_jalali(spark):
    want = {"1300/1/1": "1921-03-21", "1358/11/22": "1980-02-11", "1370/1/1": "1991-03-21", "1398/12/29": "2020-03-19", "1399/12/30": "2021-03-20", "1403/1/1": "2024-03-20", "1400/12/30": None, "1370/13/01": None, "1370/00/10": None, "1370/05/32": None, "1100/01/01": None, "junk": None, None: None}
    df = spark.createDataFrame([(k,) for k in want], "v string").select("v", dates.to_date(F.col("v")).cast("string").alias("o"))
    assert {r.v: r.o for r in df.collect()} == want
    on = lambda day: F.lit(day).cast("date")
    assert one(spark, "1370/05/12", lambda c: dates.age_on(c, on("2024-08-02"))) == 32
    assert one(spark, "1370/05/12", lambda c: dates.age_on(c, on("2024-08-03"))) == 33
    assert one(spark, "1399/05/12", lambda c: dates.is_expired(c, on("2026-01-01"))) is True
    assert one(spark, "1410/05/12", lambda c: dates.is_expired(c, on("2026-01-01"))) is False


def test_normalise(spark):
    for raw, want in {"no. ۷5٤": "no. 754", "كريمي": "کریمی", "حســني  كاظم 9": "حسنی کاظم 9", "نور ‌الدین": "نور‌الدین", None: "", "ھێمن": "هێمن"}.items():
        assert one(spark, raw, text.normalize_text) == want
    assert one(spark, "حســني  كاظم 9", text.normalize_name) == "حسنی کاظم"
    assert one(spark, "نادر۔", text.normalize_name) == "نادر"
    assert one(spark, "۳۶۱-۸۴۷۲۰۵-۶", text.keep_digits) == "3618472056"
    for raw, want in {"1370-5-2": "1370/05/02", "13700512": "1370/05/12", "70/5/12": None, "1370/05": None, "garbage": None, "": None}.items():
        assert one(spark, raw, text.normalize_date) == want
    assert one(spark, "abc 12", text.reading_order) == "12 abc"


def test_names(spark):
    names = ["گلناز", "پروین", "سارا", "نادر"]
    lex = spark.createDataFrame(list(enumerate(names)), "ord int, word string").withColumns({"key": text.match_key(F.col("word")), "fold": text.fold_key(F.col("word"))})
    read = spark.createDataFrame([("پروین",), ("کلناز",), ("پرویم",), ("نب",)], "name string").withColumns({"key": text.match_key(F.col("name")), "fold": text.fold_key(F.col("name"))})
    got = {r.name: (r.value, r.method) for r in matching.resolve_names(read, lex).collect()}
    assert got == {"پروین": ("پروین", "exact"), "کلناز": ("گلناز", "exact"), "پرویم": ("پروین", "nearest"), "نب": (None, "none")}


def test_ctc_scores(spark):
    rng = np.random.default_rng(2)
    p = np.log(rng.dirichlet(np.ones(4), 5))
    frames = spark.createDataFrame([("c", t, [float(x) for x in row]) for t, row in enumerate(p)], "crop string, t int, logp array<double>")
    got = {r.name: r.score for r in matching.ctc_scores(frames, "crop", ["a", "ab", "bb", "cab", "zz"], ["_", "a", "b", "c"], letters=lambda c: c).collect()}
    want = dict.fromkeys(["a", "ab", "bb", "cab"], 0.0)
    for path in itertools.product(range(4), repeat=5):
        said = "".join("_abc"[k] for k, _ in itertools.groupby(path)).replace("_", "")
        if said in want:
            want[said] += math.exp(sum(p[t, k] for t, k in enumerate(path)))
    assert got.keys() == want.keys() and all(math.isclose(math.exp(got[k]), v) for k, v in want.items())


ALL = ("document", "selfie", "antispoof", "face_match", "liveness")


@pytest.mark.parametrize(
    ("step", "status", "decision", "reason", "want"),
    [(None,) * 4 + (("approved", ""),), ("antispoof", "done", "fail", ("spoof_detected", "error"), ("rejected", "antispoof:spoof_detected")), ("document", "done", "fail", ("national_id_checksum", "error"), ("manual_review", "document:national_id_checksum")), ("antispoof", "unavailable", "pass", None, ("manual_review", "antispoof:module_unavailable")), ("liveness", None, None, None, ("manual_review", "liveness:step_missing")), ("liveness", "done", "review", None, ("manual_review", "liveness:liveness_review")), ("document", "done", "review", ("under_age", "warn"), ("manual_review", "document:under_age"))],
)
def test_verdict(spark, step, status, decision, reason, want):
    res = [("c", s, "done", "pass", 1.0) if s != step else ("c", s, status, decision, 0.5) for s in ALL if s != step or status]
    rs = [("c", step, *reason)] if reason else []
    got = decisions.case_verdict(
        spark.createDataFrame([("c",)], "case_id string"), spark.createDataFrame(res, "case_id string, step string, status string, decision string, score double"),
        spark.createDataFrame(rs, "case_id string, step string, code string, severity string"), ALL, ("spoof_detected", "faces_do_not_match"),
    ).first()
    assert (got.verdict, got.blocking) == want


def test_bands_and_modes(spark):
    df = spark.createDataFrame([(0.70,), (0.4501,), (0.36,), (0.27,), (0.10,)], "s double")
    assert [r.decision for r in decisions.band(df, "s", 0.45, 0.25).collect()] == ["pass", "pass", "review", "review", "fail"]
    with pytest.raises(ValueError, match="unknown"):
        decisions.resolve_modes({"nothing": "off"})
    with pytest.raises(KeyError, match="ir_national_card_front"):
        decisions.profile("xx")
    assert decisions.resolve_modes({"gaze": "off"}, {"gaze": "info"})["gaze"] == "info"


def test_jitter_and_iou(spark):
    df = spark.createDataFrame([(100.0, 100.0, 200.0, 200.0)], "x1 double, y1 double, x2 double, y2 double")
    assert measures.jitter_boxes(df, 0.1).count() == 9 and measures.jitter_boxes(df, 0).count() == 1
    box = F.struct("x1", "y1", "x2", "y2")
    assert df.select(measures.iou(box, box)).first()[0] == 1.0


def run(step, events, **cfg):
    s, out = None, []
    for e in events:
        s, o = step(s, e, **cfg)
        out.append(o)
    return out


def test_capture_machine():
    f = lambda t, code="", kind="stream", sharp=10.0, sim=0.9: {"ts": float(t), "kind": kind, "sharpness": sharp, "code": code, "similarity": sim}
    states = lambda *e, **c: [(o["state"], o["code"]) for o in run(machines.capture_step, e, **c)]
    assert states(f(0), f(1), f(2, kind="still"))[-1] == ("CAPTURED", "")
    assert [s for s, _ in states(f(0), f(1, "x"), f(2), f(3))] == ["SEARCHING"] * 3 + ["READY_FOR_STILL"]
    assert states(f(0), f(1), f(2, kind="still", sim=0.1))[-1] == ("SEARCHING", "still_face_mismatch")
    assert states(f(0), f(1), f(2, kind="still", sharp=6.9))[-1] == ("SEARCHING", "face_blurry")
    assert states(f(0, "x"), f(1, "x"), f(2), budget=2)[-1] == ("FAILED", "too_many_frames")
    assert states(f(0), f(500))[-1] == ("FAILED", "capture_timeout")


def test_liveness_machine():
    f = lambda t, yaw=0.0, eyes=0.3, mouth=1.0, height=100.0, faces=1, sim=0.9: {"ts": float(t), "faces": faces, "yaw": yaw, "eyes": eyes, "mouth": mouth, "height": height, "similarity": sim}
    last = lambda *e, tasks: run(machines.liveness_step, e, tasks=tasks)[-1]
    base = [f(0), f(1), f(2)]
    assert last(*base, f(3, eyes=0.1), f(4), tasks=["BLINK"])["state"] == "VERIFIED"
    assert last(*base, f(3), f(4), tasks=["BLINK"])["state"] == "RUNNING"
    assert last(*base, f(3, yaw=30.0), tasks=["TURN_LEFT"])["state"] == "RUNNING"  # never frontal since
    assert last(*base, f(3), f(4, yaw=30.0), tasks=["TURN_LEFT"])["state"] == "VERIFIED"
    assert last(*base, f(3, sim=0.1), tasks=["BLINK"])["code"] == "face_changed"
    assert last(*base, f(3, faces=0), f(6, faces=0), tasks=["BLINK"])["code"] == "face_lost"
    assert last(*base, f(30), tasks=["BLINK"])["code"] == "task_timeout"
    assert last(f(0), f(130), tasks=["BLINK"])["state"] == "EXPIRED"


def test_lifecycle_machine():
    codes = lambda *a, **c: [o["code"] for o in run(machines.lifecycle_step, [{"action": x} for x in a], **c)]
    assert codes("liveness") == ["selfie_missing"]
    assert codes("document", "finalize")[-1] == "selfie_missing,liveness_missing"
    assert codes("document", "document", "document", limit=2)[-1] == "attempts_exhausted"
    assert codes("document", "selfie", "liveness", "finalize", "finalize", "document") == ["", "", "", "", "", "case_finalized"]


def test_idle_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (1, "2024-01-01 01:00:00"), (1, "2024-01-01 03:00:00")], "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    q = flows.reap_idle(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "user_id", "ts").writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.events for r in spark.table("idle").collect()) == [1, 2]


def test_archive(spark, tmp_path):
    key = F.lit("0123456789abcdef")
    cases = spark.createDataFrame([(1, "2020-01-01", "secret"), (2, "2024-01-01", "other")], "case_id long, d string, p string")
    path = str(tmp_path / "a")
    archive.archive_cases(archive.sealed(cases, F.col("p"), key, F.col("d")), path)
    (tmp_path / "a" / "notes").mkdir()
    back = spark.read.option("basePath", path).parquet(f"{path}/day=*")
    assert archive.open_case(back, 1, key) == b"secret"
    assert b"secret" not in b"".join(x.read_bytes() for x in (tmp_path / "a").rglob("*.parquet"))
    with pytest.raises(KeyError):
        archive.open_case(back, 9, key)
    with pytest.raises(ValueError, match="key"):
        archive.open_case(back, 1, F.lit("fedcba9876543210"))
    assert archive.purge(spark, path, "2024-02-01", 365) == 1
    assert sorted(x.name for x in (tmp_path / "a").iterdir() if x.is_dir()) == ["day=2024-01-01", "notes"]


def test_files(spark, tmp_path):
    (tmp_path / "kind").mkdir()
    (tmp_path / "kind" / "real__1.bin").write_bytes(b"x")
    (tmp_path / "kind" / "fake-2.bin").write_bytes(b"y")
    got = {(r.label, r.kind) for r in readers.read_labelled_media(spark, str(tmp_path), "*.bin").collect()}
    assert got == {("real", "kind"), ("fake", "kind")}
    (tmp_path / "t.tsv").write_text("a\tx y \nb\nc\t1\t2\n")
    good, bad = readers.read_transcripts(spark, str(tmp_path / "t.tsv"))
    assert [tuple(r) for r in good.collect()] == [("a", "x y")] and bad.count() == 2
    (tmp_path / "l.txt").write_text("0 0.5 0.5 0.2 0.2\n1 0 0 1 0 1 1\nx 1 2 3 4\n2 1 2 3\n")
    rows = readers.read_annotations(spark, str(tmp_path / "l.txt")).collect()
    assert [r.problem for r in rows] == [None, None, "class", "coordinates"]
    assert rows[1].box.asDict() == {"x1": 0.0, "y1": 0.0, "x2": 1.0, "y2": 1.0}


def test_splits_and_references(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 2) for i in range(10)], "id long, c int")
    out = curation.split_dataset(df, "id", 0.2, 0.1, 1)
    assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"val": 2, "test": 1, "train": 7}
    with pytest.raises(ValueError, match="no rows"):
        archive.export_splits(out, str(tmp_path / "s"), [0, 1, 2], "c")
    archive.save_reference(df, str(tmp_path / "r"), "v1")
    assert archive.load_reference(spark, str(tmp_path / "r"), "v1").count() == 10
    with pytest.raises(LookupError):
        archive.load_reference(spark, str(tmp_path / "r"), "v2")
    df2 = spark.createDataFrame([("valid",), ("val",), ("train",)], "split string")
    assert sorted(r.split for r in curation.merge_split_aliases(df2, "split", {"val": ["val", "valid"]}).collect()) == ["train", "val"]
    boxes = spark.createDataFrame([("i", "a", (0.0, 0.0, 1.0, 1.0))], "image string, class string, box struct<x1:double,y1:double,x2:double,y2:double>")
    assert matching.iou_recall(boxes, boxes).first().recall == 1.0
