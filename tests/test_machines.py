"""Session machines: deadlines without a further event, the live check, and streams against the batch twin."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.streaming import machines

FRAME = "session_id long, event_id long, ts double, kind string, sharpness double, code string, similarity double, score double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run(step, events, **cfg):
    s, out = None, []
    for e in events:
        s, o = step(s, e, **cfg)
        out.append(o)
    return out


def frame(t, code="", kind="stream", sharp=10.0, sim=0.9, score=0.5):
    return {"event_id": int(t), "ts": float(t), "kind": kind, "sharpness": sharp, "code": code, "similarity": sim, "score": score}


def test_blur_against_the_sharpest_frame():
    codes = lambda *e, **c: [o["code"] for o in run(machines.capture_step, e, **c)]
    seen = [frame(0, "x", sharp=20.0), frame(1, sharp=9.0), frame(2, sharp=9.0), frame(3, sharp=10.0)]
    assert codes(*seen, stream_ratio=0.5) == ["x", "", "face_blurry", ""]  # not before the third frame; half of it is enough
    assert codes(*seen) == ["x", "", "", ""]


def test_best_frame_without_a_still():
    out = run(machines.capture_step, [frame(0, score=0.9), frame(1, "x"), frame(2, score=0.4), frame(3, score=0.7), frame(4, score=0.7), frame(5)], required=3, still=False)
    assert [(o["state"], o["captured"]) for o in out] == [("SEARCHING", None)] * 4 + [("CAPTURED", 3), ("CAPTURED", None)]


@pytest.mark.parametrize(("live", "scores", "said"), [("block", [0.1, 0.9, 0.1], ("fail", "spoof_during_session", 0.1)), ("block", [0.3, 0.3, 0.3], ("review", "spoof_uncertain", 0.3)), ("block", [0.9, 0.9, 0.1], ("pass", "", 0.9)), ("info", [0.1, 0.1, 0.1], ("pass", "antispoof_video_score", 0.1)), ("off", [0.1] * 3, ("pass", "", None))])
def test_live_check(live, scores, said):
    f = lambda t, s, eyes=0.3, sharp=9.0: {"ts": float(t), "faces": 1, "yaw": 0.0, "eyes": eyes, "mouth": 1.0, "height": 100.0, "similarity": 0.9, "live": s, "sharpness": sharp}
    cfg = machines.LIVE | {"live": live}
    # frames 1, 2 and 4 are scored: the first, then those whose number divides by two
    frames = [f(0, scores[0]), f(1, scores[1]), f(2, 0.55), f(3, scores[2], eyes=0.1), f(4, 0.55)]
    last = run(machines.liveness_step, frames, tasks=["BLINK"], cfg=cfg)[-1]
    assert (last["state"], last["decision"], last["code"], last["live"]) == ("VERIFIED", *said)
    blurry = run(machines.liveness_step, [e | {"sharpness": 1.0} for e in frames], tasks=["BLINK"], cfg=cfg)[-1]
    assert blurry["code"] == ("antispoof_not_checked" if live == "block" else "")


def test_cases_lapse():
    codes = [o["code"] for o in run(machines.lifecycle_step, [{"action": a, "ts": t} for a, t in (("document", 0.0), ("selfie", 1799.0), ("liveness", 1800.0), ("finalize", 1801.0))])]
    assert codes == ["", "", "case_expired", "case_expired"]


def test_deadlines_in_batch(spark):
    rows = [(1, 0, 0.0), (1, 1, 50.0), (2, 2, 0.0), (2, 3, 500.0), (3, 4, 10.0), (3, 5, 11.0), (3, 6, 12.0)]
    df = spark.createDataFrame([(s, i, t, "still" if i == 6 else "stream", 10.0, "", 0.9, 0.5) for s, i, t in rows], FRAME)
    df = df.withColumn("code", F.when(F.col("session_id") < 3, "dark").otherwise(""))
    got = lambda until=None: {(r.session_id, r.event_id, r.state, r.code) for r in machines.capture_batch(df, until).collect() if r.code not in ("dark", "")}
    assert got() == {(1, None, "FAILED", "capture_timeout"), (2, None, "FAILED", "capture_timeout"), (2, 3, "FAILED", "session_closed")}
    assert not [r for r in got(119.0) if r[0] == 1] and [r for r in got(120.0) if r[0] == 1]


def sessions():
    """Events of many sessions over ten minutes, some of which just stop; the last row moves the watermark on."""
    rng = np.random.default_rng(5)
    rows = []
    for s in range(25):
        t = float(rng.integers(0, 300))
        for _ in range(rng.integers(1, 12)):
            rows.append((s, len(rows), round(t, 3), str(rng.choice(["stream", "stream", "still"])), float(rng.integers(5, 20)), str(rng.choice(["", "", "dark"])), 0.9, 0.5))
            t += float(rng.choice([0.5, 0.5, 1.0, 70.0]))
    return [*rows, (999, 10_000, 5000.0, "stream", 1.0, "dark", 0.9, 0.5)]


def streamed(spark, tmp_path, rows, machine, out, key="session_id", kind=FRAME, name="machine"):
    """Two rounds of files, each in any order of events, whose event times overlap by less than the watermark's delay."""
    rows = sorted(rows, key=lambda r: r[2])
    rng = np.random.default_rng(1)
    for k, a in enumerate(range(0, len(rows), 40)):
        part = rows[a : a + 40]
        rng.shuffle(part := list(map(tuple, part)))
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 3).option("latestFirst", False).parquet(str(tmp_path / "in"))
        q = machines.run_stream(stream, key, ["ts", "event_id"], machine, out, watermark="10 minutes").writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    return spark.table(name).collect()


def told(rows, skip=999):
    return sorted((repr(tuple(r)) for r in rows if r[0] != skip))


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = sessions()
    got = streamed(spark, tmp_path, rows, machines.capture_machine(required=2, stream_ratio=0.5), machines.CAPTURE_OUT)
    want = machines.capture_batch(spark.createDataFrame(rows, FRAME), until=4400.0, required=2, stream_ratio=0.5).collect()
    assert told(got) == told(want)
    assert sum(r.code == "capture_timeout" and r.event_id is None for r in want) > 3


def test_stalled_cases_expire_in_the_stream(spark, tmp_path):
    kind = "case_id long, event_id long, ts double, action string"
    rows = [(1, 0, 0.5, "document"), (1, 1, 5.0, "selfie"), (2, 2, 1.0, "document"), (2, 3, 2.0, "selfie"), (2, 4, 3.0, "liveness"), (2, 5, 4.0, "finalize"), (3, 6, 6.0, "document"), (3, 7, 1900.0, "selfie"), (999, 8, 9000.0, "document")]
    got = streamed(spark, tmp_path, rows, machines.lifecycle_machine(), machines.CASE_OUT, "case_id", kind, "cases")
    want = machines.lifecycle_batch(spark.createDataFrame(rows, kind), until=8400.0).collect()
    assert told(got) == told(want)
    assert sorted((r.case_id, r.event_id is None, r.code) for r in got if r.code) == [(1, True, "case_expired"), (3, False, "case_expired"), (3, True, "case_expired")]
