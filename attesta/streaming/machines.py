"""Session state machines: capture, liveness and case lifecycle, one small step for each event and one for a deadline.

A machine is a function (state, event) -> (state, output or None) over plain
dicts, and what its deadline is and says. ``play`` runs a session's events in
order and lets the deadline go off between them. The batch twin plays each
session whole; the stream holds events until the watermark has passed them, so
that their order doesn't depend on micro-batches, and sets event-time timers, so
that a session that just stops ends too. Sessions are dealt out by key; one
session's events are few by its frame budget.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

State = dict
#: Outputs that a batch task hands on at a time.
TOLD = 5000


def capture_step(s: State, e: dict, required: int = 2, budget: int = 100, ratio: float = 0.7, similar: float = 0.4, ttl: float = 120.0, stream_ratio: float | None = None, still: bool = True) -> tuple[State, dict | None]:
    """SEARCHING -> READY_FOR_STILL -> CAPTURED; a bad still leads back; budget and time end it.

    stream_ratio: a stream frame after the second that is less sharp than this share of the sharpest so far is blurry.
    still False: no still is asked for, the streak's frame with the best ``score`` is captured (the first of equal ones).
    """
    s = s or {"state": "SEARCHING", "frames": 0, "began": e["ts"], "streak": [], "sharpest": 0.0, "best": None}
    say = lambda code, captured=None: (s, {"state": s["state"], "code": code, "captured": captured})
    if s["state"] in ("CAPTURED", "FAILED"):
        return say("session_closed")
    if e["ts"] >= s["began"] + ttl:
        s["state"] = "FAILED"
        return say("capture_timeout")
    s["frames"] += 1
    if s["frames"] > budget:
        s["state"] = "FAILED"
        return say("too_many_frames")
    code = e["code"]
    if e["kind"] == "still":
        if s["state"] != "READY_FOR_STILL":
            return say("not_ready")
        if not code and e["sharpness"] < ratio * s["reference"]:
            code = "face_blurry"
        if not code and e["similarity"] < similar:
            code = "still_face_mismatch"
        s["streak"], s["best"] = [], None
        s["state"] = "SEARCHING" if code else "CAPTURED"
        return say(code or "", None if code else e.get("event_id"))
    if stream_ratio is not None and not code and s["frames"] > 2 and e["sharpness"] < stream_ratio * s["sharpest"]:
        code = "face_blurry"
    s["sharpest"] = max(s["sharpest"], e["sharpness"])
    if s["state"] == "SEARCHING":
        if code:
            s["streak"], s["best"] = [], None
        else:
            s["streak"] = [*s["streak"], e["sharpness"]]
            if not still and (s["best"] is None or e["score"] > s["best"][0]):
                s["best"] = [e["score"], e["event_id"]]
        if len(s["streak"]) >= required:
            if not still:
                s["state"] = "CAPTURED"
                return say("", s["best"][1])
            s["state"], s["reference"] = "READY_FOR_STILL", median(s["streak"])
    return say(code or "")


def hint_step(s: State, e: dict, priority: tuple[str, ...], window: int = 3, least: int = 2) -> tuple[State, dict | None]:
    """STR7: the hint shown stays while it is steady, or nothing else is, and goes after a window of clean frames.

    It is silent where no frame of the window has its code.
    """
    s = s or {"recent": [], "shown": None}
    s["recent"] = [*s["recent"], [] if e["codes"] is None else list(e["codes"])][-window:]
    seen = [c for codes in s["recent"] for c in codes]
    rank = {c: i for i, c in enumerate(priority)}
    steady = sorted((c for c in dict.fromkeys(seen) if seen.count(c) >= least), key=lambda c: rank.get(c, len(rank)))
    if not seen:
        s["shown"] = None
    elif steady and s["shown"] not in steady:
        s["shown"] = steady[0]
    return s, {"hint": s["shown"] if s["shown"] in seen else None}


#: live: whether frames are checked for spoofing: off, info (told, not judged) or block.
LIVE = {"live": "off", "live_every": 2, "live_sharp": 4.0, "spoof": 0.2, "genuine": 0.4, "frontal": 15.0, "closed": 0.6, "open": 0.8, "turn": 25.0, "smile": 1.15, "closer": 1.3, "samples": 3, "limit_s": 20.0, "lost_s": 2.0, "same": 0.3, "open_eyes": 0.18, "frames": 400, "identity_every": 2}


def liveness_step(s: State, e: dict, tasks: list[str], cfg: dict = LIVE, ttl: float = 120.0) -> tuple[State, dict | None]:
    """BASELINE -> RUNNING -> VERIFIED, FAILED or EXPIRED; frames past the budget end it.

    The face is compared on the first frontal frame, then on those whose number divides by ``identity_every``. Unless ``live``
    is off, frontal frames that are sharp enough are scored for spoofing, the first and then every ``live_every``-th; a
    verified session is judged by their median under block, and only told it under info.
    """
    s = s or {"live": [], "state": "BASELINE", "at": 0, "since": e["ts"], "began": e["ts"], "face": e["ts"], "seen": [], "flag": False, "frames": 0, "known": False}
    if s["state"] in ("VERIFIED", "FAILED", "EXPIRED"):
        return s, {"state": s["state"], "code": "session_closed", "task": s["at"]}

    def end(state: str, code: str) -> tuple[State, dict]:
        s["state"] = state
        return s, {"state": state, "code": code, "task": s["at"], "decision": "fail"}

    if e["ts"] - s["began"] >= ttl:
        return end("EXPIRED", "session_expired")
    s["frames"] += 1
    if s["frames"] > cfg["frames"]:
        return end("FAILED", "too_many_frames")
    if e["faces"] != 1:
        if e["ts"] - s["face"] > cfg["lost_s"]:
            return end("FAILED", "multiple_faces" if e["faces"] else "face_lost")
        return s, {"state": s["state"], "code": "no_face", "task": s["at"]}
    s["face"] = e["ts"]
    frontal = abs(e["yaw"]) <= cfg["frontal"]
    if frontal and not (s["known"] and s["frames"] % cfg["identity_every"]):
        s["known"] = True
        if e["similarity"] < cfg["same"]:
            return end("FAILED", "face_changed")
    if frontal and cfg["live"] != "off" and not (s["live"] and s["frames"] % cfg["live_every"]) and e["sharpness"] >= cfg["live_sharp"]:
        s["live"] = [*s["live"], e["live"]]
    if s["state"] == "BASELINE":
        if frontal and e["eyes"] >= cfg["open_eyes"]:
            s["seen"].append([e["eyes"], e["mouth"], e["height"]])
        if len(s["seen"]) >= cfg["samples"]:
            s["base"] = [median(x) for x in zip(*s["seen"], strict=True)]
            s["state"], s["since"], s["seen"] = "RUNNING", e["ts"], []
        elif e["ts"] - s["since"] > cfg["limit_s"]:
            return end("FAILED", "baseline_timeout")
        return s, {"state": s["state"], "code": "", "task": s["at"]}
    eyes, mouth, height = s["base"]
    task = tasks[s["at"]]
    if task == "BLINK":  # closed first, then open
        done = s["flag"] and e["eyes"] >= cfg["open"] * eyes
        s["flag"] = s["flag"] or e["eyes"] < cfg["closed"] * eyes
    elif task in ("TURN_LEFT", "TURN_RIGHT"):  # from the front
        s["flag"] = s["flag"] or frontal
        done = s["flag"] and (e["yaw"] if task == "TURN_LEFT" else -e["yaw"]) >= cfg["turn"]
    elif task == "SMILE":
        done = frontal and e["mouth"] >= cfg["smile"] * mouth
    elif task == "MOVE_CLOSER":
        done = e["height"] >= cfg["closer"] * height
    else:
        raise ValueError(f"unknown liveness task {task}")
    if done:
        s["at"], s["since"], s["flag"] = s["at"] + 1, e["ts"], False
        if s["at"] == len(tasks):
            s["state"] = "VERIFIED"
            return s, {"state": "VERIFIED", "task": s["at"]} | _live_verdict(s["live"], cfg)
    elif e["ts"] - s["since"] > cfg["limit_s"]:
        return end("FAILED", "task_timeout")
    return s, {"state": s["state"], "code": "", "task": s["at"]}


def _live_verdict(scores: list[float], cfg: dict) -> dict:
    """What a verified session is told about its frames' spoof scores."""
    live = round(median(scores), 4) if scores else None
    if cfg["live"] == "block":
        if live is None:
            return {"decision": "review", "code": "antispoof_not_checked", "live": None}
        if live < cfg["spoof"]:
            return {"decision": "fail", "code": "spoof_during_session", "live": live}
        if live < cfg["genuine"]:
            return {"decision": "review", "code": "spoof_uncertain", "live": live}
    elif cfg["live"] == "info" and live is not None:
        return {"decision": "pass", "code": "antispoof_video_score", "live": live}
    return {"decision": "pass", "code": "", "live": live}


NEEDS = {"face_match": ("document", "selfie"), "liveness": ("selfie",), "finalize": ("document", "selfie", "liveness")}


def lifecycle_step(s: State, e: dict, limit: int = 3, ttl: float = 1800.0) -> tuple[State, dict | None]:
    """Uploads in order, each at most ``limit`` times; finalising freezes the case and may be repeated; time ends an open case."""
    s = s or {"done": [], "tries": {}, "final": False, "began": e.get("ts", 0.0)}
    a = e["action"]
    if s["final"]:
        return s, {"action": a, "code": "" if a == "finalize" else "case_finalized"}
    if e.get("ts", 0.0) >= s["began"] + ttl:
        return s, {"action": a, "code": "case_expired"}
    lack = [x for x in NEEDS.get(a, ()) if x not in s["done"]]
    if lack:
        return s, {"action": a, "code": ",".join(f"{x}_missing" for x in lack)}
    if a == "finalize":
        s["final"] = True
        return s, {"action": a, "code": ""}
    s["tries"][a] = s["tries"].get(a, 0) + 1
    if s["tries"][a] > limit:
        return s, {"action": a, "code": "attempts_exhausted"}
    lost = {"document": ("face_match",), "selfie": ("face_match", "liveness")}.get(a, ())
    s["done"] = [x for x in s["done"] if x not in lost and x != a] + [a]
    return s, {"action": a, "code": ""}


@dataclass(frozen=True)
class Machine:
    """``step`` for an event; ``due``: when an untouched session ends, in seconds of event time, or None; ``lapse``: what it says then."""

    step: Callable[[State, dict], tuple[State, dict | None]]
    due: Callable[[State], float | None] = lambda s: None
    lapse: Callable[[State], tuple[State, dict]] = lambda s: (s, {})


def _lapsed(s: State, state: str, **said) -> tuple[State, dict]:
    s["state"] = state
    return s, {"state": state} | said


def capture_machine(**cfg) -> Machine:
    ttl = cfg.get("ttl", 120.0)
    return Machine(lambda s, e: capture_step(s, e, **cfg), lambda s: None if s["state"] in ("CAPTURED", "FAILED") else s["began"] + ttl, lambda s: _lapsed(s, "FAILED", code="capture_timeout"))


def liveness_machine(tasks: list[str], **cfg) -> Machine:
    ttl = cfg.get("ttl", 120.0)
    return Machine(lambda s, e: liveness_step(s, e, tasks, **cfg), lambda s: None if s["state"] in ("VERIFIED", "FAILED", "EXPIRED") else s["began"] + ttl, lambda s: _lapsed(s, "EXPIRED", code="session_expired", task=s["at"], decision="fail"))


def lifecycle_machine(limit: int = 3, ttl: float = 1800.0) -> Machine:
    def lapse(s: State) -> tuple[State, dict]:
        s["lapsed"] = True
        return s, {"code": "case_expired"}

    return Machine(lambda s, e: lifecycle_step(s, e, limit, ttl), lambda s: None if s["final"] or s.get("lapsed") else s["began"] + ttl, lapse)


def play(state: State | None, events: list[dict], machine: Machine, until: float | None) -> Iterator[tuple[State, dict, dict]]:
    """States, events and outputs in order; a deadline that has come before an event, or by ``until``, is an event without an id."""
    for e in [*events, None]:
        due = machine.due(state) if state else None
        if due is not None and (due <= e["ts"] if e else until is None or due <= until):
            state, said = machine.lapse(state)
            yield state, {}, said
        if e:
            state, said = machine.step(state, e)
            yield state, e, said


def _columns(out: str) -> list[str]:
    return [f.split(" ")[0].strip() for f in out.split(", ")]


def _plain(value):
    """As JSON can hold it; missing values are None."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    return None if value != value else value


def _frame(rows: list[list], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names, dtype=object)


def run_batch(events: DataFrame, key: str, order: list[str], machine: Machine, out: str, until: float | None = None) -> DataFrame:
    """All sessions' outputs, one for each event and one for a deadline; ``out``: schema of key, order and output columns.

    until: deadlines up to this time go off after the last event; None: all.
    """
    names = _columns(out)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows, made = None, [], []

        def played() -> list[list]:
            return [[held if n == key else e.get(n) if n in order else said.get(n) for n in names] for _, e, said in play(None, rows, machine, until)]

        for pdf in parts:
            for e in pdf.to_dict("records"):
                if rows and e[key] != held:
                    made += played()
                    rows = []
                    if len(made) >= TOLD:  # a frame for each session would cost more than to play it
                        yield _frame(made, names)
                        made = []
                held = e[key]
                rows.append(e)
        if rows:
            made += played()
        if made:
            yield _frame(made, names)

    return events.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, out)


def run_stream(events: DataFrame, key: str, order: list[str], machine: Machine, out: str, watermark: str = "2 minutes", keep_s: float = 240.0) -> DataFrame:
    """The same steps over a stream, with the state store's timers.

    ``ts`` is event time in seconds, above zero, where watermarks begin. Events wait in the session's state until the watermark has passed them; then they are
    played in order, and the deadline goes off when the watermark reaches it. Rows behind the watermark are dropped by the
    engine. The state goes ``keep_s`` after the last event or deadline; until then
    a closed session answers as closed. Needs the RocksDB state store.
    """
    from pyspark.sql.streaming import StatefulProcessor

    names, fields, column = _columns(out), [f for f in events.columns if f != key], key

    class Sessions(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("state", "said string")
            self.waiting = handle.getListState("waiting", "event string")

        def handleInputRows(self, key, rows, timerValues):
            new = [(json.dumps({f: _plain(e[f]) for f in fields}),) for pdf in rows for e in pdf.to_dict("records")]
            self.waiting.appendList(new)
            yield from self.go_on(key[0], timerValues.getCurrentWatermarkInMs())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            yield from self.go_on(key[0], timerValues.getCurrentWatermarkInMs())

        def go_on(self, own, now_ms: int):
            held = json.loads(self.state.get()[0]) if self.state.exists() else {"state": None, "last": None}
            waiting = [json.loads(w[0]) for w in self.waiting.get()] if self.waiting.exists() else []
            ready = sorted((e for e in waiting if 1000 * e["ts"] <= now_ms), key=lambda e: [e[c] for c in order])
            later = [e for e in waiting if 1000 * e["ts"] > now_ms]
            made = []
            for state, e, said in play(held["state"], ready, machine, now_ms / 1000):
                made.append([own if n == column else e.get(n) if n in order else said.get(n) for n in names])
                held = {"state": state, "last": e.get("ts", now_ms / 1000)}
            if ready:
                self.waiting.clear()
                if later:
                    self.waiting.put([(json.dumps(e),) for e in later])
            due = machine.due(held["state"]) if held["state"] else None
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            if held["state"] and due is None and not later and now_ms >= 1000 * (held["last"] + keep_s):
                self.state.clear()
            else:
                if held["state"]:
                    self.state.update((json.dumps(held),))
                next_s = [e["ts"] for e in later] + ([due] if due is not None else []) + ([held["last"] + keep_s] if held["state"] and due is None else [])
                self.handle.registerTimer(max(int(1000 * min(next_s)) + 1, now_ms + 1))
            if made:
                yield _frame(made, names)

        def close(self) -> None:
            pass

    timed = events.withColumn("_at", F.timestamp_millis(F.ceil(F.col("ts") * 1000).cast("long")))
    return timed.withWatermark("_at", watermark).groupBy(key).transformWithStateInPandas(Sessions(), out, "Append", "EventTime")


CAPTURE_OUT = "session_id long, event_id long, state string, code string, captured long"
LIVE_OUT = "session_id long, event_id long, state string, code string, task long, decision string, live double"
HINT_OUT = "session_id long, event_id long, hint string"
CASE_OUT = "case_id long, event_id long, action string, code string"


def capture_frames(frames: DataFrame) -> DataFrame:
    """Events as capture frames: a session for each user and five days, whose seconds stand for more than an hour each."""
    part = F.floor(F.unix_timestamp("ts") / 432_000)
    code = F.when(F.col("event_type") == "error", "face_blurry").otherwise("")
    return frames.select((F.col("user_id") * 1_000_000 + part).alias("session_id"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 3e9).alias("ts"), F.when(F.col("event_type") == "purchase", "still").otherwise("stream").alias("kind"), F.col("value").alias("sharpness"), code.alias("code"), (F.col("k") / 100).alias("similarity"))


def capture_batch(frames: DataFrame, until: float | None = None, **cfg) -> DataFrame:
    return run_batch(frames, "session_id", ["ts", "event_id"], capture_machine(**cfg), CAPTURE_OUT, until)


def hint_batch(frames: DataFrame, priority: tuple[str, ...], **cfg) -> DataFrame:
    return run_batch(frames, "session_id", ["ts", "event_id"], Machine(lambda s, e: hint_step(s, e, priority, **cfg)), HINT_OUT)


def liveness_frames(frames: DataFrame) -> DataFrame:
    k = F.col("k")
    return frames.select(
        F.col("user_id").alias("session_id"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e11).alias("ts"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("faces"), (k % 70 - 35).cast("double").alias("yaw"), (0.1 + k % 30 / 100).alias("eyes"),
        (0.5 + F.col("value") / 200).alias("mouth"), (100 + k).cast("double").alias("height"), F.lit(0.5).alias("similarity"),
        F.col("value").alias("sharpness"), (k / 100).alias("live"),
    )


def liveness_batch(frames: DataFrame, tasks: list[str], until: float | None = None, **cfg) -> DataFrame:
    return run_batch(frames, "session_id", ["ts", "event_id"], liveness_machine(tasks, **cfg), LIVE_OUT, until)


def lifecycle_batch(events: DataFrame, limit: int = 3, ttl: float = 1800.0, until: float | None = None) -> DataFrame:
    return run_batch(events, "case_id", ["ts", "event_id"], lifecycle_machine(limit, ttl), CASE_OUT, until)
