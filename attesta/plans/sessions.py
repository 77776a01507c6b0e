"""Queries of the session operators, over users' events."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import sessions as S
from attesta.plans.tables import FRAMES, ORDER, frames
from attesta.streaming import machines

def ok():
    return F.col("event_type") != "error"



def _streaks(s, d, n=3):
    return S.ok_streak(frames(s, d), "user_id", ORDER, ok(), n)


def wn4(s, d):
    f = frames(s, d).withColumn("codes", F.array_compact(F.array(F.when(F.col("k") % 2 == 0, F.lit("dark")), F.when(F.col("k") % 3 == 0, F.lit("blurry")), F.when(F.col("event_type") == "error", F.lit("no_face")))))
    return S.steady_hints(f, "user_id", ORDER, "codes", ("no_face", "blurry", "dark")).select("event_id", "hint")


def ag28(s, d):
    return S.attempts(frames(s, d), "user_id", "event_type", ORDER, 10)


def jn10(s, d):
    f = frames(s, d)
    captures = f.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("created"))
    return S.with_valid_capture(f.select("user_id", "event_id", "ts"), captures, "user_id", "ts", "created", 3600).select("event_id")


#: Cases of the queries live ten days, as users' events are days apart.
CASE_S = 864_000
_ACTION = {"click": "document", "view": "selfie", "purchase": "liveness", "error": "finalize"}


def _actions(s, d):
    """Events as uploads of a case for each user."""
    action = F.element_at(F.create_map(*(F.lit(x) for kv in _ACTION.items() for x in kv)), F.col("event_type"))
    return frames(s, d).select(F.col("user_id").alias("case_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), "event_id", F.coalesce(action, F.lit("face_match")).alias("action"))


QUERIES = {
    "wn1_ok_streak": lambda s, d: _streaks(s, d).select("event_id", "streak", "qualified"),
    "wn2_running_max": lambda s, d: S.running_max(frames(s, d), "user_id", ORDER, "value").select("event_id", "reference"),
    "wn3_relative_blur": lambda s, d: S.relative_blur(S.running_max(frames(s, d), "user_id", ORDER, "value"), "value", "reference", 0.5).select("event_id", "blurred"),
    "wn4_steady_hints": wn4,
    "wn5_best_in_streak": lambda s, d: S.best_in_streak(_streaks(s, d), "user_id", "value", ORDER).select("user_id", "island", "event_id"),
    "wn6_streak_median": lambda s, d: S.streak_median(_streaks(s, d), "user_id", "value", 3).select("user_id", "island", F.round("median", 6).alias("median")),
    "wn7_every_nth": lambda s, d: S.every_nth(frames(s, d), "user_id", ORDER, 5, ok()).select("event_id", "frame_no"),
    "wn8_face_lost": lambda s, d: S.face_lost(frames(s, d), "user_id", ORDER, "ts", ok(), 3600.0).select("event_id", "lost"),
    "wn9_ctc_collapse": lambda s, d: S.ctc_collapse(frames(s, d).withColumn("sym", F.substring("event_type", 1, 1)), "user_id", ORDER, "sym", "value", "e").select("user_id", "text", F.round("confidence", 6).alias("confidence")),
    "wn12_latest_valid_steps": lambda s, d: S.latest_valid_steps(frames(s, d), "user_id", "event_type", ORDER, {"click": "view", "purchase": "error"}).select("user_id", "event_type", "event_id"),
    "wn13_task_durations": lambda s, d: S.task_durations(frames(s, d).where("event_type = 'purchase'"), "user_id", ORDER, "ts").select("event_id", F.round("took_s", 3).alias("took_s")),
    "ag26_session_summary": lambda s, d: S.session_summary(frames(s, d), "user_id", F.col("value"), F.col("k").cast("double"), F.col("event_type") == "purchase"),
    "ag27_baseline": lambda s, d: S.baseline(frames(s, d), "user_id", ORDER, "value", ok(), 5),
    "ag28_attempts": ag28,
    "jn10_valid_captures": jn10,
    "str1_capture_sessions": lambda s, d: machines.capture_batch(machines.capture_frames(frames(s, d)), required=3, budget=60, stream_ratio=0.2),
    "str2_liveness_sessions": lambda s, d: machines.liveness_batch(machines.liveness_frames(frames(s, d)), ["BLINK", "TURN_LEFT", "SMILE"], cfg=machines.LIVE | {"live": "block", "live_sharp": 20.0}),
    "str3_case_lifecycle": lambda s, d: machines.lifecycle_batch(_actions(s, d), limit=3, ttl=CASE_S),
    "str5_reap_idle": lambda s, d: S.reap_idle(frames(s, d), "user_id", "ts", 7200).select("user_id", "began", "closes", "events"),
    "str6_reap_expired": lambda s, d: S.reap_expired(frames(s, d), "user_id", "ts", 86_400).select("user_id", "dropped_at"),
}

_O = "PARTITION BY user_id ORDER BY ts, event_id"
_STREAK = f"{FRAMES}, i AS (SELECT *, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS ok, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER ({_O} ROWS UNBOUNDED PRECEDING) AS island FROM frames), st AS (SELECT *, sum(ok) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM i)"
_MAX = f"{FRAMES}, m AS (SELECT *, CASE WHEN row_number() OVER ({_O}) > 2 THEN max(value) OVER ({_O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS reference FROM frames)"

# The machines again, as recursive queries: one row of state for each event of a session, from the row before.
_CAPTURE = f"""WITH RECURSIVE {FRAMES},
    e AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS i FROM (SELECT user_id * 1000000 + floor(epoch(ts) / 432000)::BIGINT AS session_id, event_id, epoch_us(ts) / 3e9 AS ts,
        event_type = 'purchase' AS still, value AS sharp, CASE WHEN event_type = 'error' THEN 'face_blurry' ELSE '' END AS bad, k / 100 AS sim FROM frames)),
    r AS (SELECT session_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, 'SEARCHING' AS state, '' AS code, NULL::BIGINT AS captured, min(ts) AS began, 0 AS n, 0.0::DOUBLE AS top, []::DOUBLE[] AS streak, 0.0::DOUBLE AS ref, false AS lapsed FROM e GROUP BY 1
        UNION ALL
        SELECT session_id, i, event_id, CASE WHEN over THEN was WHEN n > 60 THEN 'FAILED' WHEN still THEN CASE WHEN was <> 'READY_FOR_STILL' THEN was WHEN code = '' THEN 'CAPTURED' ELSE 'SEARCHING' END WHEN was = 'SEARCHING' AND len(streak) >= 3 THEN 'READY_FOR_STILL' ELSE was END,
            CASE WHEN over THEN 'session_closed' ELSE code END, CASE WHEN NOT over AND still AND was = 'READY_FOR_STILL' AND code = '' THEN event_id END, began, n, top,
            CASE WHEN still AND was = 'READY_FOR_STILL' THEN []::DOUBLE[] ELSE streak END, CASE WHEN was = 'SEARCHING' AND len(streak) >= 3 THEN list_aggregate(streak, 'median') ELSE ref END, lapsed
        FROM (SELECT *, CASE WHEN over OR still OR was <> 'SEARCHING' OR n > 60 THEN old ELSE CASE WHEN code = '' THEN list_append(old, sharp) ELSE []::DOUBLE[] END END AS streak, CASE WHEN over OR still THEN old_top ELSE greatest(old_top, sharp) END AS top
            FROM (SELECT *, CASE WHEN n > 60 THEN 'too_many_frames' WHEN still AND was <> 'READY_FOR_STILL' THEN 'not_ready' WHEN bad <> '' THEN bad WHEN still AND sharp < 0.7 * ref THEN 'face_blurry' WHEN still AND sim < 0.4 THEN 'still_face_mismatch'
                    WHEN NOT still AND n > 2 AND sharp < 0.2 * old_top THEN 'face_blurry' ELSE '' END AS code
                FROM (SELECT e.session_id, e.i, e.event_id, e.still, e.sharp, e.bad, e.sim, r.began, r.ref, r.streak AS old, r.top AS old_top, r.n + CASE WHEN r.state IN ('CAPTURED', 'FAILED') OR e.ts >= r.began + 120 THEN 0 ELSE 1 END AS n,
                        r.state IN ('CAPTURED', 'FAILED') OR e.ts >= r.began + 120 AS over, r.lapsed OR (r.state NOT IN ('CAPTURED', 'FAILED') AND e.ts >= r.began + 120) AS lapsed,
                        CASE WHEN r.state NOT IN ('CAPTURED', 'FAILED') AND e.ts >= r.began + 120 THEN 'FAILED' ELSE r.state END AS was
                    FROM r JOIN e ON e.session_id = r.session_id AND e.i = r.i + 1))))
    SELECT session_id, event_id, state, code, captured FROM r WHERE i > 0
    UNION ALL SELECT session_id, NULL, 'FAILED', 'capture_timeout', NULL FROM (SELECT session_id, max_by(state, i) AS state, bool_or(lapsed) AS lapsed FROM r GROUP BY 1) WHERE lapsed OR state NOT IN ('CAPTURED', 'FAILED')"""
_CASES = f"""WITH RECURSIVE {FRAMES},
    e AS (SELECT user_id AS case_id, event_id, epoch_us(ts) / 1e6 AS ts, CASE event_type WHEN 'click' THEN 'document' WHEN 'view' THEN 'selfie' WHEN 'purchase' THEN 'liveness' WHEN 'error' THEN 'finalize' ELSE 'face_match' END AS action, row_number() OVER ({_O}) AS i FROM frames),
    r AS (SELECT case_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, '' AS action, '' AS code, min(ts) AS began, []::VARCHAR[] AS done, []::VARCHAR[] AS tries, false AS final FROM e GROUP BY 1
        UNION ALL
        SELECT case_id, i, event_id, action, code, began,
            CASE WHEN final OR code <> '' OR action = 'finalize' THEN done ELSE list_append(list_filter(done, lambda x: x <> action AND NOT (action = 'document' AND x = 'face_match') AND NOT (action = 'selfie' AND x IN ('face_match', 'liveness'))), action) END,
            CASE WHEN final OR action = 'finalize' OR code NOT IN ('', 'attempts_exhausted') THEN tries ELSE list_append(tries, action) END, final OR (code = '' AND action = 'finalize')
        FROM (SELECT *, CASE WHEN final THEN CASE WHEN action = 'finalize' THEN '' ELSE 'case_finalized' END WHEN ts >= began + {CASE_S} THEN 'case_expired' WHEN len(lack) > 0 THEN array_to_string([x || '_missing' FOR x IN lack], ',')
                    WHEN action <> 'finalize' AND len(list_filter(tries, lambda x: x = action)) >= 3 THEN 'attempts_exhausted' ELSE '' END AS code
            FROM (SELECT e.*, r.began, r.done, r.tries, r.final, list_filter(CASE e.action WHEN 'face_match' THEN ['document', 'selfie'] WHEN 'liveness' THEN ['selfie'] WHEN 'finalize' THEN ['document', 'selfie', 'liveness'] ELSE []::VARCHAR[] END, lambda x: NOT list_contains(r.done, x)) AS lack
                FROM r JOIN e ON e.case_id = r.case_id AND e.i = r.i + 1)))
    SELECT case_id, event_id, action, code FROM r WHERE i > 0 UNION ALL SELECT case_id, NULL, NULL, 'case_expired' FROM r GROUP BY 1 HAVING NOT bool_or(final)"""
_LIVE = f"""WITH RECURSIVE {FRAMES},
    e AS (SELECT user_id AS session_id, event_id, epoch_us(ts) / 1e11 AS ts, event_type <> 'error' AS one, (k % 70 - 35)::DOUBLE AS yaw, 0.1 + k % 30 / 100 AS eyes, 0.5 + value / 200 AS mouth, (100 + k)::DOUBLE AS height, value AS sharp, k / 100 AS live, row_number() OVER ({_O}) AS i FROM frames),
    r AS (SELECT session_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, 'BASELINE' AS state, '' AS code, 0::BIGINT AS task, NULL::VARCHAR AS decision, NULL::DOUBLE AS said, min(ts) AS began, min(ts) AS since, min(ts) AS face, 0::BIGINT AS n,
            []::DOUBLE[][] AS seen, []::DOUBLE[] AS base, []::DOUBLE[] AS scores, false AS flag, false AS lapsed FROM e GROUP BY 1
        UNION ALL
        SELECT session_id, i, event_id, new, CASE WHEN over OR new <> 'VERIFIED' THEN code4 WHEN live4 IS NULL THEN 'antispoof_not_checked' WHEN live4 < 0.2 THEN 'spoof_during_session' WHEN live4 < 0.4 THEN 'spoof_uncertain' ELSE '' END, task + passed::INT,
            CASE WHEN over THEN NULL WHEN new = 'FAILED' THEN 'fail' WHEN new = 'VERIFIED' THEN CASE WHEN live4 IS NULL THEN 'review' WHEN live4 < 0.2 THEN 'fail' WHEN live4 < 0.4 THEN 'review' ELSE 'pass' END END, CASE WHEN new = 'VERIFIED' AND NOT over THEN live4 END,
            began, CASE WHEN passed OR ready THEN ts ELSE since END, face2, n, seen2, CASE WHEN ready THEN [list_aggregate([x[1] FOR x IN seen2], 'median'), list_aggregate([x[2] FOR x IN seen2], 'median'), list_aggregate([x[3] FOR x IN seen2], 'median')] ELSE base END,
            scores2, CASE WHEN passed THEN false ELSE flag2 END, lapsed
        FROM (SELECT *, CASE WHEN over THEN was WHEN code4 NOT IN ('', 'no_face') THEN 'FAILED' WHEN ready THEN 'RUNNING' WHEN passed AND task = 2 THEN 'VERIFIED' ELSE was END AS new
            FROM (SELECT *, CASE WHEN code <> '' THEN code WHEN was = 'BASELINE' AND NOT ready AND ts - since > 20 THEN 'baseline_timeout' WHEN was = 'RUNNING' AND NOT passed AND ts - since > 20 THEN 'task_timeout' ELSE '' END AS code4, CASE WHEN len(scores2) > 0 THEN round(list_aggregate(scores2, 'median'), 4) END AS live4
                FROM (SELECT *, code = '' AND was = 'BASELINE' AND len(seen2) >= 3 AS ready
                    FROM (SELECT *, CASE WHEN code = '' AND was = 'BASELINE' AND frontal AND eyes >= 0.18 THEN list_append(seen, [eyes, mouth, height]) ELSE seen END AS seen2,
                            CASE WHEN code = '' AND frontal AND NOT (len(scores) > 0 AND n % 2 <> 0) AND sharp >= 20 THEN list_append(scores, live) ELSE scores END AS scores2, CASE WHEN code = '' THEN ts ELSE face END AS face2,
                            code = '' AND was = 'RUNNING' AND CASE task WHEN 0 THEN flag AND eyes >= 0.8 * base[1] WHEN 1 THEN (flag OR frontal) AND yaw >= 25 ELSE frontal AND mouth >= 1.15 * base[2] END AS passed,
                            flag OR (code = '' AND was = 'RUNNING' AND CASE task WHEN 0 THEN eyes < 0.6 * base[1] WHEN 1 THEN frontal ELSE false END) AS flag2
                        FROM (SELECT *, CASE WHEN over THEN 'session_closed' WHEN n > 400 THEN 'too_many_frames' WHEN NOT one AND ts - face > 2 THEN 'face_lost' WHEN NOT one THEN 'no_face' ELSE '' END AS code, abs(yaw) <= 15 AS frontal
                            FROM (SELECT e.*, r.task, r.began, r.since, r.face, r.seen, r.base, r.scores, r.flag, r.n + CASE WHEN r.state NOT IN ('BASELINE', 'RUNNING') OR e.ts >= r.began + 120 THEN 0 ELSE 1 END AS n, r.state NOT IN ('BASELINE', 'RUNNING') OR e.ts >= r.began + 120 AS over,
                                    r.lapsed OR (r.state IN ('BASELINE', 'RUNNING') AND e.ts >= r.began + 120) AS lapsed, CASE WHEN r.state IN ('BASELINE', 'RUNNING') AND e.ts >= r.began + 120 THEN 'EXPIRED' ELSE r.state END AS was
                                FROM r JOIN e ON e.session_id = r.session_id AND e.i = r.i + 1))))))
    )
    SELECT session_id, event_id, state, code, task, decision, said AS live FROM r WHERE i > 0
    UNION ALL SELECT session_id, NULL, 'EXPIRED', 'session_expired', task, 'fail', NULL FROM (SELECT session_id, max_by(state, i) AS state, max(task) AS task, bool_or(lapsed) AS lapsed FROM r GROUP BY 1) WHERE lapsed OR state IN ('BASELINE', 'RUNNING')"""

SQL = {
    "str1_capture_sessions": _CAPTURE,
    "str2_liveness_sessions": _LIVE,
    "str3_case_lifecycle": _CASES,
    "wn1_ok_streak": f"WITH {_STREAK} SELECT event_id, CAST(streak AS BIGINT) AS streak, streak >= 3 AS qualified FROM st",
    "wn2_running_max": f"WITH {_MAX} SELECT event_id, reference FROM m",
    "wn3_relative_blur": f"WITH {_MAX} SELECT event_id, coalesce(value / reference < 0.5, false) AS blurred FROM m",
    "wn4_steady_hints": f"""WITH {FRAMES}, c AS (SELECT event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS a, sum(CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END) OVER w AS b, sum(CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END) OVER w AS c FROM frames WINDOW w AS ({_O} ROWS 2 PRECEDING))
        SELECT event_id, CASE WHEN a >= 2 THEN 'no_face' WHEN b >= 2 THEN 'blurry' WHEN c >= 2 THEN 'dark' END AS hint FROM c""",
    "wn5_best_in_streak": f"WITH {_STREAK} SELECT user_id, CAST(island AS BIGINT) AS island, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY value DESC, ts, event_id) AS rn FROM st WHERE streak > 0) WHERE rn = 1",
    "wn6_streak_median": f"WITH {_STREAK} SELECT user_id, CAST(island AS BIGINT) AS island, round(quantile_cont(value, 0.5), 6) AS median FROM st WHERE streak > 0 GROUP BY 1, 2 HAVING count(*) >= 3",
    "wn7_every_nth": f"WITH {FRAMES}, n AS (SELECT *, row_number() OVER ({_O}) AS frame_no FROM frames), f AS (SELECT *, min(CASE WHEN event_type <> 'error' THEN frame_no END) OVER (PARTITION BY user_id) AS first FROM n) SELECT event_id, CAST(frame_no AS INT) AS frame_no FROM f WHERE event_type <> 'error' AND (frame_no % 5 = 0 OR frame_no = first)",
    "wn8_face_lost": f"WITH {FRAMES}, l AS (SELECT *, coalesce(last_value(CASE WHEN event_type <> 'error' THEN ts END IGNORE NULLS) OVER ({_O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_value(ts) OVER ({_O} ROWS UNBOUNDED PRECEDING)) AS seen FROM frames) SELECT event_id, event_type = 'error' AND date_diff('microsecond', seen, ts) > 3600000000 AS lost FROM l",
    "wn9_ctc_collapse": f"WITH {FRAMES}, l AS (SELECT *, substr(event_type, 1, 1) AS sym, lag(substr(event_type, 1, 1)) OVER ({_O}) AS before FROM frames) SELECT user_id, string_agg(sym, '' ORDER BY ts, event_id) AS text, round(avg(value), 6) AS confidence FROM l WHERE sym <> 'e' AND sym IS DISTINCT FROM before GROUP BY 1",
    "wn12_latest_valid_steps": f"""WITH {FRAMES}, n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM frames) WHERE rn = 1)
        SELECT user_id, event_type, event_id FROM n WHERE NOT EXISTS (SELECT 1 FROM n o WHERE o.user_id = n.user_id AND ((n.event_type = 'click' AND o.event_type = 'view') OR (n.event_type = 'purchase' AND o.event_type = 'error')) AND (o.ts > n.ts OR (o.ts = n.ts AND o.event_id > n.event_id)))""",
    "wn13_task_durations": "SELECT event_id, round(date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) / 1000000.0, 3) AS took_s FROM events WHERE event_type = 'purchase'",
    "ag26_session_summary": f"WITH {FRAMES} SELECT user_id, min(value) AS identity_min, quantile_cont(CAST(k AS DOUBLE), 0.5) AS live_median, min(CAST(k AS DOUBLE)) AS live_min, count(*) AS checks, count(*) FILTER (event_type = 'purchase') AS tasks_done FROM frames GROUP BY 1",
    "ag27_baseline": f"WITH {FRAMES}, q AS (SELECT *, row_number() OVER ({_O}) AS rn FROM frames WHERE event_type <> 'error'), b AS (SELECT user_id, CASE WHEN count(*) = 5 THEN quantile_cont(value, 0.5) END AS baseline FROM q WHERE rn <= 5 GROUP BY 1) SELECT u.user_id, baseline FROM (SELECT DISTINCT user_id FROM frames) u LEFT JOIN b ON u.user_id = b.user_id",
    "ag28_attempts": "WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS attempt FROM events) SELECT user_id, event_type, CAST(max(attempt) AS INT) AS attempts, min(CASE WHEN attempt > 10 THEN event_id END) AS first_refused FROM n GROUP BY 1, 2",
    "jn10_valid_captures": "WITH c AS (SELECT DISTINCT user_id, ts AS created FROM events WHERE event_type = 'purchase') SELECT event_id FROM events e ASOF JOIN c ON e.user_id = c.user_id AND e.ts >= c.created WHERE date_diff('microsecond', created, ts) <= 18000000000",
    "str5_reap_idle": "WITH g AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) < 7200000000 THEN 0 ELSE 1 END AS fresh FROM events), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS began, max(ts) + INTERVAL 7200 SECONDS AS closes, count(*) AS events FROM n GROUP BY user_id, s",
    "str6_reap_expired": "SELECT user_id, min(ts) + INTERVAL 2 DAYS AS dropped_at FROM events GROUP BY 1",
}
