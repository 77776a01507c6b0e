"""Queries of the decision operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import dates
from attesta.operators import curation, decisions, evaluation
from attesta.plans.tables import FRAMES, RESULTS, frames, reasons, results, table

REQUIRED = ("document", "selfie", "antispoof", "face_match", "liveness")
REJECT = ("spoof_detected", "faces_do_not_match")
LIMITS = {"dark": 40, "bright": 220, "sharp": 5.0, "glare": 0.5}


def _cases(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("case_id"), "c_mktsegment", "c_nationkey")


def _verdicts(s, d):
    r = results(s, d)
    return decisions.case_verdict(_cases(s, d), r, reasons(r), REQUIRED, REJECT)


def prj3(s, d):
    f = frames(s, d).select("event_id", F.col("event_type").alias("code"), F.lit("error").alias("severity"))
    groups = {"touch": ("click", "view"), "money": ("purchase",), "trouble": ("error",)}
    return decisions.apply_modes(f, decisions.resolve_modes({"touch": "info"}, {"trouble": "off"}, groups=groups), groups)


def prj4(s, d):
    f = frames(s, d)
    v, k = F.col("value"), F.col("k").cast("double")
    m = {
        "faces": F.when(F.col("event_type") == "error", 0).otherwise(1), "others": F.col("k") % 7 - 5, "brightness": k * 2.5, "height_ratio": k / 100, "yaw": v - 20, "pitch": k - 50, "cut_off": F.col("k") % 13 == 0,
        "offset": k / 300, "context": v / 10, "sharpness": v, "asymmetry": k / 200, "roll": v - k, "eyes": k / 200, "mouth": v / 100, "gaze": k / 100 - 0.5, "clear": F.when(F.col("k") % 3 == 0, v / 10), "edges": v / 50,
    }
    cfg = {"dark": 40, "bright": 220, "small": 0.1, "large": 0.9, "offset": 0.25, "context": 0.5, "sharp": 8, "asymmetry": 0.4, "yaw": 25, "pitch": 30, "roll": 30, "eyes": 0.1, "mouth": 0.4, "gaze": 0.3, "clear": 0.5, "edges": 0.6}
    return f.select("event_id", F.array_join(decisions.frame_findings(m, cfg), ",").alias("codes"))


PRJ4_SQL = f"""WITH {FRAMES}, m AS (SELECT event_id, event_type = 'error' AS none, k, value AS v, k * 2.5 < 40 AS dark, k * 2.5 > 220 AS bright, k % 13 = 0 AS cut, abs(value - 20) > 25 OR abs(k - 50.0) > 30 AS turned, k / 200.0 < 0.1 AS closed FROM frames)
    SELECT event_id, CASE WHEN none THEN 'no_face' ELSE concat_ws(',', CASE WHEN k % 7 - 5 > 0 THEN 'multiple_faces' END, CASE WHEN k / 100.0 < 0.1 THEN 'face_too_small' END, CASE WHEN k / 100.0 > 0.9 THEN 'face_too_large' END,
        CASE WHEN cut THEN 'face_cut_off' END, CASE WHEN NOT cut AND k / 300.0 > 0.25 THEN 'face_off_center' END, CASE WHEN NOT cut AND v / 10 < 0.5 THEN 'face_too_close_for_context' END, CASE WHEN dark THEN 'face_too_dark' END,
        CASE WHEN NOT dark AND bright THEN 'face_too_bright' END, CASE WHEN NOT dark AND NOT bright AND v < 8 THEN 'face_blurry' END, CASE WHEN k / 200.0 > 0.4 THEN 'uneven_lighting' END, CASE WHEN turned THEN 'head_turned' END,
        CASE WHEN abs(v - k) > 30 THEN 'head_tilted' END, CASE WHEN closed THEN 'eyes_closed' END, CASE WHEN v / 100 > 0.4 THEN 'mouth_open' END, CASE WHEN NOT closed AND NOT turned AND abs(CAST(k AS DOUBLE) / 100 - 0.5) > 0.3 THEN 'gaze_off_center' END,
        CASE WHEN k % 3 = 0 AND v / 10 < 0.5 THEN 'face_occluded' END, CASE WHEN v / 50 > 0.6 THEN 'background_not_uniform' END) END AS codes FROM m"""


def prj5(s, d):
    docs = table(s, d, "documents").select("doc_id", (F.col("n_chars") % 97).cast("double").alias("sharpness"), (F.col("n_chars") % 256).alias("brightness"), ((F.col("n_chars") % 10) / 10.0).alias("glare"))
    return decisions.quality_gate(docs, LIMITS).select("doc_id", "fatal", "warning")


def prj6(s, d):
    r = results(s, d)
    return decisions.band(r.drop("decision"), "score", 0.45, 0.25, F.col("result_id") % 5 == 0).select("result_id", "decision", "band_score")


def prj7(s, d):
    f = frames(s, d).withColumn("sharp", F.when(F.col("k") % 10 > 0, F.col("value"))).withColumn("decision", F.lit("pass"))
    return decisions.retake_guard(f, "sharp", 5.0).select("event_id", "decision")


def prj12(s, d):
    spec = s.createDataFrame([("en", 300), ("fr", 200)], "field string, exact_len int")
    docs = table(s, d, "documents").select("doc_id", F.col("lang").alias("field"), F.col("text").alias("value"), ((F.col("n_chars") % 100) / 100.0).alias("confidence"))
    return decisions.field_findings(docs, spec, 0.3).select("doc_id", F.array_join("findings", ",").alias("codes"))


def _wide(s, d):
    """Identity fields of customers, made from their keys; a fifth has a valid check digit."""
    c = table(s, d, "customer")
    k = F.col("c_custkey")
    nine = F.lpad(((k * 7919 + 12345) % 1000000000).cast("string"), 9, "0")
    total = sum(F.substring(nine, i + 1, 1).cast("int") * (10 - i) for i in range(9))
    check = F.when(total % 11 < 2, total % 11).otherwise(11 - total % 11)
    nid = F.concat(nine, F.when(k % 5 == 0, check).otherwise(k % 10).cast("string"))
    date = lambda y, m, dd: F.concat_ws("/", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(dd.cast("string"), 2, "0"))
    return c.select(
        "c_custkey", F.when(k % 17 > 0, nid).alias("national_id"), F.when(k % 19 > 0, date(k % 140 + 1270, k % 13, k % 32)).alias("birth_date"), F.when(k % 7 > 0, date(k % 30 + 1395, k % 12 + 1, k % 31 + 1)).alias("expiry_date"),
        F.when(k % 23 > 0, F.col("c_name")).alias("first_name"), F.when(k % 29 > 0, F.col("c_mktsegment")).otherwise("x").alias("last_name"), F.when(k % 31 > 0, F.col("c_name")).otherwise("").alias("father_name"),
    )


def today():
    return F.lit("2026-01-01").cast("date")


_D = "lpad(CAST({} AS VARCHAR), 4, '0') || '/' || lpad(CAST({} AS VARCHAR), 2, '0') || '/' || lpad(CAST({} AS VARCHAR), 2, '0')"


def _parse(c):
    y, m, dd = (f"TRY_CAST(split_part({c}, '/', {i}) AS INT)" for i in (1, 2, 3))
    return y, m, dd


def _jalali(y, m, dd):
    return f"(365 * ({y} + 1595) + (({y} + 1595) // 33) * 8 + ((({y} + 1595) % 33) + 3) // 4 + {dd} + CASE WHEN {m} < 7 THEN ({m} - 1) * 31 ELSE ({m} - 7) * 30 + 186 END - 355668 - 719528)"


def _date_sql(c):
    y, m, dd = _parse(c)
    leap = f"({_jalali(y + ' + 1', '1', '1')} - {_jalali(y, '1', '1')} = 366)".replace(f"({y} + 1 + 1595)", f"({y} + 1596)")
    days = f"CASE WHEN {m} <= 6 THEN 31 WHEN {m} <= 11 THEN 30 WHEN {leap} THEN 30 ELSE 29 END"
    return f"CASE WHEN {y} BETWEEN 1250 AND 1500 AND {m} BETWEEN 1 AND 12 AND {dd} BETWEEN 1 AND {days} THEN DATE '1970-01-01' + CAST({_jalali(y, m, dd)} AS INT) END"


_N = "lpad(CAST((c_custkey * 7919 + 12345) % 1000000000 AS VARCHAR), 9, '0')"
_T = "(" + " + ".join(f"CAST(substr(nine, {i + 1}, 1) AS INT) * {10 - i}" for i in range(9)) + ")"
WIDE = f"""n AS (SELECT *, {_N} AS nine FROM customer), t AS (SELECT *, {_T} % 11 AS r FROM n), t2 AS (SELECT *, CASE WHEN r < 2 THEN r ELSE 11 - r END AS chk FROM t),
    w AS (SELECT c_custkey, r, chk, CASE WHEN c_custkey % 17 > 0 THEN nine || CAST(CASE WHEN c_custkey % 5 = 0 THEN chk ELSE c_custkey % 10 END AS VARCHAR) END AS national_id,
        CASE WHEN c_custkey % 19 > 0 THEN {_D.format("c_custkey % 140 + 1270", "c_custkey % 13", "c_custkey % 32")} END AS birth_date,
        CASE WHEN c_custkey % 7 > 0 THEN {_D.format("c_custkey % 30 + 1395", "c_custkey % 12 + 1", "c_custkey % 31 + 1")} END AS expiry_date,
        CASE WHEN c_custkey % 23 > 0 THEN c_name END AS first_name, CASE WHEN c_custkey % 29 > 0 THEN c_mktsegment ELSE 'x' END AS last_name, CASE WHEN c_custkey % 31 > 0 THEN c_name ELSE '' END AS father_name FROM t2),
    v AS (SELECT *, {_date_sql("birth_date")} AS born, {_date_sql("expiry_date")} AS ends,
        national_id IS NOT NULL AND CAST(substr(national_id, 10, 1) AS INT) = chk AND NOT national_id = repeat(substr(national_id, 1, 1), 10) AS id_ok FROM w),
    a AS (SELECT *, 2026 - year(born) - CASE WHEN month(DATE '2026-01-01') * 100 + 1 < month(born) * 100 + day(born) THEN 1 ELSE 0 END AS age FROM v)"""


def fn13(s, d):
    w = _wide(s, d)
    return w.select("c_custkey", dates.to_date(F.col("birth_date")).alias("born"), dates.age_on(F.col("birth_date"), today()).alias("age"), dates.is_expired(F.col("expiry_date"), today()).alias("expired"))


def fn11(s, d):
    k = F.col("o_orderkey")
    return table(s, d, "orders").select("o_orderkey", dates.jalali_to_date(k % 250 + 1250, k % 12 + 1, k % 29 + 1).alias("day"))


def fn12(s, d):
    p = dates.parse_jalali(F.col("birth_date"))
    leap = dates.jalali_leap(F.col("c_custkey") % 250 + 1250)
    return _wide(s, d).select("c_custkey", p["y"].alias("y"), p["m"].alias("m"), p["d"].alias("d"), leap.alias("leap"))


def policies(s):
    return s.createDataFrame([("v1", "1990-01-01"), ("v2", "1995-06-01"), ("v3", "1999-01-01")], "version string, valid_from string").withColumn("valid_from", F.col("valid_from").cast("timestamp"))


def jn11(s, d):
    """A user's newest frame asks for the match that was made for its selfie and card."""
    f = frames(s, d).select(F.col("user_id").alias("case_id"), (F.col("k") % 3).alias("capture_id"), (F.col("k") % 4).alias("card"), F.col("event_id").alias("match_id"))
    newest = f.groupBy("case_id").agg(F.max(F.struct("match_id", "capture_id", "card")).alias("x")).select("case_id", "x.capture_id", "x.card")
    return decisions.reuse_match(newest, f.where("match_id % 5 <> 0").withColumn("made", F.col("match_id")))


QUERIES = {
    "prj1_public_view": lambda s, d: decisions.public_view(frames(s, d).select("event_id", F.create_map(F.lit("k"), F.col("k").cast("string"), F.lit("face_base64"), F.lit("x")).alias("data"))).select("event_id", F.array_join(F.map_keys("data"), ",").alias("keys"), F.col("data")["k"].alias("k")),
    "prj3_apply_modes": prj3,
    "prj4_frame_findings": prj4,
    "prj5_quality_gate": prj5,
    "prj6_three_bands": prj6,
    "prj7_retake_guard": prj7,
    "prj8_tenant_view": lambda s, d: decisions.tenant_view(table(s, d, "orders"), "o_custkey", 7).select("o_orderkey", "o_orderstatus"),
    "prj9_flag_editors": lambda s, d: decisions.flag_editors(table(s, d, "pages"), "html").select("page_id", "edited"),
    "prj10_path_fields": lambda s, d: evaluation.crop_keys(table(s, d, "documents").select("doc_id", F.concat(F.lit("a__b/"), "lang", F.lit("_7__x__"), "source", F.lit(".png")).alias("path")), "path").select("doc_id", "field", "split"),
    "prj11_fit_labels": lambda s, d: evaluation.fit_labels(table(s, d, "documents"), "text", 500)[1],
    "prj12_field_findings": prj12,
    "prj13_validate_documents": lambda s, d: decisions.profile("ir_national_card_front")[0](_wide(s, d), today()).select("c_custkey", "codes"),
    "prj14_enrich": lambda s, d: decisions.enrich(_wide(s, d), today()).select("c_custkey", "born", "age", "ends", "expired", "id_valid"),
    "fn10_national_id": lambda s, d: _wide(s, d).select("c_custkey", dates.valid_national_id(F.col("national_id")).alias("valid")),
    "fn11_jalali_to_date": fn11,
    "fn12_parse_jalali": fn12,
    "fn13_jalali_ages": fn13,
    "prj15_unlocated": lambda s, d: decisions.unlocated(table(s, d, "orders").select(F.col("o_orderkey").alias("doc"), F.lit("R").alias("class"), (F.col("o_orderkey") % 2 == 0).alias("required")), table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("class")), ["doc", "class"]).select("doc"),
    "prj16_missing_fields": lambda s, d: decisions.missing_fields(_wide(s, d), ["national_id", "birth_date", "expiry_date", "first_name", "last_name", "father_name"]).select("c_custkey", "missing"),
    "jn1_assemble_case": lambda s, d: decisions.assemble_case(_cases(s, d), results(s, d), REQUIRED),
    "jn2_missing_steps": lambda s, d: decisions.missing_steps(_cases(s, d), results(s, d), REQUIRED),
    "jn11_reuse_match": jn11,
    "jn16_reason_outcomes": lambda s, d: decisions.reason_outcomes(reasons(results(s, d)), REJECT).groupBy("step", "code", "outcome").agg(F.count("*").alias("n")),
    "jn17_policy_as_of": lambda s, d: decisions.policy_as_of(table(s, d, "orders").select("o_orderkey", "o_orderdate"), policies(s), "o_orderdate").select("o_orderkey", "version"),
    "ag1_best_per_class": lambda s, d: curation.best_per_class(table(s, d, "lineitem"), ["l_orderkey", "l_returnflag"], "l_quantity", "l_linenumber").select("l_orderkey", "l_returnflag", "l_linenumber", "l_quantity"),
    "ag2_decide": lambda s, d: decisions.decide(_cases(s, d).select("case_id"), reasons(results(s, d)), "case_id"),
    "ag3_ocr_score": lambda s, d: decisions.ocr_score(table(s, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 3 > 0, "v").alias("value"), (F.col("l_quantity") / 50).cast("double").alias("confidence")), "l_orderkey").withColumn("ocr_score", F.round("ocr_score", 6)),
    "ag4_case_verdict": _verdicts,
    "ag5_review_score": lambda s, d: decisions.judge(decisions.gather(_cases(s, d), results(s, d), reasons(results(s, d))), REQUIRED, REJECT).select("case_id", "review_score"),
    "ag34_weighted_verdict": lambda s, d: decisions.weighted_verdict(results(s, d), {"document": 0.4, "face_match": 0.35, "liveness": 0.25}).withColumn("weighted", F.round("weighted", 6)),
    "sl1_order_findings": lambda s, d: decisions.order_findings(reasons(results(s, d)), "case_id", ("spoof_detected", "under_age")),
    "sl5_review_queue": lambda s, d: decisions.review_queue(_verdicts(s, d), 50),
}

_VERDICT = f"""WITH {RESULTS}, req AS (SELECT unnest(['document', 'selfie', 'antispoof', 'face_match', 'liveness']) AS step), ords AS (SELECT unnest(['document', 'forensics', 'selfie', 'antispoof', 'face_match', 'liveness']) AS step, unnest(range(1, 7)) AS ord),
    done AS (SELECT * FROM results WHERE status = 'done'),
    said AS (SELECT r.case_id, r.step, code, CASE WHEN severity = 'error' AND code IN ('spoof_detected', 'faces_do_not_match') THEN 'rejected' ELSE 'manual_review' END AS outcome FROM reasons r SEMI JOIN done USING (case_id, step)),
    b AS (SELECT c_custkey AS case_id, req.step, 'step_missing' AS code, 'manual_review' AS outcome FROM customer, req WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.case_id = c_custkey AND r.step = req.step)
        UNION ALL SELECT case_id, step, 'module_unavailable', 'manual_review' FROM results WHERE status = 'unavailable' UNION ALL SELECT * FROM said
        UNION ALL SELECT case_id, step, step || '_' || decision, 'manual_review' FROM done WHERE decision <> 'pass' AND NOT EXISTS (SELECT 1 FROM said WHERE said.case_id = done.case_id AND said.step = done.step)),
    g AS (SELECT case_id, bool_or(outcome = 'rejected') AS rej, string_agg(b.step || ':' || code, ',' ORDER BY ord, b.step, code) AS blocking FROM b JOIN ords ON b.step = ords.step GROUP BY 1),
    verdicts AS (SELECT c_custkey AS case_id, CASE WHEN rej THEN 'rejected' WHEN blocking IS NOT NULL THEN 'manual_review' ELSE 'approved' END AS verdict, coalesce(blocking, '') AS blocking, coalesce(round(low, 4), 0.0) AS review_score
        FROM customer LEFT JOIN g ON g.case_id = c_custkey LEFT JOIN (SELECT case_id, min(score) AS low FROM done GROUP BY 1) m ON m.case_id = c_custkey)"""

SQL = {
    "prj1_public_view": f"WITH {FRAMES} SELECT event_id, 'k' AS keys, CAST(k AS VARCHAR) AS k FROM frames",
    "prj3_apply_modes": "SELECT event_id, event_type AS code, CASE WHEN event_type IN ('click', 'view') THEN 'info' ELSE 'error' END AS severity FROM events WHERE event_type <> 'error'",
    "prj4_frame_findings": PRJ4_SQL,
    "prj5_quality_gate": "SELECT doc_id, fatal, CASE WHEN fatal IS NULL AND (n_chars % 10) / 10.0 > 0.5 THEN 'card_glare' END AS warning FROM (SELECT *, CASE WHEN n_chars % 256 < 40 THEN 'card_too_dark' WHEN n_chars % 256 > 220 THEN 'card_too_bright' WHEN n_chars % 97 < 5 THEN 'card_blurry' END AS fatal FROM documents)",
    "prj6_three_bands": f"WITH {RESULTS} SELECT result_id, CASE WHEN score >= 0.45 THEN CASE WHEN result_id % 5 = 0 THEN 'review' ELSE 'pass' END WHEN score < 0.25 THEN 'fail' ELSE 'review' END AS decision, least(1.0, greatest(0.0, CASE WHEN score < 0.25 THEN least(score, 0.5) ELSE score END)) AS band_score FROM results",
    "prj7_retake_guard": f"WITH {FRAMES} SELECT event_id, CASE WHEN k % 10 > 0 AND value < 5 THEN 'retake_low_quality' ELSE 'pass' END AS decision FROM frames",
    "prj8_tenant_view": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 7",
    "prj9_flag_editors": f"SELECT page_id, regexp_matches(lower(coalesce(html, '')), '{'|'.join(decisions.EDITORS).replace('.', '[.]')}') AS edited FROM pages",
    "prj10_path_fields": "SELECT doc_id, source AS field, lang AS split FROM documents",
    "prj11_fit_labels": "SELECT count(*) FILTER (length(text) <= 500) AS kept, count(*) FILTER (text IS NULL OR length(text) > 500) AS dropped FROM documents",
    "prj12_field_findings": "SELECT doc_id, CASE WHEN text <> '' THEN concat_ws(',', CASE WHEN (n_chars % 100) / 100.0 < 0.3 THEN 'field_low_confidence' END, CASE WHEN length(text) <> CASE lang WHEN 'en' THEN 300 WHEN 'fr' THEN 200 END THEN 'field_length_mismatch' END) ELSE '' END AS codes FROM documents",
    "prj13_validate_documents": f"""WITH {WIDE} SELECT c_custkey, concat_ws(',', CASE WHEN national_id IS NULL THEN 'national_id_missing' WHEN length(national_id) <> 10 THEN 'national_id_length' WHEN NOT id_ok THEN 'national_id_checksum' END,
        CASE WHEN birth_date IS NULL THEN 'birth_date_missing' WHEN born IS NULL THEN 'birth_date_invalid' WHEN age < 0 OR age > 120 THEN 'birth_date_implausible' WHEN age < 18 THEN 'under_age' END,
        CASE WHEN expiry_date IS NULL THEN 'expiry_missing' WHEN ends IS NULL THEN 'expiry_invalid' WHEN ends < DATE '2026-01-01' THEN 'card_expired' END, CASE WHEN born >= ends THEN 'date_order' END,
        CASE WHEN first_name IS NULL THEN 'first_name_missing' END, CASE WHEN last_name = 'x' THEN 'last_name_suspicious' END, CASE WHEN father_name = '' THEN 'father_name_missing' END) AS codes FROM a""",
    "prj14_enrich": f"WITH {WIDE} SELECT c_custkey, born, CAST(age AS INT) AS age, ends, ends < DATE '2026-01-01' AS expired, CASE WHEN length(national_id) = 10 THEN id_ok END AS id_valid FROM a",
    "fn10_national_id": f"WITH {WIDE} SELECT c_custkey, id_ok AS valid FROM a",
    "fn11_jalali_to_date": f"SELECT o_orderkey, DATE '1970-01-01' + CAST({_jalali('(o_orderkey % 250 + 1250)', '(o_orderkey % 12 + 1)', '(o_orderkey % 29 + 1)')} AS INT) AS day FROM orders",
    "fn12_parse_jalali": f"""WITH {WIDE}, p AS (SELECT c_custkey, c_custkey % 250 + 1250 AS year, CASE WHEN born IS NOT NULL THEN string_split(birth_date, '/') END AS part FROM v)
        SELECT c_custkey, CAST(part[1] AS INT) AS y, CAST(part[2] AS INT) AS m, CAST(part[3] AS INT) AS d, {_jalali('(year + 1)', '1', '1')} - {_jalali('year', '1', '1')} = 366 AS leap FROM p""",
    "fn13_jalali_ages": f"WITH {WIDE} SELECT c_custkey, born, CAST(age AS INT) AS age, ends < DATE '2026-01-01' AS expired FROM a",
    "prj15_unlocated": "SELECT o_orderkey AS doc FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "prj16_missing_fields": f"WITH {WIDE} SELECT c_custkey, concat_ws(',', " + ", ".join(f"CASE WHEN {c} IS NULL OR {c} = '' THEN '{c}' END" for c in ("national_id", "birth_date", "expiry_date", "first_name", "last_name", "father_name")) + ") AS missing FROM a",
    "jn1_assemble_case": f"WITH {RESULTS} SELECT c_custkey AS case_id, " + ", ".join(f"max(decision) FILTER (step = '{x}') AS {x}" for x in REQUIRED) + " FROM customer LEFT JOIN results ON case_id = c_custkey GROUP BY 1",
    "jn2_missing_steps": f"WITH {RESULTS}, req AS (SELECT unnest(['document', 'selfie', 'antispoof', 'face_match', 'liveness']) AS step) SELECT c_custkey AS case_id, req.step FROM customer, req WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.case_id = c_custkey AND r.step = req.step)",
    "jn11_reuse_match": f"WITH {FRAMES}, c AS (SELECT user_id, arg_max(k, event_id) AS k FROM frames GROUP BY 1), m AS (SELECT user_id, k % 3 AS a, k % 4 AS b, max(event_id) AS match_id FROM frames WHERE event_id % 5 <> 0 GROUP BY 1, 2, 3) SELECT c.user_id AS case_id, k % 3 AS capture_id, k % 4 AS card, match_id FROM c LEFT JOIN m ON m.user_id = c.user_id AND a = k % 3 AND b = k % 4",
    "jn16_reason_outcomes": f"WITH {RESULTS} SELECT step, code, CASE WHEN severity = 'error' AND code IN ('spoof_detected', 'faces_do_not_match') THEN 'rejected' ELSE 'manual_review' END AS outcome, count(*) AS n FROM reasons GROUP BY 1, 2, 3",
    "jn17_policy_as_of": "SELECT o_orderkey, CASE WHEN o_orderdate >= DATE '1999-01-01' THEN 'v3' WHEN o_orderdate >= DATE '1995-06-01' THEN 'v2' WHEN o_orderdate >= DATE '1990-01-01' THEN 'v1' END AS version FROM orders",
    "ag1_best_per_class": "SELECT l_orderkey, l_returnflag, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_quantity DESC, l_linenumber) AS rn FROM lineitem) WHERE rn = 1",
    "ag2_decide": f"WITH {RESULTS} SELECT c_custkey AS case_id, CASE WHEN bool_or(severity = 'error') THEN 'fail' WHEN bool_or(severity = 'warn') THEN 'review' ELSE 'pass' END AS decision FROM customer LEFT JOIN reasons ON case_id = c_custkey GROUP BY 1",
    "ag3_ocr_score": "SELECT l_orderkey, round(sum(CASE WHEN l_linenumber % 3 > 0 THEN CAST(l_quantity AS DOUBLE) / 50 ELSE 0 END) / count(*), 6) AS ocr_score FROM lineitem GROUP BY 1",
    "ag4_case_verdict": f"{_VERDICT} SELECT * FROM verdicts",
    "ag5_review_score": f"{_VERDICT} SELECT case_id, review_score FROM verdicts",
    "ag34_weighted_verdict": f"WITH {RESULTS}, w AS (SELECT *, CASE step WHEN 'document' THEN 0.4::DOUBLE WHEN 'face_match' THEN 0.35::DOUBLE WHEN 'liveness' THEN 0.25::DOUBLE END AS w FROM results) SELECT case_id, round(sum(w * score) / sum(w), 6) AS weighted FROM w WHERE w IS NOT NULL GROUP BY 1",
    "sl1_order_findings": f"WITH {RESULTS} SELECT case_id, string_agg(code, ',' ORDER BY severity <> 'error', CASE code WHEN 'spoof_detected' THEN 1 WHEN 'under_age' THEN 2 ELSE 3 END, code) AS codes FROM reasons GROUP BY 1",
    "sl5_review_queue": f"{_VERDICT} SELECT * FROM verdicts WHERE verdict <> 'approved' ORDER BY review_score, case_id LIMIT 50",
}
