"""From findings to auditable decisions: modes, bands, roll-ups and case verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators.selection import few

# Steps in the order they are shown, groups of checks with their codes, words that name an editor.
STEPS = ("document", "forensics", "selfie", "antispoof", "face_match", "liveness")
GROUPS = {
    "single_person": ("multiple_faces",), "distance": ("face_too_small", "face_too_large", "face_off_center", "face_cut_off", "face_too_close_for_context"),
    "lighting": ("face_too_dark", "face_too_bright"), "even_lighting": ("uneven_lighting",), "sharpness": ("face_blurry",), "head_pose": ("head_turned", "head_tilted"),
    "eyes_open": ("eyes_closed",), "mouth_closed": ("mouth_open",), "gaze": ("gaze_off_center",), "no_cover": ("face_occluded",), "background": ("background_not_uniform",),
}
MODES = ("off", "info", "block")
EDITORS = ("photoshop", "gimp", "snapseed", "picsart", "canva", "lightroom", "pixlr", "paint.net", "affinity", "polarr", "facetune", "remini", "photoroom", "illustrator", "corel")


def severity_rank(c: Column) -> Column:
    return F.when(c == "error", 2).when(c == "warn", 1).otherwise(0)


def resolve_modes(*layers: dict[str, str] | None, groups=GROUPS, default: dict[str, str] | None = None) -> dict[str, str]:
    """Defaults, then each layer in order; an unknown group or mode raises."""
    modes = {g: "block" for g in groups} | ({"even_lighting": "info"} if "even_lighting" in groups else {}) | (default or {})
    for layer in layers:
        for g, m in (layer or {}).items():
            if g not in groups or m not in MODES:
                raise ValueError(f"unknown check group or mode: {g}={m}")
            modes[g] = m
    return modes


def apply_modes(reasons: DataFrame, modes: dict[str, str], groups=GROUPS) -> DataFrame:
    """reasons(code, severity, ...): off drops, info downgrades, block makes an error; codes of no group stay."""
    of = {code: modes[g] for g, codes in groups.items() for code in codes}
    mode = F.try_element_at(F.create_map(*(F.lit(x) for kv in of.items() for x in kv)), F.col("code")) if of else F.lit(None)
    out = reasons.withColumn("mode", mode).where("mode IS NULL OR mode <> 'off'")
    return out.withColumn("severity", F.when(F.col("mode") == "info", "info").when(F.col("mode") == "block", "error").otherwise(F.col("severity"))).drop("mode")


def decide(entities: DataFrame, reasons: DataFrame, key: str, ignore_warns: bool = False) -> DataFrame:
    """Any error fails, else any warning asks for review, else pass: also for entities without a reason."""
    worst = reasons.groupBy(key).agg(F.max(severity_rank(F.col("severity"))).alias("worst"))
    rank = F.coalesce("worst", F.lit(0))
    decision = F.when(rank == 2, "fail").when((rank == 1) & F.lit(not ignore_warns), "review").otherwise("pass")
    return entities.join(worst, key, "left").withColumn("decision", decision).drop("worst")


def band(df: DataFrame, score: str, accept: float, reject: float, warned: Column | None = None) -> DataFrame:
    """pass at ``accept``, fail below ``reject``, else review; a pass with a warning is a review; a failed score is at most 0.5."""
    s, warned = F.col(score), F.lit(False) if warned is None else warned
    decision = F.when(s >= accept, F.when(warned, "review").otherwise("pass")).when(s < reject, "fail").otherwise("review")
    out = df.withColumn("decision", decision)
    held = F.when(F.col("decision") == "fail", F.least(s, F.lit(0.5))).otherwise(s)
    return out.withColumn("band_score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), held)))


def retake_guard(df: DataFrame, sharpness: str, floor: float, decision: str = "decision") -> DataFrame:
    """Below the floor the answer is to take another picture, whatever the scores say; unmeasured sharpness is judged."""
    return df.withColumn(decision, F.when(F.col(sharpness) < floor, "retake_low_quality").otherwise(F.col(decision)))


def tenant_view(cases: DataFrame, owner: str, customer) -> DataFrame:
    """Rows of other owners aren't there."""
    return cases.where(F.col(owner) == customer)


def public_view(results: DataFrame, payload: str = "data") -> DataFrame:
    return results.withColumn(payload, F.map_filter(payload, lambda k, v: ~k.endswith("_base64")))


def missing_steps(cases: DataFrame, results: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """A row for each required step that a case has no result of."""
    wanted = cases.select("case_id", F.explode(F.array(*map(F.lit, required))).alias("step"))
    return wanted.join(results.select("case_id", "step"), ["case_id", "step"], "left_anti")


def reason_outcomes(reasons: DataFrame, reject: tuple[str, ...], reject_warned: tuple[str, ...] = ()) -> DataFrame:
    """Listed errors and warnings reject, others ask for review, info is ignored."""
    listed = ((F.col("severity") == "error") & F.col("code").isin(*reject)) | ((F.col("severity") == "warn") & F.col("code").isin(*reject_warned))
    return reasons.where("severity IN ('error', 'warn')").withColumn("outcome", F.when(listed, "rejected").otherwise("manual_review"))


RESULTS = "array<struct<step:string,status:string,decision:string,score:double>>"
REASONS = "array<struct<step:string,code:string,severity:string>>"


def gather(cases: DataFrame, results: DataFrame, reasons: DataFrame) -> DataFrame:
    """cases(case_id), results(case_id, step, status, decision, score), reasons(case_id, step, code, severity) ->
    case_id, results, reasons: all of a case in one row, by one exchange. A case has a few steps with a few reasons each.
    """
    none = lambda kind: F.lit(None).cast(kind[6:-1])
    result = F.struct("step", "status", "decision", F.col("score").cast("double").alias("score"))
    rows = cases.select("case_id", F.lit(1).alias("open"), none(RESULTS).alias("result"), none(REASONS).alias("reason"))
    rows = rows.union(results.where("case_id IS NOT NULL").select("case_id", F.lit(0), result, none(REASONS)))
    rows = rows.union(reasons.where("case_id IS NOT NULL").select("case_id", F.lit(0), none(RESULTS), F.struct("step", "code", "severity")))
    out = rows.groupBy("case_id").agg(F.sum("open").cast("int").alias("open"), F.collect_list("result").alias("results"), F.collect_list("reason").alias("reasons"))
    return out.where("open > 0").select("case_id", "results", "reasons", F.explode(F.sequence(F.lit(1), F.col("open"))).alias("copy")).drop("copy")


def judge(gathered: DataFrame, required: tuple[str, ...], reject: tuple[str, ...], reject_warned: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``gather`` -> the same with verdict, blocking, review_score, by functions on each row alone.

    A rejected outcome rejects; any other blocking one, a missing or unavailable
    step, or a non-pass without a blocking reason asks for a human; else approved.
    """
    step = lambda x: x["step"]
    code = lambda what, of=step: lambda x: F.struct(of(x).alias("step"), what(x).alias("code"))
    done = F.filter("results", lambda r: r["status"] == "done")
    gone = F.transform(F.filter("results", lambda r: r["status"] == "unavailable"), code(lambda r: F.lit("module_unavailable")))
    lacking = F.array_except(F.array(*map(F.lit, required)), F.transform("results", step))
    missing = F.transform(lacking, code(lambda s: F.lit("step_missing"), lambda s: s))
    steps_done = F.transform(done, step)
    said = F.filter("reasons", lambda q: q["severity"].isin("error", "warn") & F.array_contains(steps_done, q["step"]))
    vague = F.filter(done, lambda r: (r["decision"] != "pass") & ~F.coalesce(F.array_contains(F.transform(F.col("said"), step), r["step"]), F.lit(False)))
    vague = F.transform(vague, code(lambda r: F.concat_ws("_", r["step"], r["decision"])))
    order = F.array(*map(F.lit, STEPS))
    listed = lambda q: ((q["severity"] == "error") & q["code"].isin(*reject)) | ((q["severity"] == "warn") & q["code"].isin(*reject_warned))
    out = gathered.withColumn("said", said)
    out = out.withColumn("all", F.concat(missing, gone, F.transform("said", code(lambda q: q["code"])), vague))
    ranked = F.array_sort(F.transform("all", lambda x: F.struct(F.array_position(order, x["step"]).alias("ord"), x["step"].alias("step"), x["code"].alias("code"))))
    blocking = F.array_join(F.transform(ranked, lambda x: F.concat_ws(":", x["step"], x["code"])), ",")
    verdict = F.when(F.exists("said", listed), "rejected").when(F.size("all") > 0, "manual_review").otherwise("approved")
    return out.withColumns({"verdict": verdict, "blocking": blocking, "review_score": review_score(F.transform(done, lambda r: r["score"]))}).drop("said", "all")


def review_score(scores: Column) -> Column:
    """The lowest of an array of scores, 0 where there is none: it ranks the queue, it never decides."""
    return F.coalesce(F.round(F.array_min(scores), 4), F.lit(0.0))


def case_verdict(cases: DataFrame, results: DataFrame, reasons: DataFrame, required: tuple[str, ...], reject: tuple[str, ...], reject_warned: tuple[str, ...] = ()) -> DataFrame:
    """``gather`` and ``judge``: case_id, verdict, blocking, review_score for each row of ``cases``."""
    return judge(gather(cases, results, reasons), required, reject, reject_warned).select("case_id", "verdict", "blocking", "review_score")


def flag_editors(media: DataFrame, software: str, words: tuple[str, ...] = EDITORS) -> DataFrame:
    """edited: does the software's name hold one of the words? An unnamed one doesn't."""
    low = F.lower(F.coalesce(software, F.lit("")))
    hit = F.lit(False)
    for w in words:
        hit |= low.contains(w)
    return media.withColumn("edited", hit)


def field_findings(readings: DataFrame, spec: DataFrame, least: float) -> DataFrame:
    """readings(field, value, confidence, ...) and spec(field, exact_len) -> the same with ``findings``, an array of codes.

    Only fields with a value have findings. ``spec`` has a row for each field; fields without one have no length to meet.
    A short ``spec`` goes to all tasks, so that the readings of a frequent field aren't one task.
    """
    filled = F.coalesce(F.col("value") != "", F.lit(False))
    low = F.when(filled & (F.col("confidence") < least), F.lit("field_low_confidence"))
    size = F.when(filled & (F.length("value") != F.col("exact_len")), F.lit("field_length_mismatch"))
    both = readings.join(few(spec.select("field", "exact_len"), "field-spec"), "field", "left")
    return both.withColumn("findings", F.array_compact(F.array(low, size))).drop("exact_len").select(*readings.columns, "findings")


def reuse_match(cases: DataFrame, matches: DataFrame, keys: tuple[str, ...] = ("case_id", "capture_id", "card"), order: str = "made") -> DataFrame:
    """cases(keys) and stored matches(keys, match_id, order) -> the newest match of just this selfie and card, null where a new one is needed."""
    newest = matches.groupBy(*keys).agg(F.max_by("match_id", order).alias("match_id"))
    return cases.join(newest, list(keys), "left")


def assemble_case(cases: DataFrame, results: DataFrame, steps: tuple[str, ...] = STEPS) -> DataFrame:
    """One row for each case with the decision of each step; null where there is none. One shuffle for all steps."""
    wide = results.groupBy("case_id").agg(*(F.max(F.when(F.col("step") == s, F.col("decision"))).alias(s) for s in steps))
    return cases.select("case_id").join(wide, "case_id", "left")


def weighted_verdict(results: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The old weighted sum over the steps that are there; kept to compare against the rules only."""
    w = F.try_element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("step"))
    return results.withColumn("w", w).where("w IS NOT NULL").groupBy("case_id").agg((F.sum(F.col("w") * F.col("score")) / F.sum("w")).alias("weighted"))


def review_queue(verdicts: DataFrame, k: int) -> DataFrame:
    """The k cases to look at first."""
    return verdicts.where("verdict <> 'approved'").orderBy("review_score", "case_id").limit(k)


def order_findings(reasons: DataFrame, key: str, priority: tuple[str, ...]) -> DataFrame:
    """Each entity's codes: blocking ones first, then by priority, unknown ones last."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("code"))
    sort = F.struct((F.col("severity") != "error").alias("soft"), F.when(rank > 0, rank).otherwise(len(priority) + 1).alias("rank"), F.col("code").alias("code"))
    return reasons.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(sort)), lambda x: x["code"]), ",").alias("codes"))


def ocr_score(readings: DataFrame, key: str) -> DataFrame:
    """readings(key, value, confidence): confidences of fields with a value over all expected fields."""
    filled = F.col("value").isNotNull() & (F.col("value") != "")
    return readings.groupBy(key).agg((F.sum(F.when(filled, F.col("confidence")).otherwise(0.0)) / F.count("*")).alias("ocr_score"))


def unlocated(fields: DataFrame, detections: DataFrame, keys: list[str]) -> DataFrame:
    """Required fields without a detection."""
    return fields.where("required").join(detections.select(*keys).distinct(), keys, "left_anti")


def missing_fields(df: DataFrame, names: list[str]) -> DataFrame:
    empty = [F.when(F.col(n).isNull() | (F.col(n).cast("string") == ""), F.lit(n)) for n in names]
    return df.withColumn("missing", F.array_join(F.array_compact(F.array(*empty)), ","))


def quality_gate(docs: DataFrame, limits: dict[str, float]) -> DataFrame:
    """docs(sharpness, brightness, glare): the first fatal finding, or null; glare only warns."""
    fatal = F.when(F.col("brightness") < limits["dark"], "card_too_dark").when(F.col("brightness") > limits["bright"], "card_too_bright").when(F.col("sharpness") < limits["sharp"], "card_blurry")
    return docs.withColumn("fatal", fatal).withColumn("warning", F.when(fatal.isNull() & (F.col("glare") > limits["glare"]), "card_glare"))


def frame_findings(m: dict[str, Column], cfg: dict[str, float]) -> Column:
    """Codes of one frame's measures, in the order they are checked. An unmeasured (null) value gives no finding."""
    dark, bright = m["brightness"] < cfg["dark"], m["brightness"] > cfg["bright"]
    ratio, turned = m["height_ratio"], (F.abs(m["yaw"]) > cfg["yaw"]) | (F.abs(m["pitch"]) > cfg["pitch"])
    closed = m["eyes"] < cfg["eyes"]
    rules = [
        (m["faces"] == 0, "no_face"), (m["others"] > 0, "multiple_faces"), (ratio < cfg["small"], "face_too_small"), (ratio > cfg["large"], "face_too_large"),
        (m["cut_off"], "face_cut_off"), (~m["cut_off"] & (m["offset"] > cfg["offset"]), "face_off_center"), (~m["cut_off"] & (m["context"] < cfg["context"]), "face_too_close_for_context"),
        (dark, "face_too_dark"), (~dark & bright, "face_too_bright"), (~dark & ~bright & (m["sharpness"] < cfg["sharp"]), "face_blurry"), (m["asymmetry"] > cfg["asymmetry"], "uneven_lighting"),
        (turned, "head_turned"), (F.abs(m["roll"]) > cfg["roll"], "head_tilted"), (closed, "eyes_closed"), (m["mouth"] > cfg["mouth"], "mouth_open"),
        (~closed & ~turned & (F.abs(m["gaze"]) > cfg["gaze"]), "gaze_off_center"), (m["clear"] < cfg["clear"], "face_occluded"), (m["edges"] > cfg["edges"], "background_not_uniform"),
    ]
    first = F.when(m["faces"] == 0, F.array(F.lit("no_face")))
    return first.otherwise(F.array_compact(F.array(*(F.when(c, F.lit(code)) for c, code in rules[1:]))))


def policy_as_of(verdicts: DataFrame, policies: DataFrame, at: str) -> DataFrame:
    """policies(version, valid_from): the version in force at each row's time, the latest that began by then; null before all.

    Versions become stretches of days; a row meets only those of its own day. Of equal starts the larger version counts.
    """
    day = lambda c: F.floor(F.unix_timestamp(c) / 86400)
    p = policies.where("valid_from IS NOT NULL").groupBy(F.col("valid_from").cast("timestamp").alias("valid_from")).agg(F.max("version").alias("version"))
    p = p.withColumn("_day", day(F.col("valid_from")))
    # of each day its last version serves the days after it, until the next day that has one
    first = p.groupBy("_day").agg(F.collect_list(F.struct("valid_from", "version")).alias("_of_day"), F.max(F.struct("valid_from", "version")).alias("_last"))
    rows = verdicts.withColumn("_at", F.col(at).cast("timestamp"))
    days = rows.select(day(F.col("_at")).alias("_day")).where("_day IS NOT NULL").distinct().unionByName(first.select("_day")).distinct()
    w = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each day that occurs: years of days are some thousands
    known = days.join(first, "_day", "left").withColumn("_before", F.last("_last", ignorenulls=True).over(w))
    both = rows.withColumn("_day", day(F.col("_at"))).join(known, "_day", "left")
    today = F.array_max(F.filter("_of_day", lambda x: x["valid_from"] <= F.col("_at")))
    found = F.coalesce(today, F.col("_before"))
    return both.select(*verdicts.columns, found["version"].alias("version"), found["valid_from"].alias("valid_from"))


def validate_documents(wide: DataFrame, today: Column) -> DataFrame:
    """wide(national_id, birth_date, expiry_date, first_name, last_name, father_name) -> the same with ``codes``, all findings in one pass."""
    from attesta.functions import dates

    nid, birth, expiry = (F.when(F.col(c) != "", F.col(c)) for c in ("national_id", "birth_date", "expiry_date"))
    # each date is parsed once: later columns refer to it by name
    names = wide.columns
    wide = wide.withColumns({"_born": dates.to_date(birth), "_ends": dates.to_date(expiry)})
    born, ends = F.col("_born"), F.col("_ends")
    wide = wide.withColumn("_age", F.year(today) - F.year(born) - (F.date_format(today, "MMdd") < F.date_format(born, "MMdd")).cast("int"))
    age = F.col("_age")
    codes = [
        F.when(nid.isNull(), "national_id_missing").when(F.length(nid) != 10, "national_id_length").when(~dates.valid_national_id(nid), "national_id_checksum"),
        F.when(birth.isNull(), "birth_date_missing").when(born.isNull(), "birth_date_invalid").when((age < 0) | (age > 120), "birth_date_implausible").when(age < 18, "under_age"),
        F.when(expiry.isNull(), "expiry_missing").when(ends.isNull(), "expiry_invalid").when(ends < today, "card_expired"),
        F.when(born >= ends, "date_order"),
    ]
    for c in ("first_name", "last_name", "father_name"):
        codes.append(F.when(F.col(c).isNull() | (F.col(c) == ""), f"{c}_missing").when(F.length(c) < 2, f"{c}_suspicious"))
    return wide.select(*names, F.array_join(F.array_compact(F.array(*codes)), ",").alias("codes"))


def enrich(wide: DataFrame, today: Column) -> DataFrame:
    from attesta.functions import dates

    valid = F.when(F.length("national_id") == 10, dates.valid_national_id(F.col("national_id")))
    return wide.withColumns({"born": dates.to_date(F.col("birth_date")), "age": dates.age_on(F.col("birth_date"), today), "ends": dates.to_date(F.col("expiry_date")), "expired": dates.is_expired(F.col("expiry_date"), today), "id_valid": valid})


#: Document profiles by id: a validator and an enricher, each wide DataFrame and today -> DataFrame.
PROFILES = {"ir_national_card_front": (validate_documents, enrich)}


def profile(name: str):
    if name not in PROFILES:
        raise KeyError(f"unknown document profile {name!r}; known: {', '.join(sorted(PROFILES))}")
    return PROFILES[name]
