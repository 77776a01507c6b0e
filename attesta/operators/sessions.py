"""Ordered frames and events of sessions: streaks, running values, hints, steps. Every order is total, so results repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators.segments import SEGMENT, before, carried, cut, inside, up_to


def _w(key: str, order: list[str]):
    return Window.partitionBy(key).orderBy(*order)


def _plain(df: DataFrame) -> DataFrame:
    return df.drop(*(c for c in df.columns if c.startswith("_seg_")))


def ok_streak(frames: DataFrame, key: str, order: list[str], ok: Column, n: int) -> DataFrame:
    """Passing frames in a row, from 0 at each failure, and whether n are there."""
    w = inside(key, order)
    rows = cut(frames, key, order).withColumn("_seg_ok", ok.cast("int")).withColumn("_seg_bad", F.sum(1 - F.col("_seg_ok")).over(w))
    run = Window.partitionBy(key, SEGMENT, "_seg_bad").orderBy(*order)
    rows = rows.withColumn("_seg_run", F.sum("_seg_ok").over(run))
    # a segment ends in a run; runs of segments up to the same number of failures are one
    bad = {"_seg_all": F.sum("_seg_all").over(up_to())}
    at_start = {"_seg_island": F.last("_seg_all").over(before()), "_seg_streak": F.last("_seg_tail").over(before())}
    facts = {"_seg_all": F.sum(1 - F.col("_seg_ok")), "_seg_tail": F.max_by("_seg_run", F.struct(*order))}
    rows = carried(rows, key, facts, bad, {"_seg_tail": F.sum("_seg_tail").over(up_to("_seg_all"))}, at_start)
    more = F.when(F.col("_seg_bad") == 0, F.coalesce("_seg_streak", F.lit(0))).otherwise(0)
    out = rows.withColumns({"island": F.col("_seg_bad") + F.coalesce("_seg_island", F.lit(0)), "streak": F.col("_seg_run") + more})
    return _plain(out.withColumn("qualified", F.col("streak") >= n))


def running_max(frames: DataFrame, key: str, order: list[str], col: str, after: int = 2) -> DataFrame:
    """The largest value before this frame; null until ``after`` frames have passed."""
    w = inside(key, order)
    facts = {"_seg_max": F.max(col), "_seg_n": F.count("*")}
    rows = carried(cut(frames, key, order), key, facts, {"_seg_most": F.max("_seg_max").over(before()), "_seg_passed": F.sum("_seg_n").over(before())})
    here = F.max(col).over(w.rowsBetween(Window.unboundedPreceding, -1))
    number = F.row_number().over(w) + F.coalesce("_seg_passed", F.lit(0))
    return _plain(rows.withColumn("reference", F.when(number > after, F.greatest(here, "_seg_most"))))


def relative_blur(frames: DataFrame, col: str, reference: str, ratio: float) -> DataFrame:
    share = F.col(col) / F.col(reference)
    return frames.withColumn("sharpness_ratio", F.round(share, 4)).withColumn("blurred", F.coalesce(share < ratio, F.lit(False)))


def steady_hints(frames: DataFrame, key: str, order: list[str], codes: str, priority: tuple[str, ...], window: int = 3, least: int = 2) -> DataFrame:
    """The code of highest priority that ``least`` of the last ``window`` frames have, also where this one doesn't."""
    w = inside(key, order)
    last = lambda c: F.slice(c, -F.least(F.lit(window - 1), F.size(c)), F.lit(window - 1)) if window > 1 else F.slice(c, 1, 0)
    rows = cut(frames, key, order).withColumn("_seg_rest", F.row_number().over(Window.partitionBy(key, SEGMENT).orderBy(*(F.desc(c) for c in order))))
    tail = F.array_sort(F.collect_list(F.when(F.col("_seg_rest") < window, F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.col(codes).alias("codes")))))
    earlier = F.flatten(F.collect_list("_seg_tail").over(before()))
    rows = carried(rows, key, {"_seg_tail": F.transform(tail, lambda x: F.struct(x["codes"].alias("codes")))}, {"_seg_tails": F.when(F.size(earlier) > 0, last(earlier)).otherwise(earlier)})
    here = F.collect_list(F.struct(F.col(codes).alias("codes"))).over(w.rowsBetween(1 - window, 0))
    short = F.slice(F.reverse("_seg_tails"), F.lit(1), F.greatest(F.lit(0), F.lit(window) - F.size(here)))  # what the window lacks in its segment
    all_of = F.concat(F.coalesce(short, F.slice(here, 1, 0)), here)
    seen = F.flatten(F.filter(F.transform(all_of, lambda x: x["codes"]), lambda c: c.isNotNull()))
    steady = F.filter(F.array(*map(F.lit, priority)), lambda p: F.size(F.filter(seen, lambda c: c == p)) >= least)
    return _plain(rows.withColumn("hint", F.try_element_at(steady, F.lit(1))))


def best_in_streak(streaks: DataFrame, key: str, score: str, order: list[str]) -> DataFrame:
    """Of each streak of ``ok_streak`` the passing frame with the best score; the first of equal ones."""
    rank = F.row_number().over(Window.partitionBy(key, "island").orderBy(F.desc(score), *order))
    return streaks.where("streak > 0").withColumn("rn", rank).where("rn = 1").drop("rn")


def streak_median(streaks: DataFrame, key: str, col: str, n: int) -> DataFrame:
    """Median over each streak that reaches n frames."""
    return streaks.where("streak > 0").groupBy(key, "island").agg(F.median(col).alias("median"), F.count("*").alias("frames")).where(F.col("frames") >= n)


def every_nth(frames: DataFrame, key: str, order: list[str], n: int, qualifies: Column) -> DataFrame:
    """Qualifying frames whose number among all frames divides by n, and the first qualifying one."""
    w = inside(key, order)
    rows = cut(frames, key, order).withColumn("_seg_q", F.coalesce(qualifies, F.lit(False)))
    facts = {"_seg_n": F.count("*"), "_seg_some": F.count_if("_seg_q")}
    rows = carried(rows, key, facts, {"_seg_passed": F.sum("_seg_n").over(before()), "_seg_had": F.sum("_seg_some").over(before())})
    had = F.count_if("_seg_q").over(w.rowsBetween(Window.unboundedPreceding, -1)) + F.coalesce("_seg_had", F.lit(0))
    number = (F.row_number().over(w) + F.coalesce("_seg_passed", F.lit(0))).cast("int")
    out = rows.withColumns({"frame_no": number, "_seg_first": had == 0})
    return _plain(out.where(F.col("_seg_q") & ((F.col("frame_no") % n == 0) | F.col("_seg_first"))))


def face_lost(frames: DataFrame, key: str, order: list[str], ts: str, one_face: Column, limit_s: float) -> DataFrame:
    """Seconds since the last frame with one face, or since the start, and whether they pass the limit on a frame without."""
    w = inside(key, order)
    rows = cut(frames, key, order).withColumn("_seg_face", F.when(one_face, F.col(ts)))
    facts = {"_seg_lately": F.max_by("_seg_face", F.when(F.col("_seg_face").isNotNull(), F.struct(*order))), "_seg_start": F.min_by(ts, F.struct(*order))}
    rows = carried(rows, key, facts, {"_seg_last": F.last("_seg_lately", ignorenulls=True).over(before()), "_seg_began": F.first("_seg_start").over(before())})
    last = F.coalesce(F.last("_seg_face", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_seg_last")
    start = F.coalesce("_seg_began", F.first(ts).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.coalesce(last, start).cast("timestamp"))) / 1e6
    return _plain(rows.withColumn("gap_s", gap).withColumn("lost", ~one_face & (gap > limit_s)))


def ctc_collapse(frames: DataFrame, key: str, order: list[str], symbol: str, p: str, blank: str) -> DataFrame:
    """Symbols without blanks and repeats, joined in order, and the mean probability of the frames that stay."""
    w = _w(key, order)
    kept = frames.withColumn("_before", F.lag(symbol).over(w)).where((F.col(symbol) != blank) & ~F.col(symbol).eqNullSafe(F.col("_before")))
    item = F.struct(*order, F.col(symbol).alias("s"))
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]), "").alias("text"), F.avg(p).alias("confidence"))


def best_with_margin(scores: DataFrame, key: str, score: str, name: str) -> DataFrame:
    """The best of each key and its lead over the next."""
    w = Window.partitionBy(key).orderBy(F.desc(score), name)
    out = scores.withColumn("rn", F.row_number().over(w)).withColumn("margin", F.col(score) - F.lead(score).over(w))
    return out.where("rn = 1").drop("rn")


def latest_valid_steps(events: DataFrame, key: str, step: str, order: list[str], invalidates: dict[str, str]) -> DataFrame:
    """The newest result of each step that no later event of its invalidating step has overtaken."""
    w = Window.partitionBy(key, step).orderBy(*(F.desc(o) for o in order))
    at = F.struct(*order)
    newest = events.withColumn("_at", at).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    for over, by in invalidates.items():
        newest = newest.withColumn(f"_{over}", F.max(F.when(F.col(step) == by, F.col("_at"))).over(Window.partitionBy(key)))
    stale = F.lit(False)
    for over in invalidates:
        stale |= (F.col(step) == over) & (F.col(f"_{over}") > F.col("_at"))
    return newest.where(~F.coalesce(stale, F.lit(False))).drop("_at", *(f"_{o}" for o in invalidates))


def attempts(events: DataFrame, key: str, step: str, order: list[str], limit: int) -> DataFrame:
    """Attempts of each step, and the first one past the limit."""
    n = F.row_number().over(Window.partitionBy(key, step).orderBy(*order))
    out = events.withColumn("attempt", n)
    return out.groupBy(key, step).agg(F.max("attempt").alias("attempts"), F.min(F.when(F.col("attempt") > limit, F.col(order[-1]))).alias("first_refused"))


def baseline(frames: DataFrame, key: str, order: list[str], col: str, qualifies: Column, n: int) -> DataFrame:
    """Median of the first n qualifying frames; null where there are fewer."""
    first = frames.where(qualifies).withColumn("rn", F.row_number().over(_w(key, order))).where(F.col("rn") <= n)
    got = first.groupBy(key).agg(F.when(F.count("*") == n, F.median(col)).alias("baseline"))
    return frames.select(key).distinct().join(got, key, "left")


def session_summary(frames: DataFrame, key: str, identity: Column, live: Column, done: Column) -> DataFrame:
    return frames.groupBy(key).agg(F.min(identity).alias("identity_min"), F.median(live).alias("live_median"), F.min(live).alias("live_min"), F.count("*").alias("checks"), F.count_if(done).alias("tasks_done"))


def task_durations(done: DataFrame, key: str, order: list[str], ts: str) -> DataFrame:
    """Seconds between a completion and the one before."""
    w = _w(key, order)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return done.withColumn("took_s", (micros - F.lag(micros).over(w)) / 1e6)


def reap_idle(events: DataFrame, key: str, ts: str, gap_s: int) -> DataFrame:
    """Sessions that a pause of ``gap_s`` closes: batch and stream alike."""
    s = F.session_window(ts, f"{gap_s} seconds")
    return events.groupBy(key, s.alias("s")).agg(F.count("*").alias("events")).select(key, F.col("s.start").alias("began"), F.col("s.end").alias("closes"), "events")


def reap_expired(events: DataFrame, key: str, ts: str, ttl_s: int) -> DataFrame:
    """Sessions end ``ttl_s`` after their first event, whatever follows; they are dropped one time more of that later."""
    out = events.groupBy(key).agg(F.min(ts).alias("began"))
    after = lambda n: F.col("began") + F.make_dt_interval(secs=F.lit(n * ttl_s))
    return out.withColumns({"expires": after(1), "dropped_at": after(2)})


def with_valid_capture(requests: DataFrame, captures: DataFrame, key: str, ts: str, created: str, ttl_s: int) -> DataFrame:
    """Requests whose key's newest capture not after them is not past five times the time to live, with its time.

    A capture serves its own stretch of that length and the next; a key's events are put in order within one stretch.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    stretch = lambda c: F.floor(micros(c) / F.lit(5_000_000 * ttl_s))
    r = requests.withColumns({"_at": micros(ts), "_stretch": stretch(ts)})
    c = captures.where(F.col(created).isNotNull()).groupBy(key, created).agg(F.lit(1).alias("_n"))
    c = c.select(key, created, micros(created).alias("_at"), F.explode(F.array(stretch(created), stretch(created) + 1)).alias("_stretch"), F.lit(True).alias("_capture"))
    w = Window.partitionBy(key, "_stretch").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = r.unionByName(c, allowMissingColumns=True).withColumn(created, F.last(created, ignorenulls=True).over(w))
    return both.where(F.col("_capture").isNull() & (F.col("_at") - micros(created) <= 5_000_000 * ttl_s)).select(*requests.columns, created)
