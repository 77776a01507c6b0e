"""Structured Streaming jobs around the operators."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def reap_idle(events: DataFrame, key: str, ts: str, gap: str = "120 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions that a pause has closed."""
    s = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(key, s.alias("s")).agg(F.count("*").alias("events")).select(key, F.col("s.start").alias("began"), F.col("s.end").alias("closes"), "events")


def drop_duplicate_media(media: DataFrame, content: str, ts: str, delay: str = "10 minutes") -> DataFrame:
    """The first arrival of each content within the delay."""
    return media.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256)).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["sha256"])


def verdict_stream(events: DataFrame, required: tuple[str, ...], reject: tuple[str, ...], reject_warned: tuple[str, ...] = (), ttl_s: int = 1800, watermark: str = "1 minute") -> DataFrame:
    """STR4: events(case_id, at, kind, step, status, decision, score, reasons) -> a verdict for each opened case.

    kind "opened" starts a case; any other row is a step's result, whose ``reasons`` are (code, severity). A case is judged
    when every required step has a result, or its time after opening is over: a step that is missing then asks for a
    human. Results that come once a case is judged change nothing; that it is judged is known for one time more.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    from attesta.operators import decisions

    def run(keys, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else {"opened": None, "results": [], "reasons": [], "judged": False}
        over = held.hasTimedOut
        if over and (state["judged"] or state["opened"] is None):
            held.remove()
            return
        latest = 0
        for pdf in [] if over else parts:
            for e in pdf.sort_values("at_ms").to_dict("records"):
                at = int(e["at_ms"])
                latest = max(latest, at)
                if e["kind"] == "opened":
                    state["opened"] = at if state["opened"] is None else min(at, state["opened"])
                elif state["opened"] is None or at <= state["opened"] + 1000 * ttl_s:
                    score = None if pd.isna(e["score"]) else float(e["score"])
                    state["results"].append({"step": e["step"], "status": e["status"], "decision": e["decision"], "score": score})
                    said = e["reasons"] if e["reasons"] is not None else []
                    state["reasons"] += [{"step": e["step"], "code": q["code"], "severity": q["severity"]} for q in said]
        there = {r["step"] for r in state["results"]}
        ready = state["opened"] is not None and not state["judged"] and (over or set(required) <= there)
        if ready:
            yield pd.DataFrame({"case_id": [keys[0]], "results": [json.dumps(state["results"])], "reasons": [json.dumps(state["reasons"])]})
            state = {"opened": state["opened"], "results": [], "reasons": [], "judged": True}
        held.update((json.dumps(state),))
        begun = latest if state["opened"] is None else state["opened"]
        held.setTimeoutTimestamp(max(held.getCurrentWatermarkMs() + 1, begun + 1000 * ttl_s * (2 if state["judged"] else 1)))

    case = events.schema["case_id"].dataType.simpleString()
    timed = events.withColumn("at_ms", F.unix_millis(F.col("at").cast("timestamp")))
    closed = timed.withWatermark("at", watermark).groupBy("case_id").applyInPandasWithState(run, f"case_id {case}, results string, reasons string", "state string", "append", GroupStateTimeout.EventTimeTimeout)
    gathered = closed.select("case_id", F.from_json("results", decisions.RESULTS).alias("results"), F.from_json("reasons", decisions.REASONS).alias("reasons"))
    return decisions.judge(gathered, required, reject, reject_warned).select("case_id", "verdict", "blocking", "review_score")


def reap_expired(events: DataFrame, key: str, ts: str, ttl_s: int = 120, watermark: str = "1 minute") -> DataFrame:
    """STR6: each session's first event and the time it is dropped at: one time to live after it has expired, whatever came since."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(keys, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            yield pd.DataFrame({key: [keys[0]], "began": [held.get[0]]})
            held.remove()
            return
        first = min(int(pdf["at_ms"].min()) for pdf in parts)
        first = min(first, held.get[0]) if held.exists else first
        held.update((first,))
        held.setTimeoutTimestamp(max(held.getCurrentWatermarkMs() + 1, first + 2000 * ttl_s))

    kind = events.schema[key].dataType.simpleString()
    timed = events.select(key, ts, F.unix_millis(F.col(ts).cast("timestamp")).alias("at_ms")).withWatermark(ts, watermark)
    out = timed.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, began long", "first long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(key, F.timestamp_millis("began").alias("began"), F.timestamp_millis(F.col("began") + 2000 * ttl_s).alias("dropped_at"))


RUNS = "batch long, at double, removed long, failed boolean"


def retention_tick(spark: SparkSession, path: str, purge: Callable[[], int], now: Callable[[], float], every_s: float = 6 * 3600) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: purge at most once in ``every_s``; a failure is logged and never stops the stream.

    The table at ``path`` has a row for each run: when, in which batch, how many it removed, and whether it failed. The row is
    written once the purge is over: a restart, or a batch that is tried again, goes on from the last row, and a purge that
    was cut off is done again.
    """
    import logging

    spark.createDataFrame([], RUNS).write.mode("ignore").parquet(path)

    def tick(batch: DataFrame, number: int) -> None:
        last, at = spark.read.schema(RUNS).parquet(path).agg(F.max("at")).first()[0], now()
        if last is not None and at - last < every_s:
            return
        removed, failed = None, False
        try:
            removed = purge()
        except Exception:
            failed = True
            logging.getLogger(__name__).exception("retention failed in batch %s", number)
        spark.createDataFrame([(number, float(at), removed, failed)], RUNS).coalesce(1).write.mode("append").parquet(path)

    return tick


MARKS = "batch long, latest timestamp, late long"


def late_aside(spark: SparkSession, marks: str, aside: str, ts: str, delay_s: float, then: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows behind the watermark are counted and kept at ``aside``, the others go to ``then``.

    The watermark is the latest time of the batches before, less ``delay_s``, as the engine has it. The table at ``marks`` has a row
    for each batch: its latest time and how many of its rows were late. A batch that is tried again sees the same
    watermark and writes its late rows over. Rows without a time are never late.
    """
    spark.createDataFrame([], MARKS).write.mode("ignore").parquet(marks)

    def run(batch: DataFrame, number: int) -> None:
        seen = spark.read.schema(MARKS).parquet(marks).where(F.col("batch") < number)
        latest = seen.agg(F.max("latest")).first()[0]
        behind = F.lit(False) if latest is None else F.coalesce(F.unix_micros(F.col(ts)) < F.unix_micros(F.lit(latest)) - int(delay_s * 1e6), F.lit(False))
        late = batch.where(behind)
        late.write.mode("overwrite").parquet(f"{aside}/batch={number}")
        then(batch.where(~behind), number)
        row = batch.agg(F.lit(number).cast("long").alias("batch"), F.max(ts).cast("timestamp").alias("latest"), F.count_if(behind).alias("late"))
        row.coalesce(1).write.mode("append").parquet(marks)

    return run
