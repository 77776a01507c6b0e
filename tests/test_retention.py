"""The retention clock of a stream: at most one purge an interval, over restarts, failures and cut-off runs."""

import pytest

from attesta.streaming import flows


def test_restarts_and_failures(spark, tmp_path):
    clock, purged = {"now": 1000.0}, []
    fails = {"next": False}

    def purge():
        if fails["next"]:
            raise OSError("store is away")
        purged.append(clock["now"])
        return 3

    def batch(text):
        """One file, one batch of a query that begins anew each time from its checkpoint."""
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("append").text(str(tmp_path / "in"))
        stream = spark.readStream.text(str(tmp_path / "in"))
        tick = flows.retention_tick(spark, str(tmp_path / "runs"), purge, lambda: clock["now"], 100.0)
        q = stream.writeStream.foreachBatch(tick).option("checkpointLocation", str(tmp_path / "ck")).start()
        q.processAllAvailable()
        q.stop()

    batch("a")
    batch("b")
    assert purged == [1000.0]
    clock["now"] = 1100.0
    fails["next"] = True
    batch("c")  # fails, and the stream goes on; not tried again before its time
    fails["next"] = False
    clock["now"] = 1199.0
    batch("d")
    assert purged == [1000.0]
    clock["now"] = 1200.0
    batch("e")
    assert purged == [1000.0, 1200.0]
    rows = sorted((r["batch"], r["at"], r["removed"], r["failed"]) for r in spark.read.parquet(str(tmp_path / "runs")).collect())
    assert rows == [(0, 1000.0, 3, False), (2, 1100.0, None, True), (4, 1200.0, 3, False)]


def test_a_purge_that_was_cut_off_is_done_again(spark, tmp_path):
    def cut_off():
        raise KeyboardInterrupt

    tick = flows.retention_tick(spark, str(tmp_path / "runs"), cut_off, lambda: 5.0, 100.0)
    with pytest.raises(KeyboardInterrupt):
        tick(spark.range(1), 0)
    done = []
    flows.retention_tick(spark, str(tmp_path / "runs"), lambda: done.append(1) or 1, lambda: 6.0, 100.0)(spark.range(1), 0)
    assert done == [1] and spark.read.parquet(str(tmp_path / "runs")).count() == 1
