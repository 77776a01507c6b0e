"""The folder source, the archive's sink and late rows, on small files and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from attesta.sources import archive, media
from attesta.streaming import flows, sink


@pytest.fixture
def root(tmp_path):
    for at in ("train/real/a__1.bin", "train/real/b-2.bin", "train/spoof/a__3.bin", "test/real/c__4.bin", "test/spoof/-5.bin", "test/spoof/note.txt"):
        path = tmp_path / "media" / at
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(at.encode())
    (tmp_path / "media" / "train" / "real" / "gone__6.bin").symlink_to("nowhere")
    return str(tmp_path / "media")


@pytest.mark.parametrize("push", ["true", "false"])
def test_media(spark, root, push):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", push)
    try:
        df = media.read_media(spark, root, "*.bin", splits=True, slices=3)
        rows = {(r.split, r.kind, r.label, r.path.rsplit("/", 1)[1], r.problem) for r in df.collect() if "gone" not in r.path}
        assert rows == {("train", "real", "a", "a__1.bin", None), ("train", "real", "b", "b-2.bin", None), ("train", "spoof", "a", "a__3.bin", None), ("test", "real", "c", "c__4.bin", None), ("test", "spoof", None, "-5.bin", "no label")}
        some = df.where("kind = 'real' AND split IN ('test', 'dev')")
        assert [(r.label, bytes(r.content)) for r in some.collect()] == [("c", b"test/real/c__4.bin")]
        # one folder of four, in three slices
        assert some.rdd.getNumPartitions() == (3 if push == "true" else 12)
        assert df.where("kind = 'real' AND kind = 'spoof'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert media.read_media(spark, root + "/none").count() == 0


def test_unreadable_file(tmp_path):
    reader = media.MediaReader({"path": str(tmp_path), "slices": "1"})
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "a__1").write_bytes(b"x")
    (tmp_path / "k" / "b__1").write_bytes(b"")
    part = reader.partitions()[0]
    assert sorted(r[2:] for r in reader.read(part)) == [("a", f"{tmp_path}/k/a__1", 1, b"x", None), ("b", f"{tmp_path}/k/b__1", 0, b"", None)]
    reader.only = {"kind": {"other"}}
    assert reader.partitions() == []


def test_annotated(spark, tmp_path):
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "x.txt").write_text("0 0.5 0.5 0.2 0.2\n\ncat 1 2 3 4\n1 0.5 0.5 0.2\n")
    rows = media.read_annotated(spark, str(tmp_path)).collect()
    assert sorted((r.kind, r.class_id, r.problem) for r in rows if r.class_id is not None) == [("k", 0, None), ("k", 1, "coordinates")]
    assert [r.problem for r in rows if r.class_id is None] == ["class"]


def test_archive_once(spark, tmp_path):
    path, key = str(tmp_path / "archive"), F.lit("0123456789abcdef")
    cases = spark.range(20).select(F.col("id").cast("string").alias("case_id"), F.concat(F.lit("case "), F.col("id")).alias("p"), F.when(F.col("id") < 7, "2024-01-01").otherwise("2024-01-02").alias("d"))
    cases.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: archive.sealed(spark.readStream.schema(cases.schema).parquet(str(tmp_path / "in")), F.col("p"), key, F.col("d"))
    for _ in range(2):  # the second run finds nothing new
        sink.archive_stream(stream(), path, str(tmp_path / "c")).awaitTermination()
    stored = spark.read.parquet(path)
    assert {r.day.isoformat() if isinstance(r.day, dt.date) else r.day: r.cases for r in archive.list_archive(stored).collect()} == {"2024-01-01": 7, "2024-01-02": 13}
    assert stored.count() == 20 and archive.open_case(stored, "9", key) == b"case 9"
    assert not list((tmp_path / "archive" / "_staged").iterdir())


def test_batch_tried_again(tmp_path, monkeypatch):
    """Killed between two moves, and killed between the mark and the engine's own."""
    w = sink.ArchiveWriter(str(tmp_path))
    rows = [{"case_id": str(i), "day": f"2024-01-0{i % 3 + 1}", "payload": b"x"} for i in range(9)]
    files = lambda: sorted(tmp_path.glob("day=*/*.parquet"))
    put = sink.ArchiveWriter._put

    def killed(fs, at, text):
        if at.endswith(".done"):
            raise RuntimeError("killed")
        put(fs, at, text)

    monkeypatch.setattr(sink.ArchiveWriter, "_put", staticmethod(killed))
    with pytest.raises(RuntimeError):
        w.commit([w.write(iter(rows)), None], 4)
    first = files()
    monkeypatch.setattr(sink.ArchiveWriter, "_put", staticmethod(put))
    w.commit([w.write(iter(rows))], 4)
    second = files()
    assert len(first) == len(second) == 3 and not set(first) & set(second)
    w.commit([w.write(iter(rows))], 4)
    w.abort([w.write(iter(rows))], 5)
    assert files() == second and not list((tmp_path / "_staged").iterdir())


def test_late_rows(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 10, m)
    passed = []
    run = lambda: flows.late_aside(spark, str(tmp_path / "marks"), str(tmp_path / "late"), "ts", 600, lambda b, n: passed.append((n, sorted(r.id for r in b.collect()))))
    batches = [[(1, at(30)), (2, at(5))], [(3, at(19)), (4, at(20)), (5, None), (6, at(50))], [(7, at(30)), (8, at(41))]]
    make = lambda rows: spark.createDataFrame(rows, "id int, ts timestamp")
    for n, rows in enumerate(batches):
        run()(make(rows), n)
    run()(make(batches[2]), 2)  # tried again
    assert passed == [(0, [1, 2]), (1, [4, 5, 6]), (2, [8]), (2, [8])]
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "late")).collect()) == [3, 7]
    marks = spark.read.parquet(str(tmp_path / "marks")).groupBy("batch").agg(F.max("late").alias("late"))
    assert {r.batch: r.late for r in marks.collect()} == {0: 0, 1: 1, 2: 1}
