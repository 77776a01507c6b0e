"""SNK1 from a stream: sealed cases go to the archive once each, in two phases.

Tasks write what they got to files beside the archive. The commit of a batch first writes down which files it will
make, then moves them to their days, then marks the batch as done. A batch that is tried again after a failure finds
the mark and stops, or takes back what the earlier try had moved and goes on.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming.query import StreamingQuery

NAME = "case_archive"


@dataclass
class Staged(WriterCommitMessage):
    """The files of a task: (where it is, its day)."""

    files: list[tuple[str, str]]


class ArchiveWriter(DataSourceStreamWriter):
    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root)

    def write(self, rows: Iterator) -> Staged:
        import pyarrow as pa
        import pyarrow.parquet as pq

        files, root = self._fs()
        files.create_dir(f"{root}/_staged")
        kind = pa.schema([("case_id", pa.string()), ("payload", pa.binary())])
        held: dict[str, list] = {}
        out: dict[str, tuple] = {}

        def flush(day: str) -> None:
            if day not in out:
                at = f"{root}/_staged/{uuid.uuid4().hex}.parquet"
                out[day] = (at, pq.ParquetWriter(at, kind, filesystem=files))
            out[day][1].write_table(pa.Table.from_pylist(held.pop(day), kind))

        for r in rows:
            day = str(r["day"])
            held.setdefault(day, []).append({"case_id": None if r["case_id"] is None else str(r["case_id"]), "payload": None if r["payload"] is None else bytes(r["payload"])})
            if len(held[day]) >= 1000:
                flush(day)
        for day in list(held):
            flush(day)
        for _, w in out.values():
            w.close()
        return Staged([(at, day) for day, (at, _) in out.items()])

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        from pyarrow import fs

        files, root = self._fs()
        files.create_dir(f"{root}/_batches")
        done, plan = f"{root}/_batches/{batchId}.done", f"{root}/_batches/{batchId}.plan"
        there = lambda at: files.get_file_info(at).type != fs.FileType.NotFound
        if there(done):
            return self.abort(messages, batchId)
        if there(plan):
            with files.open_input_stream(plan) as f:
                for at in json.loads(f.read()):
                    if there(at):
                        files.delete_file(at)
        moves = [(at, f"{root}/day={day}/batch-{batchId}-{uuid.uuid4().hex}.parquet") for m in messages if m for at, day in m.files]
        self._put(files, plan, json.dumps([to for _, to in moves]))
        for at, to in moves:
            files.create_dir(to.rsplit("/", 1)[0])
            files.move(at, to)
        self._put(files, done, "")

    @staticmethod
    def _put(files, at: str, text: str) -> None:
        """A file that is there as a whole or not at all."""
        with files.open_output_stream(f"{at}.new") as f:
            f.write(text.encode())
        files.move(f"{at}.new", at)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        from pyarrow import fs

        files, _ = self._fs()
        for m in messages:
            for at, _ in m.files if m else []:
                if files.get_file_info(at).type != fs.FileType.NotFound:
                    files.delete_file(at)


class CaseArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "case_id string, day string, payload binary"

    def streamWriter(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def archive_stream(sealed: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Start the stream of ``archive.sealed`` rows to the archive at ``path`` (a URI or an absolute path)."""
    spark: SparkSession = sealed.sparkSession
    spark.dataSource.register(CaseArchive)
    return sealed.writeStream.format(NAME).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start(path)
