"""SRC1, SRC3: folders of labelled files as a data source that lists only the folders a query asks for.

Files lie in ``root/kind/name``, or ``root/split/kind/name`` with the option ``splits``. The driver lists those folders;
their files are listed by tasks, each folder by ``slices`` of them, so that a folder with most files isn't one task.
Equality and lists of values for kind and split reach the listing where ``spark.sql.python.filterPushdown.enabled`` is
true; otherwise all folders are read, with the same rows.

Defined results: a file that can't be read, or whose name has no label, is a row with a ``problem``; an empty file is
read; an empty root gives no rows; files beside the folders are no media.
"""

from __future__ import annotations

import fnmatch
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

NAME = "labelled_media"
SCHEMA = "split string, kind string, label string, path string, length long, content binary, problem string"


def label_of(name: str) -> str:
    """What stands before ``__`` in a file's name, or before the first ``-``."""
    return name.split("__" if "__" in name else "-")[0]


@dataclass
class Folder(InputPartition):
    """A share of a folder's files."""

    split: str | None
    kind: str
    path: str
    number: int


class MediaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.glob = options["path"].rstrip("/"), options.get("glob", "*")
        self.slices, self.splits = int(options.get("slices", "8")), options.get("splits", "false") == "true"
        self.only: dict[str, set] = {}

    def _folders(self, path: str, column: str) -> list[str]:
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(path)
        names = sorted(e.base_name for e in files.get_file_info(fs.FileSelector(at, allow_not_found=True)) if e.type == fs.FileType.Directory)
        return [n for n in names if column not in self.only or n in self.only[column]]

    def partitions(self) -> list[Folder]:
        if not self.splits and "split" in self.only:
            return []  # no file has a split
        tops = [(s, f"{self.root}/{s}") for s in self._folders(self.root, "split")] if self.splits else [(None, self.root)]
        return [Folder(s, k, f"{top}/{k}", i) for s, top in tops for k in self._folders(top, "kind") for i in range(self.slices)]

    def read(self, part: Folder | None) -> Iterator[tuple]:
        from pyarrow import fs

        if part is None:
            return  # no folder is asked for
        files, at = fs.FileSystem.from_uri(part.path)
        for e in files.get_file_info(fs.FileSelector(at)):
            if e.type == fs.FileType.File and fnmatch.fnmatch(e.base_name, self.glob) and zlib.crc32(e.base_name.encode()) % self.slices == part.number:
                label, content, problem = label_of(e.base_name), None, None
                try:
                    with files.open_input_stream(e.path) as f:
                        content = f.read()
                except OSError as error:
                    problem = f"unreadable: {type(error).__name__}"
                if not label:
                    label, problem = None, problem or "no label"
                yield part.split, part.kind, label, f"{part.path}/{e.base_name}", e.size, content, problem


class PruningReader(MediaReader):
    """Only where the session pushes filters: elsewhere the engine refuses a reader that takes them."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column in ("kind", "split"):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[column] = self.only.get(column, wanted) & wanted
            else:
                yield f


class LabelledMedia(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaReader:
        return (PruningReader if self.options.get("push", "false") == "true" else MediaReader)(dict(self.options))


def read_media(spark: SparkSession, root: str, glob: str = "*", splits: bool = False, slices: int = 8) -> DataFrame:
    """SRC1: split, kind, label, path, length, content, problem. ``root`` is a URI or an absolute path."""
    spark.dataSource.register(LabelledMedia)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(NAME).options(glob=glob, splits=str(splits).lower(), slices=slices, push=push).load(root)


def read_annotated(spark: SparkSession, root: str, splits: bool = False, slices: int = 8) -> DataFrame:
    """SRC3: lines of annotation files with their class, box and problem; an unreadable file is one row, with its problem."""
    from attesta.sources.readers import parse_annotations

    files = read_media(spark, root, "*.txt", splits, slices)
    cut = F.split(F.decode("content", "UTF-8"), r"\r?\n")
    lines = files.select("split", "kind", "path", F.col("problem").alias("_broken"), F.explode_outer(cut).alias("value"))
    broken = F.col("_broken").startswith("unreadable")
    read = parse_annotations(lines.where("trim(value) <> '' OR startswith(_broken, 'unreadable')"))
    return read.withColumn("problem", F.when(broken, F.col("_broken")).otherwise(F.col("problem"))).drop("_broken")
