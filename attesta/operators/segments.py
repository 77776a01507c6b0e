"""Running values of ordered rows of a key, however many of all rows the key has.

Ranges of (key, order) are the segments: a key with many rows has several, each in a task of its own. A segment is
summed up in one row; what the segments before it come to is added to the running values inside it.

Defined results: rows of a null key are one key's; empty tables stay empty; other columns are kept (names that begin
with ``_seg_`` are taken). The order must tell all rows of a key apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from attesta.sources.scratch import written

SEGMENT = "_seg_no"


def cut(frames: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows with the number of their segment, written once: both of its uses must see the same ranges."""
    return written(frames.repartitionByRange(key, *order).withColumn(SEGMENT, F.spark_partition_id()), "segments")


def inside(key: str, order: list[str]) -> WindowSpec:
    return Window.partitionBy(key, SEGMENT).orderBy(*order)


def up_to(*keys: str) -> WindowSpec:
    """The segments up to this one."""
    return Window.partitionBy("_seg_key", *keys).orderBy("_seg_at").rowsBetween(Window.unboundedPreceding, 0)


def before() -> WindowSpec:
    """The segments of a key before this one."""
    return Window.partitionBy("_seg_key").orderBy("_seg_at").rowsBetween(Window.unboundedPreceding, -1)


def carried(rows: DataFrame, key: str, facts: dict[str, Column], *earlier: dict[str, Column]) -> DataFrame:
    """Rows beside what the segments before theirs come to: null in a key's first segment.

    ``facts`` sum up a segment, each of ``earlier`` adds columns to those by windows over segments; the last one's stay.
    A range continues at most one key of the range before it, so fewer rows are broadcast than there are partitions.
    """
    parts = rows.groupBy(F.col(key).alias("_seg_key"), F.col(SEGMENT).alias("_seg_at")).agg(*(c.alias(n) for n, c in facts.items()))
    for columns in earlier:
        parts = parts.withColumns(columns)
    later = parts.withColumn("_seg_later", F.count("*").over(before())).where("_seg_later > 0").select("_seg_key", "_seg_at", *earlier[-1])
    out = rows.join(F.broadcast(later), F.col(key).eqNullSafe(F.col("_seg_key")) & (F.col(SEGMENT) == F.col("_seg_at")), "left")
    return out.drop("_seg_key", "_seg_at")
