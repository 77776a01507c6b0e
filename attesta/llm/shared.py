"""Where jobs cut lineage, and how tasks exchange packed records."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset and all tasks run on this machine (tests), one of our own.

    On a cluster a machine's own folder would lose rows without a sign: there an unset folder raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="attesta-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here.

    The files outlive executors, so a lost one costs only the tasks it was running.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._attesta_path = path
    return back


def drop_table(df: DataFrame) -> None:
    """Delete a table of ``write_table`` that no later step reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._attesta_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_buckets(spark: SparkSession) -> int:
    """Buckets that packed records are dealt to: some for each shuffle partition, so they even out."""
    return 4 * partitions(spark)


BLOB = "bucket int, kind int, data binary"
BLOB_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])


def pack(records: np.ndarray, bucket: np.ndarray, kind: int = 0) -> pa.RecordBatch:
    """One row for each bucket that has records: its records' bytes."""
    order = np.argsort(bucket, kind="stable")
    records, bucket = records[order], bucket[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, int)
    ends = np.r_[starts[1:], len(bucket)] if len(starts) else starts
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[starts], pa.int32()),
            pa.array(np.full(len(starts), kind), pa.int32()),
            pa.array([records[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
        ],
        schema=BLOB_ARROW,
    )


def unpack(column: pa.ChunkedArray | pa.Array, dtype: np.dtype) -> np.ndarray:
    """All records of a column of packed records."""
    parts = [np.frombuffer(x.as_buffer(), dtype) for x in column if x.is_valid]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


class Packer:
    """Gathers records and hands out packed batches whenever ``limit`` of them are there."""

    def __init__(self, dtype: np.dtype, buckets: int, key: str, kind: int = 0, limit: int = 400_000, reduce: Callable | None = None):
        self.dtype, self.buckets, self.key, self.kind, self.limit, self.reduce = dtype, buckets, key, kind, limit, reduce
        self.parts: list[np.ndarray] = []
        self.n = 0

    def add(self, records: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(records)
        self.n += len(records)
        if self.n >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            records = np.concatenate(self.parts)
            if self.reduce:
                records = self.reduce(records)
            yield pack(records, (records[self.key] % np.uint64(self.buckets)).astype(np.int32), self.kind)
        self.parts, self.n = [], 0


def join_classes(rows: DataFrame, classes: DataFrame, key: str, total: int) -> DataFrame:
    """Left join of ``rows`` with one row for each key in ``classes``, whose column n says how many rows have the key.

    Keys with a thousandth of ``total`` or more number at most a thousand: they are broadcast.
    The rest is joined by key, so that no task gets more than a thousandth for one key.
    """
    from pyspark.sql import functions as F

    many = F.lit(max(2, total // 1000))
    values = [c for c in classes.columns if c not in (key, "n")]
    hot = classes.where(F.col("n") >= many).select(key, F.lit(True).alias("_hot"), *(F.col(c).alias(f"_hot_{c}") for c in values))
    cold = classes.where(F.col("n") < many).select(F.col(key).cast("string").alias("_key"), *(F.col(c).alias(f"_cold_{c}") for c in values))
    out = rows.join(F.broadcast(hot), key, "left")
    # rows that have their class by now get a key of their own, which deals them out by chance
    own = F.concat(F.lit("#"), F.xxhash64(*rows.columns).cast("string"))
    out = out.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key).cast("string")).otherwise(own)).join(cold, "_key", "left")
    return out.select(*rows.columns, *(F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in values))


#: Bits of the bitmap of ``may_be_in``: 2 ** ROW_BITS at most.
ROW_BITS = 27


def may_be_in(df: DataFrame, column: str, among: DataFrame, mark: str | None = None) -> DataFrame:
    """The rows of ``df`` whose long in ``column`` may be in ``among``, a table of that column alone; with ``mark`` all rows, and whether they may.

    A bitmap of 16 bits for each value, up to ``ROW_BITS``, is broadcast: no value is missed, a few others come through.
    """
    from pyspark.sql import functions as F

    size = 1 << min(ROW_BITS, max(15, (16 * among.count()).bit_length()))
    bit = F.pmod(F.xxhash64(F.col(f"`{column}`")), F.lit(size)) + 1
    bits, part, found = "attesta bits", "attesta part", mark or "attesta mark"
    # dealt out before they are summed up: else every task sends bitmaps of its own
    rows = among.select(F.bitmap_bucket_number(bit).alias(part), F.bitmap_bit_position(bit).alias("at")).repartition(part)
    table = rows.groupBy(part).agg(F.bitmap_construct_agg("at").alias(bits))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.col(f"`{bits}`").substr((F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))
    out = df.withColumn(part, F.bitmap_bucket_number(bit)).join(F.broadcast(table), part, "left").withColumn(found, is_set).drop(part, bits)
    return out if mark else out.where(F.col(f"`{found}`")).drop(found)
