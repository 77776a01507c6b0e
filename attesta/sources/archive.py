"""A date-partitioned encrypted archive of finished cases, reports, splits and fitted references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sealed(cases: DataFrame, payload: Column, key: Column, day: Column) -> DataFrame:
    """case_id, day, payload: unreadable without the key."""
    return cases.select("case_id", day.cast("string").alias("day"), F.aes_encrypt(payload, key, F.lit("GCM")).alias("payload"))


def archive_cases(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).partitionBy("day").parquet(path)


def list_archive(archive: DataFrame) -> DataFrame:
    return archive.groupBy("day").agg(F.countDistinct("case_id").alias("cases")).orderBy("day")


def open_case(archive: DataFrame, case_id, key: Column) -> bytes:
    """The payload of one case; an unknown case or a wrong key raises."""
    rows = archive.where(F.col("case_id") == case_id).select(F.try_aes_decrypt("payload", key, F.lit("GCM")).alias("p")).limit(1).collect()
    if not rows:
        raise KeyError(f"no case {case_id}")
    if rows[0]["p"] is None:
        raise ValueError("the key doesn't open the case")
    return bytes(rows[0]["p"])


def purge(spark: SparkSession, path: str, today: str, keep: int) -> int:
    """Delete whole days strictly older than ``keep`` days before today; folders that are no dates stay."""
    from datetime import date, timedelta

    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    limit, gone = date.fromisoformat(today) - timedelta(days=keep), 0
    for entry in fs.listStatus(root):
        name = entry.getPath().getName().removeprefix("day=")
        try:
            old = date.fromisoformat(name) < limit
        except ValueError:
            continue
        if old and fs.delete(entry.getPath(), True):
            gone += 1
    return gone


def report_columns(dfs: list[DataFrame]) -> DataFrame:
    """All rows with the union of all columns, lists joined by ``;``."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.select(*(F.array_join(c, ";").alias(c) if t.startswith("array") else F.col(c) for c, t in out.dtypes))


def write_report(dfs: list[DataFrame], path: str) -> None:
    report_columns(dfs).write.mode("overwrite").csv(path, header=True)


def export_splits(df: DataFrame, path: str, classes: list, col: str) -> DataFrame:
    """Write by split; a class without rows raises. Returns counts by split and class."""
    counts = df.groupBy("split", col).agg(F.count("*").alias("n"))
    there = {r[0] for r in df.select(col).where(F.col(col).isin(classes)).distinct().collect()}
    if lacking := sorted(set(classes) - there, key=str):
        raise ValueError(f"no rows of class {lacking}")
    df.write.mode("overwrite").partitionBy("split").parquet(path)
    return counts


def save_reference(reference: DataFrame, path: str, version: str) -> None:
    reference.withColumn("version", F.lit(version)).write.mode("overwrite").partitionBy("version").option("partitionOverwriteMode", "dynamic").parquet(path)


def load_reference(spark: SparkSession, path: str, version: str) -> DataFrame:
    """An absent or empty reference raises: nothing passes without one."""
    out = spark.read.parquet(path).where(F.col("version") == version)
    if out.isEmpty():
        raise LookupError(f"no reference of version {version}")
    return out
