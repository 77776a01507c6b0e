"""Scans: labelled media, transcripts, annotations, word lists, stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "module string, version string, decision string, score double, reasons array<struct<code:string,severity:string,message_en:string,message_fa:string,field:string>>, data map<string,string>, elapsed_ms double"


def read_labelled_media(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, content, length; the kind is the folder, the label what stands before ``__`` (or the first ``-``) in the name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    name = F.substring_index("path", "/", -1)
    label = F.when(name.contains("__"), F.split_part(name, F.lit("__"), F.lit(1))).otherwise(F.split_part(name, F.lit("-"), F.lit(1)))
    return files.select("path", "content", "length", label.alias("label"), F.split_part("path", F.lit("/"), F.lit(-2)).alias("kind"))


def parse_transcripts(lines: DataFrame, value: str = "value") -> DataFrame:
    """path<TAB>text lines -> path, text (composed, trimmed), bad: not exactly two columns."""
    from attesta.functions.text import nfc

    part = F.split(F.col(value), "\t")
    bad = F.size(part) != 2
    return lines.withColumn("bad", bad).withColumn("path", F.when(~bad, part[0])).withColumn("text", F.when(~bad, F.trim(nfc(part[1]))))


def read_transcripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad lines as they are."""
    rows = parse_transcripts(spark.read.text(path))
    return rows.where("NOT bad").select("path", "text"), rows.where("bad").select("value")


def parse_annotations(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines of a class id and a box (4 numbers) or polygon (an even count of 6 or more) -> class_id, box, problem.

    A class id that is no number is skipped with a warning; odd or short lists are rejected, never guessed at.
    """
    part = F.split(F.trim(F.col(value)), r"\s+")
    cls = F.expr("try_cast(split(trim(value), '\\\\s+')[0] AS int)") if value == "value" else part[0].try_cast("int")
    xs = F.transform(F.slice(part, 2, F.greatest(F.lit(0), F.size(part) - 1)), lambda x: x.try_cast("double"))
    n = F.size(xs)
    broken = F.exists(xs, lambda x: x.isNull())
    problem = F.when(cls.isNull(), "class").when(broken | (n < 4) | (n % 2 == 1), "coordinates")
    even = lambda k: F.filter(xs, lambda x, i: i % 2 == k)
    polygon = F.struct(F.array_min(even(0)).alias("x1"), F.array_min(even(1)).alias("y1"), F.array_max(even(0)).alias("x2"), F.array_max(even(1)).alias("y2"))
    box = F.struct((xs[0] - xs[2] / 2).alias("x1"), (xs[1] - xs[3] / 2).alias("y1"), (xs[0] + xs[2] / 2).alias("x2"), (xs[1] + xs[3] / 2).alias("y2"))
    return lines.select("*", cls.alias("class_id"), F.when(problem.isNull(), F.when(n == 4, box).otherwise(polygon)).alias("box"), problem.alias("problem"))


def read_annotations(spark: SparkSession, folder: str) -> DataFrame:
    lines = spark.read.text(folder, pathGlobFilter="*.txt", recursiveFileLookup=True).withColumn("path", F.col("_metadata.file_path"))
    return parse_annotations(lines.where("trim(value) <> ''"))


def parse_lexicon(lines: DataFrame, line: str, ord_: str, normalise) -> DataFrame:
    """Without blank lines and comments; of words that normalise alike the first."""
    words = lines.where((F.trim(line) != "") & ~F.ltrim(line).startswith("#")).select(F.col(ord_).alias("ord"), normalise(F.col(line)).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.min("ord").alias("ord"))


def parse_results(stored: DataFrame, col: str) -> DataFrame:
    """Stored result envelopes -> columns, a row for each reason (one with nulls where there is none)."""
    out = stored.withColumn("r", F.from_json(F.col(col), RESULT))
    return out.select(*stored.columns, "r.module", "r.decision", "r.score", F.explode_outer("r.reasons").alias("reason")).select(*stored.columns, "module", "decision", "score", "reason.code", "reason.severity")


def digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)
