"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.shared import drop_table, join_classes, write_table


def _star(edges: DataFrame, total: int, large: bool) -> DataFrame:
    """large: each larger neighbour of a node is tied to the smallest one; small: each smaller or equal one."""
    sides = edges.select("a", "b")
    if large:
        sides = sides.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = sides.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m"))
    tied = join_classes(sides, least, "a", total)
    if large:
        return tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """Rows of (a, b) -> node, root: the smallest node that each node with a link reaches.

    Self-links are ignored; repeated links count once; an empty table gives an empty one.
    """
    edges = write_table(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        total, mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (total, mark) == before or not total:
            break
        before = (total, mark)
        big = _star(edges, 2 * total, True).where("a <> b").distinct()
        new = write_table(_star(big, total, False).where("a <> b").distinct(), "links")
        drop_table(edges)
        edges = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
