"""Curating labelled samples: pairing, splitting, capping, deduplication, coverage. Random order is a hash of key and seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Parts that a stratum is ranked in first; rows that may be put in order at once.
PARTS, FEW = 64, 100_000


def shuffle_key(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def pair_media(images: DataFrame, labels: DataFrame, key: str, drop_unlabelled: bool = False) -> DataFrame:
    return images.join(labels, key, "inner" if drop_unlabelled else "left")


def stratified_cap(df: DataFrame, strata: str, key: str, total: int, seed: int) -> DataFrame:
    """At most an even share of ``total`` from each stratum, one at least: those first in the order of a hash.

    A stratum's rows are ranked in parts first, of which each keeps a share's worth; so no task orders a whole stratum.
    """
    n = df.agg(F.countDistinct(strata) + F.max(F.col(strata).isNull().cast("int"))).first()[0]
    cap = max(1, total // max(1, n or 0))
    order = (shuffle_key(key, seed), F.col(key))
    part = F.pmod(F.xxhash64(key), F.lit(PARTS))
    in_part = F.row_number().over(Window.partitionBy(strata, part).orderBy(*order))
    rank = F.row_number().over(Window.partitionBy(strata).orderBy(*order))
    few = df.withColumn("_rn", in_part).where(F.col("_rn") <= cap).drop("_rn")
    return few.withColumn("_rn", rank).where(F.col("_rn") <= cap).drop("_rn")


def holdout_groups(df: DataFrame, group: str, share: float, seed: int) -> DataFrame:
    """Whole groups are held out: a rounded share, one at least, none of fewer than four groups."""
    groups = df.where(F.col(group).isNotNull()).select(group).distinct()
    n = groups.count()
    take = 0 if n < 4 else max(1, round(n * share))
    held = groups.orderBy(shuffle_key(group, seed), group).limit(take).withColumn("held_out", F.lit(True))
    return df.join(held, group, "left").withColumn("held_out", F.coalesce("held_out", F.lit(False)))


def _place(order: DataFrame, rank: int) -> tuple | None:
    """order(h, k): the row that is ``rank``-th by (h, k), from 1. Counts by the next digits of h narrow it down to a few rows."""
    begin, done = "", 0
    inside = order
    while True:
        at = len(begin)
        counts = inside.groupBy(F.substring("h", at + 1, 3).alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()  # 4096 rows at most
        for c in counts:
            if done + c["n"] >= rank:
                begin += c["d"]
                break
            done += c["n"]
        inside = order.where(F.col("h").startswith(begin))
        if c["n"] <= FEW or len(begin) >= 30:
            return tuple(inside.orderBy("h", "k").limit(rank - done).collect()[-1])


def split_dataset(df: DataFrame, key: str, val: float, test: float, seed: int) -> DataFrame:
    """Exact counts in hash order: first int(n * val) rows for validation, the next int(n * test) for test, the rest to train.

    Two cut-off hashes are found from counts by their digits; the rows themselves are only compared with them. Rows of
    one key go together; a null key goes to train.
    """
    n = df.count()
    nv, nt = int(n * val), int(n * test)
    order = df.where(F.col(key).isNotNull()).select(shuffle_key(key, seed).alias("h"), F.col(key).alias("k"))
    most = order.count()
    at = {m: _place(order, m) for m in {min(nv, most), min(nv + nt, most)} if m}
    mine = F.struct(shuffle_key(key, seed).alias("h"), F.col(key).alias("k"))
    upto = lambda m: F.coalesce(mine <= F.struct(F.lit(at[m][0]).alias("h"), F.lit(at[m][1]).alias("k")), F.lit(False)) & F.col(key).isNotNull() if m else F.lit(False)
    return df.withColumn("split", F.when(upto(min(nv, most)), "val").when(upto(min(nv + nt, most)), "test").otherwise("train"))


def sample_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return df.orderBy(shuffle_key(key, seed), key).limit(n)


def dedup_content(df: DataFrame, content: str, key: str) -> DataFrame:
    """The first row by key of equal contents. Found by a grouped minimum: no group meets in one task."""
    digest = F.sha2(F.col(content).cast("binary"), 256)
    return df.withColumn("sha256", digest).groupBy("sha256").agg(F.min(key).alias(key), F.count("*").alias("copies"))


def class_counts(labels: DataFrame, col: str, classes: DataFrame) -> DataFrame:
    """A count for every class, also 0."""
    n = labels.groupBy(col).agg(F.count("*").alias("n"))
    return classes.join(n, col, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def charset(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.explode(F.array_distinct(F.split(text, ""))).alias("ch")).where("ch <> ''").distinct()


def uncovered_chars(df: DataFrame, text: str, known: str) -> DataFrame:
    """Characters outside ``known``, and how often they stand."""
    left = F.translate(F.col(text), known, "")
    return df.select(F.explode(F.split(left, "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))


def exclude_used(df: DataFrame, key: str, *rounds: DataFrame) -> DataFrame:
    used = None
    for r in rounds:
        used = r.select(key) if used is None else used.union(r.select(key))
    return df if used is None else df.join(used, key, "left_anti")


def combine_rounds(*rounds: DataFrame) -> DataFrame:
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def unknown_values(df: DataFrame, col: str, known: DataFrame) -> DataFrame:
    return df.select(col).distinct().join(known.select(col), col, "left_anti")


def missing_files(listing: DataFrame, files: DataFrame, key: str) -> DataFrame:
    return listing.join(files.select(key), key, "left_anti")


def fixity_audit(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """manifest(name, sha256), files(name, actual): missing, unrecorded, mismatch or ok."""
    both = manifest.join(files, "name", "full")
    return both.select("name", F.when(F.col("actual").isNull(), "missing").when(F.col("sha256").isNull(), "unrecorded").when(F.col("sha256") != F.col("actual"), "mismatch").otherwise("ok").alias("state"))


def main_face(faces: DataFrame, image: str, area: Column, height: str, order: str, least: float) -> DataFrame:
    """Of each image the largest face, and how many others have at least a share of its height."""
    w = Window.partitionBy(image).orderBy(F.desc("_area"), order)
    out = faces.withColumn("_area", area).withColumn("rn", F.row_number().over(w)).withColumn("_top", F.first(height).over(w))
    return out.groupBy(image).agg(F.max(F.when(F.col("rn") == 1, F.col(order))).alias("main"), F.count_if((F.col("rn") > 1) & (F.col(height) >= least * F.col("_top"))).alias("others"))


def best_per_class(det: DataFrame, keys: list[str], confidence: str, arrival: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(confidence), arrival))
    return det.withColumn("rn", rank).where("rn = 1").drop("rn")


def ring_donor(df: DataFrame, key: str, group: str) -> DataFrame:
    """Each row with the key of the next in its group; the last gets the first. A null group is a group of its own.

    Rows are dealt to ranges of (group, key), neighbours are sought inside a range; only the first key of each range,
    one row for each range that a group has, meets the others of its group.
    """
    from attesta.sources.scratch import written

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(n, F.col(group).asc_nulls_first(), F.col(key).asc_nulls_first()).withColumn("_range", F.spark_partition_id()), "ring")
    firsts = dealt.groupBy(group, "_range").agg(F.min(key).alias("_first"))
    ring = Window.partitionBy(group)
    ends = firsts.withColumn("_next", F.coalesce(F.lead("_first").over(ring.orderBy("_range")), F.min("_first").over(ring))).select(F.col(group).alias("_group"), F.col("_range").alias("_of"), "_next")
    near = dealt.withColumn("_near", F.lead(key).over(Window.partitionBy(group, "_range").orderBy(key)))
    both = near.join(ends, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of")), "left")
    return both.select(*df.columns, F.coalesce("_near", "_next").alias("donor"))


def expired_days(df: DataFrame, day: str, today: Column, keep: int) -> DataFrame:
    """Days older than ``keep`` days before ``today``; names that are no dates stay."""
    d = F.try_to_date(day, "yyyy-MM-dd")
    return df.select(day).distinct().where(d < F.date_sub(today, keep))


def merge_split_aliases(df: DataFrame, split: str, aliases: dict[str, list[str]]) -> DataFrame:
    """Rows whose split has an alias get its name; of several spellings that are there, only the first listed counts."""
    there = {r[0] for r in df.select(split).distinct().collect()}
    keep = {name: next((a for a in names if a in there), None) for name, names in aliases.items()}
    out = df.where(~F.col(split).isin([a for n, names in aliases.items() for a in names if a != keep[n]] or [""]))
    for name, a in keep.items():
        out = out.withColumn(split, F.when(F.col(split) == a, name).otherwise(F.col(split)))
    return out
