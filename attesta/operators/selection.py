"""Exact quantiles and ranks of groups of any size, without a group's values in one buffer.

``quantile`` narrows all groups at once. Each round cuts a group's distinct values
by some hundred pivots, taken from a sketch of bounded size, sums the counts between
pivots, and goes on with the one interval that has the wanted rank. The sums are
exact, so a poor pivot costs a round and nothing else; distinct values have no ties,
so every round leaves about one in ``PIVOTS`` of them. ``below`` gives what a running
sum over a group would, from range partitions, their totals, and sums inside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.sources.scratch import written

#: Intervals a round cuts a group into; distinct values of a group that one task may order; rows of a table told to all tasks.
PIVOTS, SMALL, FEW = 256, 4096, 10_000


def few(df: DataFrame, name: str) -> DataFrame:
    """``df`` made once, and broadcast if it has no more than FEW rows."""
    made = written(df, name)
    return F.broadcast(made) if made.count() <= FEW else made


def counted(df: DataFrame, keys: list[str], value: str, times=None) -> DataFrame:
    """How often each group has each value that isn't null, as _n, made once."""
    n = F.count("*") if times is None else F.sum(times)
    return written(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("_n")), "value-counts")


def _same(a: str, b: str, keys: list[str]):
    out = F.lit(True)
    for k in keys:
        out &= F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`"))
    return out


def quantile(counts: DataFrame, keys: list[str], value: str, share: float, name: str, n: str | None = None) -> DataFrame:
    """A written table of ``counted`` -> the groups' interpolated quantile, and n, the number of their values."""
    at = [F.col(k) for k in keys]
    groups = counts.groupBy(*at).agg(F.sum("_n").alias("_all"), F.count("*").alias("_kinds"))
    wanted = groups.withColumns({"_place": (F.col("_all") - 1) * F.lit(float(share)), "_low": F.lit(None).cast("double"), "_high": F.lit(None).cast("double"), "_below": F.lit(0).cast("long")})
    wanted = few(wanted.withColumn("_rank", F.floor("_place")), "quantile-groups")
    v = F.col(f"c.`{value}`").cast("double")
    inside = (F.col("w._low").isNull() | (v > F.col("w._low"))) & (F.col("w._high").isNull() | (v <= F.col("w._high")))
    mine = lambda: counts.alias("c").join(wanted.alias("w"), _same("c", "w", keys)).where(inside)
    own = [F.col(f"w.`{k}`").alias(k) for k in keys]
    state = [F.col(f"w.{c}").alias(c) for c in ("_all", "_place", "_rank", "_low", "_high", "_below")]
    while (wanted.agg(F.max("_kinds")).first()[0] or 0) > SMALL:
        pivots = few(mine().where(F.col("w._kinds") > SMALL).groupBy(*own).agg(F.percentile_approx(v, [k / PIVOTS for k in range(1, PIVOTS)], 10_000).alias("_p")), "quantile-pivots")
        cut = mine().join(pivots.alias("p"), _same("c", "p", keys), "left")
        cell = F.coalesce(F.size(F.filter("p._p", lambda p: p < v)), F.lit(0))
        cells = cut.groupBy(*own, *state, F.col("p._p").alias("_p"), cell.alias("_cell")).agg(F.sum("c._n").alias("_n"), F.count("*").alias("_kinds"))
        w = Window.partitionBy(*(F.col(k) for k in keys), "_all").orderBy("_cell")
        before = F.col("_below") + F.sum("_n").over(w) - F.col("_n")
        hit = cells.withColumn("_before", before).where((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
        low = F.when(F.col("_cell") > 0, F.get("_p", F.col("_cell") - 1))
        new = hit.select(*at, "_all", "_place", "_rank", F.coalesce(low, "_low").alias("_low"), F.least(F.get("_p", F.col("_cell")), "_high").alias("_high"), F.col("_before").alias("_below"), "_kinds")
        wanted = few(new, "quantile-groups")
    w = Window.partitionBy(*(F.col(k) for k in keys)).orderBy("_v")
    ordered = mine().select(*own, *state, v.alias("_v"), F.col("c._n").alias("_n"))
    ordered = ordered.withColumns({"_upto": F.col("_below") + F.sum("_n").over(w), "_next": F.lead("_v").over(w)})
    first = ordered.where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_n") <= F.col("_rank")))
    # the value after it matters where the place lies between two; it may be the first of what comes after the interval
    first = first.withColumn("_more", (F.col("_place") > F.col("_rank")) & (F.col("_upto") == F.col("_rank") + 1))
    found = few(first.select(*at, "_all", "_place", "_rank", "_v", "_next", "_more"), "quantile-found")
    out = found.withColumn("_after", F.col("_next"))
    if found.where("_more AND _next IS NULL").head(1):
        later = counts.alias("c").join(found.where("_more AND _next IS NULL").alias("f"), _same("c", "f", keys)).where(v > F.col("f._v"))
        later = later.groupBy(*(F.col(f"f.`{k}`").alias(k) for k in keys)).agg(F.min(v).alias("_later"))
        out = found.alias("f").join(later.alias("l"), _same("f", "l", keys), "left").select("f.*", F.coalesce("f._next", "l._later").alias("_after"))
    between = (F.col("_rank") + 1 - F.col("_place")) * F.col("_v") + (F.col("_place") - F.col("_rank")) * F.col("_after")
    more = [F.col("_all").alias(n)] if n else []
    return out.select(*at, F.when(F.col("_more"), between).otherwise(F.col("_v")).alias(name), *more)


def below(rows: DataFrame, keys: list[str], order: str, n: str, name: str) -> DataFrame:
    """Rows with the sum of ``n`` over their group's rows of smaller ``order``; a group has each value of ``order`` once.

    Ranges of (group, order) are partitions; a range adds what its group has in the ranges before.
    """
    made = written(rows.repartitionByRange(*keys, order).withColumn("_range", F.spark_partition_id()), "ranges")
    group = [F.col(k) for k in keys]
    totals = made.groupBy(*group, "_range").agg(F.sum(n).alias("_t"))
    offsets = totals.select(*group, "_range", (F.sum("_t").over(Window.partitionBy(*group).orderBy("_range")) - F.col("_t")).alias("_offset"))
    inside = F.sum(n).over(Window.partitionBy(*group, "_range").orderBy(order)) - F.col(n)
    ranged = made.withColumn("_inside", inside).alias("r").join(offsets.alias("o"), _same("r", "o", keys) & (F.col("r._range") == F.col("o._range")))
    return ranged.select(*(F.col(f"r.`{c}`") for c in rows.columns), (F.col("_inside") + F.col("_offset")).alias(name))
