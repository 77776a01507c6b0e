"""Statistics over labelled samples: robust references, limits, sweeps, rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators.selection import below, counted, few, quantile
from attesta.sources.scratch import written

#: Slots that photos are dealt to by hash.
SLOTS = 1024


def cells_of(rows: DataFrame, features: Sequence[str], value: str = "value") -> DataFrame:
    """rows(photo, region, a column for each feature) -> photo, region, feature, value: a row for each feature."""
    one = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").alias(value)) for f in features))).alias("c")
    return rows.select("photo", "region", one).select("photo", "region", "c.feature", f"c.`{value}`")


def _with_photos(cells: DataFrame, least: int) -> DataFrame:
    """Regions with so many photos: so many taken slots are as many photos at least, and regions with fewer have their photos counted."""
    slot = F.pmod(F.xxhash64("photo"), F.lit(max(SLOTS, 16 * least)))
    taken = few(cells.groupBy("region").agg(F.countDistinct(F.when(F.col("photo").isNotNull(), slot)).alias("slots")), "region-slots")
    sure, unsure = taken.where(F.col("slots") >= least).select("region"), taken.where(F.col("slots") < least).select("region")
    if not unsure.head(1):
        return sure
    photos = cells.join(unsure, "region", "left_semi").groupBy("region").agg(F.countDistinct("photo").alias("photos"))
    return sure.union(photos.where(F.col("photos") >= least).select("region"))


def fit_reference(cells: DataFrame, min_photos: int = 20) -> DataFrame:
    """cells(photo, region, feature, value) -> region, feature, median, scale (1.4826 x MAD, 0.001 at least), n.

    Regions with fewer photos are left out.
    """
    at = ["region", "feature"]
    counts = written(counted(cells, at, "value").join(_with_photos(cells, min_photos), "region", "left_semi"), "cell-counts")
    mid = few(quantile(counts, at, "value", 0.5, "median", "n"), "cell-medians")
    away = counts.join(mid, at).withColumn("off", F.abs(F.col("value") - F.col("median")))
    off = quantile(counted(away, at, "off", F.col("_n")), at, "off", 0.5, "mad")
    return off.select(*at, F.greatest(F.col("mad") * 1.4826, F.lit(0.001)).alias("scale")).join(mid, at).select(*at, "median", "n", "scale")


def with_reference(cells: DataFrame, reference: DataFrame) -> DataFrame:
    """A row for each cell that has a reference; the cells stay where they are if the references are few."""
    return cells.join(few(reference, "references"), ["region", "feature"])


def _by_region(table: DataFrame, features: Sequence[str], values: Sequence[str], name: str) -> DataFrame:
    """table(region, feature, values) -> a row for each region, with the value v of the i-th feature in column _v_i."""
    at = lambda f, v: F.max(F.when(F.col("feature") == f, F.col(v)))
    return few(table.groupBy("region").agg(*(at(f, v).alias(f"_{v}_{i}") for i, f in enumerate(features) for v in values)), name)


def deviations(rows: DataFrame, features: Sequence[str], reference: DataFrame) -> DataFrame:
    """rows(photo, region, a column for each feature) -> photo, region, and in the features' columns their largest deviations.

    A deviation is null where the feature has no value or the region no reference of it; regions without any are left out.
    """
    ref = _by_region(reference, features, ["median", "scale"], "references")
    d = lambda i, f: F.abs(F.col(f"`{f}`") - F.col(f"_median_{i}")) / F.col(f"_scale_{i}")
    return rows.join(ref, "region").groupBy("photo", "region").agg(*(F.max(d(i, f)).alias(f) for i, f in enumerate(features)))


def fit_limits(dev: DataFrame, features: Sequence[str], fpr: float) -> DataFrame:
    """``deviations`` -> region, feature, limit: the genuine deviation at 1 - fpr / features, rounded; zero limits are left out. Features without any deviation don't count."""
    at = ["region", "feature"]
    counts = counted(cells_of(dev, features, "deviation"), at, "deviation")
    n = counts.agg(F.countDistinct("feature")).first()[0]
    out = quantile(counts, at, "deviation", 1 - fpr / max(1, n), "limit")
    return out.withColumn("limit", F.round("limit", 3)).where(F.col("limit") > 0)


def region_score(dev: DataFrame, features: Sequence[str], limits: DataFrame) -> DataFrame:
    """Of each row of ``deviations`` the largest share of its limit, and the feature, the first of equal ones; 1 or more warns.

    Features without a limit aren't scored; regions without any are left out. Rows stay where they are.
    """
    share = dev.join(_by_region(limits.where(F.col("limit").isNotNull()), features, ["limit"], "limits"), "region")
    scores = []
    for i, f in enumerate(features):
        score = F.col(f"`{f}`") / F.col(f"_limit_{i}")
        scores.append(F.when(F.col(f"_limit_{i}").isNotNull(), F.struct(score.isNull().alias("none"), (-score).alias("minus"), F.lit(f).alias("feature"), score.alias("score"))))
    top = share.select("photo", "region", F.array_min(F.array(*scores)).alias("t"))
    return top.select("photo", "region", "t.feature", "t.score", (F.col("t.score") >= 1).alias("warns"))


def describe_by(df: DataFrame, label: str, col: str) -> DataFrame:
    """Number, smallest, tenth percentile, median and largest of each label's values; a label without any has nulls."""
    counts = counted(df, [label], col)
    out = df.groupBy(label).agg(F.count(col).alias("n"), F.min(col).alias("low"), F.max(col).alias("high")).alias("o")
    for share, name in ((0.1, "p10"), (0.5, "mid")):
        q = quantile(counts, [label], col, share, name).alias("q")
        out = out.join(q, F.col(f"o.`{label}`").eqNullSafe(F.col(f"q.`{label}`")), "left").select("o.*", f"q.{name}").alias("o")
    return out.select(label, "n", "low", "p10", "mid", "high")


def sweep(df: DataFrame, score: str, genuine: Column, thresholds: list[float]) -> DataFrame:
    """Shares of genuine and attack rows that pass each threshold. One pass: counts by the threshold a row reaches."""
    limits = F.array(*(F.lit(float(t)) for t in sorted(thresholds)))
    reached = df.withColumn("_g", genuine).withColumn("_k", F.size(F.filter(limits, lambda t: F.col(score) >= t)))
    counts = reached.groupBy("_k").agg(F.count_if("_g").alias("g"), F.count_if(~F.col("_g")).alias("a"))
    grid = counts.select("g", "a", "_k", F.posexplode(limits).alias("_i", "threshold"))
    passed = grid.groupBy("threshold").agg(*(F.sum(F.when(F.col("_k") > F.col("_i"), F.col(c)).otherwise(0)).alias(f"{c}p") for c in "ga"), F.sum("g").alias("gn"), F.sum("a").alias("an"))
    return passed.select("threshold", F.try_divide("gp", "gn").alias("genuine_pass"), F.try_divide("ap", "an").alias("attack_pass"))


def auc(df: DataFrame, group: str, score: str, attack: Column) -> DataFrame:
    """Share of (attack, genuine) pairs in which the attack scores strictly higher, from counts by distinct value; groups without both kinds are left out."""
    at = df.where(F.col(score).isNotNull()).groupBy(group, score).agg(F.count_if(attack).alias("a"), F.count_if(~attack).alias("g"))
    won = below(at, [group], score, "g", "below").withColumn("won", F.col("a") * F.col("below"))
    out = won.groupBy(group).agg(F.sum("won").alias("won"), (F.sum("a") * F.sum("g")).alias("pairs"))
    return out.where("pairs > 0").select(group, (F.col("won") / F.col("pairs")).alias("auc"))


def flag_rates(df: DataFrame, kind: str, region: str, flag: str) -> DataFrame:
    """Share of flagged rows by kind, overall (region null) and by region."""
    return df.groupingSets([[kind], [kind, region]], kind, region).agg(F.avg(F.col(flag).cast("double")).alias("rate"), F.count("*").alias("n"))


def live_score(probs: DataFrame, key: str, model: str, p: str, limit: float) -> DataFrame:
    """Mean over a model's crops, rounded to 4 places, then over models; they disagree where the means lie further apart than the limit."""
    inner = probs.groupBy(key, model).agg(F.round(F.avg(p), 4).alias("m"))
    return inner.groupBy(key).agg(F.avg("m").alias("live"), (F.max("m") - F.min("m") > limit).alias("models_disagree"))


def trimmed_mean(df: DataFrame, key: str, col: str, q: float = 0.8) -> DataFrame:
    """Mean of each key's values up to their quantile ``q``."""
    cut = few(quantile(counted(df, [key], col), [key], col, q, "cut"), "trims")
    return df.join(cut, key).where(F.col(col) <= F.col("cut")).groupBy(key).agg(F.avg(col).alias("trimmed"))


def fired_by(scores: DataFrame, kind: str, feature: str) -> DataFrame:
    return scores.groupBy(kind, feature).agg(F.count("*").alias("n"))


#: Units of a probability that ``fuse_classes`` adds up.
UNITS = 1e9


def fuse_classes(probs: DataFrame, key: str, classes: list[str]) -> DataFrame:
    """Mean class probabilities over models and the largest; the first of equal ones.

    Probabilities count in whole billionths, so that sums are exact and equal means are equal in any order of rows.
    One that is null, not a number or infinite isn't there.
    """
    whole = lambda c: F.round(F.col(c) * UNITS).try_cast("long")
    out = probs.groupBy(key).agg(*((F.sum(whole(c)).cast("double") / F.nullif(F.count(whole(c)), F.lit(0)) / UNITS).alias(c) for c in classes))
    top = F.greatest(*classes)
    label = None
    for c in classes:
        label = F.when(F.col(c) == top, c) if label is None else label.when(F.col(c) == top, c)
    return out.withColumn("label", label)
