"""Measuring recognisers and checks against truth, and drawing what to label next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text

# Fixed value: letters that only Kurdish has.
KURDISH_ONLY = "ەڕێۆڵڤ"


def crop_keys(df: DataFrame, path: str) -> DataFrame:
    """field: what stands after the last ``__`` of a file's name, without its ending; split: before its first ``_``."""
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    return df.withColumns({"field": F.substring_index(name, "__", -1), "split": F.substring_index(name, "_", 1)})


def fit_labels(df: DataFrame, label: str, max_len: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose label the model can hold, and one row that counts kept and dropped ones (null labels are dropped)."""
    fits = F.coalesce(F.length(label) <= max_len, F.lit(False))
    return df.where(fits), df.agg(F.count_if(fits).alias("kept"), F.count_if(~fits).alias("dropped"))


def truth_join(truth: DataFrame, readings: DataFrame, keys: list[str], kind: str = "kind") -> DataFrame:
    """truth(keys, kind, truth) and readings(keys, read) -> every truth with its reading and whether it is right.

    Names (kind "name") agree by their letters, all else only as it stands; a truth without a reading is not right.
    """
    both = truth.join(readings.select(*keys, "read"), keys, "left")
    name = text.match_key(F.col("truth")) == text.match_key(F.coalesce("read", F.lit("")))
    same = F.when(F.col(kind) == "name", name).otherwise(F.col("truth") == F.col("read"))
    return both.withColumn("right", F.coalesce(same & F.col("truth").isNotNull(), F.lit(False)))


def group_accuracy(pairs: DataFrame, groups: dict[str, Column], keys: dict[str, tuple[Column, Column]], by: tuple[str, ...] = ()) -> DataFrame:
    """Share of pairs that agree under each key, in groups that may overlap, all of them among "all".

    groups: name -> which rows are in it; keys: name -> what is compared; by: columns such as the back end.
    """
    tags = F.array_compact(F.array(F.lit("all"), *(F.when(inside, F.lit(name)) for name, inside in groups.items())))
    agree = {name: F.coalesce(a == b, F.lit(False)).cast("double").alias(name) for name, (a, b) in keys.items()}
    tagged = pairs.select(*by, F.explode(tags).alias("group"), *agree.values())
    return tagged.groupBy(*by, "group").agg(F.count("*").alias("n"), *(F.avg(name).alias(name) for name in keys))


def name_keys(truth: str, read: str) -> dict[str, tuple[Column, Column]]:
    """The two keys that names are compared by: their letters, and these with kindred letters folded."""
    return {"letters": (text.match_key(F.col(truth)), text.match_key(F.col(read))), "base": (text.base_key(F.col(truth)), text.base_key(F.col(read)))}


def kurdish(c: str) -> Column:
    return F.col(c).rlike(f"[{KURDISH_ONLY}]")


def check_rates(frames: DataFrame, label: str, codes: str, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """frames(label, codes array) and expected(label, code) -> by label how often its check fired; and every other code's count.

    Labels that nothing is expected of are left out. ``expected`` has a row for each label.
    """
    known = frames.join(expected, label)
    hit = F.coalesce(F.array_contains(codes, F.col("code")), F.lit(False))
    rates = known.groupBy(label, "code").agg(F.count("*").alias("n"), F.count_if(hit).alias("fired"))
    others = known.select(label, "code", F.explode(codes).alias("other")).where("other <> code").groupBy(label, "other").agg(F.count("*").alias("n"))
    return rates, others


def wrong_blocks(frames: DataFrame, label: str, codes: str, should_pass: tuple[str, ...]) -> DataFrame:
    """Codes that blocked frames whose label should pass, by label, the most common first."""
    blocked = frames.where(F.col(label).isin(*should_pass)).select(label, F.explode(codes).alias("code"))
    return blocked.groupBy(label, "code").agg(F.count("*").alias("n")).orderBy(label, F.desc("n"), "code")


def location_rates(fields: DataFrame, detections: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Of each field how often it was located and how often it is missing. Repeated detections count once."""
    hit = detections.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return fields.join(hit, keys, "left").groupBy(by).agg(F.count("_hit").alias("located"), F.count_if(F.col("_hit").isNull()).alias("missing"))


def run_counts(df: DataFrame, *by: str) -> DataFrame:
    """Rows for each value of one column after the other: kind, value, n."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in by)))
    return df.select(pairs.alias("p")).groupBy("p.kind", "p.value").agg(F.count("*").alias("n"))


def next_round(rounds: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The number after the largest that ends a name, 1 where none has one."""
    last = F.max(F.regexp_extract(name, r"(\d+)$", 1).try_cast("int"))
    return rounds.groupBy(*([by] if by else [])).agg((F.coalesce(last, F.lit(0)) + 1).alias("round"))


def alphabet_gap(required: DataFrame, available: DataFrame, ch: str = "ch") -> DataFrame:
    """Required letters that aren't available, each once."""
    return required.select(ch).subtract(available.select(ch))


def separate_eval(df: DataFrame, split: str, key: str, round_no: int, claimed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(evaluation set, training pool): the test split is never trained on; only round 1 draws an evaluation set.

    Keys that an earlier round claimed are in neither. A key on both sides raises.
    """
    fresh = df if claimed is None else df.join(claimed.select(key).distinct(), key, "left_anti")
    test = F.coalesce(F.col(split) == "test", F.lit(False))
    held, pool = fresh.where(test if round_no == 1 else F.lit(False)), fresh.where(~test)
    both = fresh.where(test).select(key).intersect(pool.select(key)).head(1)
    if both:
        raise ValueError(f"{key} {both[0][0]!r} is in the test split and in the training pool")
    return held, pool


def join_words(boxes: DataFrame, keys: list[str], x: str, word: str, confidence: str, left_to_right: Column) -> DataFrame:
    """Words of each crop's boxes in reading order: largest x first, or smallest where ``left_to_right`` (digits and dates).

    confidence: mean weighted by the trimmed words' lengths, held to 0..1; blank boxes don't count; of equal x the
    smaller word comes first. A crop with blank boxes only has an empty text and 0.
    """
    w = F.trim(word)
    place = F.when(left_to_right, F.col(x)).otherwise(-F.col(x)).cast("double")
    item = F.when(w != "", F.struct(place.alias("at"), w.alias("w"), F.col(confidence).cast("double").alias("c")))
    out = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_i"))
    total = lambda f: F.aggregate("_i", F.lit(0.0), lambda s, i: s + f(i))
    mean = total(lambda i: i["c"] * F.length(i["w"])) / F.greatest(F.lit(1.0), total(lambda i: F.length(i["w"]).cast("double")))
    return out.select(*keys, F.array_join(F.transform("_i", lambda i: i["w"]), " ").alias("text"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean)).alias("confidence"))


