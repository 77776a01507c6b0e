"""URL filter: host and path rules, and boosted trees on lexical features for the rest.

All of it is DataFrame functions and MLlib. Trees are trained on at most
``SAMPLE`` labelled urls, those with the smallest hash of url and label. Suffix
statistics count all labelled urls; a training url's leave out the part of
labelled urls that it is in, so that no url's own label is among its features.

Defined results: a null url, or one without ``://``, has empty host and path and
zero features, fits no rule and gets the trees' verdict; without labels of both
kinds the trees' verdict is the one kind there is, or allow; repeated rows get a
row each; an empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.shared import join_classes, write_table

#: Labelled urls that the trees are trained on, at most; parts for statistics; urls of the mean rate added to each suffix.
SAMPLE, FOLDS, PRIOR = 20_000, 5, 4

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

FEATURES = ("u_length", "u_host", "u_path", "u_depth", "u_digits", "u_entropy", "u_params", "u_dots", "u_marks", "u_suffix_rate", "u_suffix_n")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty where the url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    name = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def _lexical(urls: DataFrame) -> DataFrame:
    """Adds all features but the suffix statistics; needs url, host, path."""
    u = F.coalesce("url", F.lit(""))
    n = F.length(u)
    share = F.transform(F.array_distinct(F.split(u, "")), lambda c: (n - F.length(F.replace(u, c, F.lit("")))) / n)
    entropy = F.aggregate(F.filter(share, lambda p: p > 0), F.lit(0.0), lambda s, p: s - p * F.log2(p))
    count = lambda pattern: F.regexp_count(u, F.lit(pattern)).cast("double")
    return urls.withColumns(
        {
            "u_length": n.cast("double"), "u_host": F.length("host").cast("double"), "u_path": F.length("path").cast("double"),
            "u_depth": F.regexp_count("path", F.lit("/")).cast("double"), "u_digits": F.when(n > 0, count("[0-9]") / n).otherwise(0.0),
            "u_entropy": F.when(n > 0, entropy).otherwise(0.0), "u_params": count("[?&][^=&#]+="), "u_dots": F.regexp_count("host", F.lit("[.]")).cast("double"),
            "u_marks": count("[-_%=#]"), "suffix": F.substring_index("host", ".", -2),
        }
    )


def _fold() -> Column:
    return F.pmod(F.xxhash64("url", F.lit(3)), F.lit(FOLDS)).cast("int")


def _suffix_features(rows: DataFrame, mean: float) -> DataFrame:
    """suffix_n and suffix_good, the labelled urls of the suffix and the good ones among them (null: none) -> features."""
    n, good = (F.coalesce(c, F.lit(0)) for c in ("suffix_n", "suffix_good"))
    rate = (good + F.lit(mean * PRIOR)) / (n + PRIOR)
    return rows.withColumns({"u_suffix_rate": rate.cast("double"), "u_suffix_n": F.log1p(n.cast("double"))})


def filter_urls(pages: DataFrame, labelled: DataFrame, rules=RULES, sample: int = SAMPLE, trees: int = 12, depth: int = 3) -> DataFrame:
    """Rows of (page_id, url) and labelled rows of (url, label; 1 is to be allowed) -> page_id, host, path, rule, verdict, score.

    score: the trees' probability that the url is to be allowed.
    """
    parts = lambda df: df.withColumns(dict(zip(("host", "path"), host_and_path(F.col("url")), strict=True)))
    known = labelled.where("label IS NOT NULL AND url IS NOT NULL").select("url", F.col("label").cast("double").alias("label"), _fold().alias("fold"))
    few = known.orderBy(F.xxhash64("url", "label"), "url", "label").limit(sample)
    suffix = F.substring_index(host_and_path(F.col("url"))[0], ".", -2)
    folds = write_table(known.groupBy(suffix.alias("suffix"), "fold").agg(F.sum("label").alias("good"), F.count("*").alias("n")), "url-suffixes")
    all_good, all_n = folds.agg(F.sum("good"), F.sum("n")).first()
    mean = float(all_good or 0) / max(1, all_n or 0)
    of_suffix = folds.groupBy("suffix").agg(F.sum("good").alias("suffix_good"), F.sum("n").alias("suffix_n"))
    own = folds.select("suffix", "fold", F.col("good").alias("own_good"), F.col("n").alias("own_n"))
    train = _lexical(parts(few)).join(of_suffix, "suffix").join(own, ["suffix", "fold"])
    train = train.withColumns({"suffix_good": F.col("suffix_good") - F.col("own_good"), "suffix_n": F.col("suffix_n") - F.col("own_n")})
    train = write_table(_suffix_features(train, mean), "url-train")
    kinds = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    to_vector = VectorAssembler(inputCols=list(FEATURES), outputCol="vector", handleInvalid="keep")
    host, path = F.col("host"), F.col("path")
    name, verdict = rule_of(host, path, rules)
    # suffixes that many pages share are broadcast, the others meet by suffix
    rows = parts(pages.select("page_id", "url")).withColumn("suffix", suffix)
    sizes = rows.groupBy("suffix").agg(F.count("*").alias("n")).join(of_suffix, "suffix")
    rows = join_classes(rows, sizes, "suffix", pages.count())
    scored = _suffix_features(_lexical(rows), mean)
    if {0.0, 1.0} <= kinds.keys():
        # both kinds weigh the same: a rare one would else never win
        total = sum(kinds.values())
        weight = F.when(F.col("label") == 1.0, total / (2 * kinds[1.0])).otherwise(total / (2 * kinds[0.0]))
        gbt = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.2, seed=11, checkpointInterval=-1)
        model = gbt.fit(to_vector.transform(train).withColumn("weight", weight).select("vector", "label", "weight").coalesce(2))
        scored = model.transform(to_vector.transform(scored)).withColumn("score", vector_to_array("probability")[1])
    else:
        scored = scored.withColumn("score", F.lit(0.0 if kinds.keys() == {0.0} else 1.0))
    own = F.when(F.col("score") >= 0.5, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")
