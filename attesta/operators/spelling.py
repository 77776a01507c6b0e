"""An edit-distance index: names against the listed words that lie within a bound, by the pieces they share.

A word cut into bound + 1 pieces keeps at least one of them whole in every name
within the bound, and not far from its place. So names meet words on (length of
the word, number of the piece, its letters), never on lengths alone, and only
what meets is measured. Which places are enough follows from how many changes
may lie left and right of a piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.sources.scratch import written

#: A piece's names are dealt to so many groups, as some pieces stand in very many names.
SPLIT = 8
#: Rows of the table of places that are told to all tasks; beyond that it is joined.
FEW = 200_000


def cuts(length: int, bound: int) -> list[tuple[int, int]]:
    """Start and length of each of bound + 1 pieces of nearly equal length; short words have empty ones."""
    size, longer = divmod(length, bound + 1)
    out, at = [], 0
    for k in range(bound + 1):
        n = size + (k >= bound + 1 - longer)
        out.append((at, n))
        at += n
    return out


def places(length: int, bound: int) -> Iterator[tuple[int, int, int, int]]:
    """(name's length, piece, place in the name, piece's length) that suffice to find every name within the bound.

    With k pieces before it and bound - k after it, a piece that is the first to stay whole has moved by at most k from
    the left and bound - k from the right.
    """
    for n in range(max(1, length - bound), length + bound + 1):
        for k, (at, size) in enumerate(cuts(length, bound)):
            if not size:
                yield n, k, 0, 0
                continue
            moved = n - length
            low, high = max(0, at - k, at + moved - (bound - k)), min(n - size, at + k, at + moved + (bound - k))
            for place in range(low, high + 1):
                yield n, k, place, size


def within(names: DataFrame, words: DataFrame, bound_of: Callable[[int], int]) -> DataFrame:
    """Distinct names(key), words(lkey, ...) -> key, distance and the words' columns, for all words within their bound.

    ``bound_of`` gives the bound of a word of some length. Pairs may come several times.
    """
    spark = names.sparkSession
    lengths = sorted(r[0] for r in words.select(F.length("lkey")).distinct().collect())  # as many as the longest word has letters
    bounds = {n: bound_of(n) for n in lengths}
    looked = sorted({(n, length, k, at, size) for length in lengths for n, k, at, size in places(length, bounds[length])})
    where = spark.createDataFrame(looked, "_n int, _length int, _piece int, _at int, _size int")
    own = [(length, bounds[length], k, at, size) for length in lengths for k, (at, size) in enumerate(cuts(length, bounds[length]))]
    kept = spark.createDataFrame(own, "_length int, _bound int, _piece int, _at int, _size int")
    told = F.broadcast if len(looked) <= FEW else lambda df: df
    piece = lambda text: F.xxhash64("_length", "_piece", F.substring(text, F.col("_at") + 1, F.col("_size")))
    mine = names.where("key <> ''").join(told(where), F.length("key") == F.col("_n")).select("key", piece("key").alias("_p"), F.pmod(F.hash("key"), F.lit(SPLIT)).alias("_s"))
    theirs = words.join(told(kept), F.length("lkey") == F.col("_length")).withColumn("_p", piece(F.col("lkey"))).drop("_length", "_piece", "_at", "_size")
    met = mine.join(theirs.withColumn("_s", F.explode(F.array(*map(F.lit, range(SPLIT))))), ["_p", "_s"])
    return met.withColumn("distance", F.expr("levenshtein(key, lkey, _bound)")).where("distance >= 0").drop("_p", "_s", "_bound")


def nearest(names: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Distinct names(key), lexicon(ord, key, word) -> key, value, distance of names whose nearest word is near enough.

    Near enough is at most max(1, a third of the word's length). The nearest of all words decides, the first of equal ones,
    even where it is itself too far for its length: so a name that a word at a distance of two or more would take is held
    against all words within that distance once more. At a distance of one, every word is near enough.
    """
    words = lexicon.select("ord", F.col("key").alias("lkey"), "word").where("key <> ''")
    best = F.min(F.struct("distance", "ord", F.col("word").alias("value"), F.length("lkey").alias("n"))).alias("b")
    taken = written(within(names, words, lambda n: max(1, n // 3)).groupBy("key").agg(best), "nearest")
    sure = taken.where("b.distance < 2").select("key", "b.value", "b.distance")
    most = max(1, (words.agg(F.max(F.length("lkey"))).first()[0] or 1) // 3)
    unsure = taken.where("b.distance >= 2").select("key")
    again = within(unsure, words, lambda n: most).groupBy("key").agg(best).where(F.col("b.distance") <= F.greatest(F.lit(1), F.floor(F.col("b.n") / 3)))
    return sure.union(again.select("key", "b.value", "b.distance"))
