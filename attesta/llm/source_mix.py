"""Mixing sources to target weights by fitting word budgets with a bounded knapsack.

Sources are weighed in code point order (null last) by ``weights``, repeating.
Their targets share the corpus by weight; none exceeds ``max_epochs`` times its
source, what is above goes to the others by weight. Each source is taken whole
as often as its target allows. The rest of its budget is fitted by document
lengths: documents are counted by exact length, an even share of each length is
taken, and a bounded knapsack over the counts that are left fits the remaining
words; where whole documents don't fit well, some may be taken once more and
others less often. Which documents of a length are taken is set by a hash of id
and seed.

Defined results: a null text has size 0 and is never taken; a null source is a
source of its own; repeated rows count each, and rows that share an id, or have
none, are taken each for itself; an empty table gives an empty result; other
columns of the input are not read. Reruns agree; of rows that agree in id, source
and text it doesn't matter which is taken.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.shared import write_table

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one source and length are dealt to so many parts, so that copies of one text don't meet in one task.
PARTS = 256
#: The knapsack's budget in words: what greedy picks leave over.
KNAPSACK = 1 << 15


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """(source, source_size) -> the same with target, the budget in words.

    The level is found by driver-side rounds over a few sums; the table itself stays on Spark.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    held = write_table(sources.withColumn("weight", w), "mix-sources")
    cap = F.col("source_size") * float(max_epochs)
    total = held.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        above = cap <= F.lit(level) * F.col("weight")
        full, rest = held.agg(F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        new = (total - full) / rest if rest else level
        if new <= level or not rest:
            break
        level = new
    return held.select("source", "source_size", F.least(cap, F.lit(float(level)) * F.col("weight")).alias("target"))


def fit_lengths(size: np.ndarray, count: np.ndarray, budget: int, limit: int = KNAPSACK, share: bool = True) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to ``budget`` as the fit finds, not above.

    share: an even share of each length is taken first; else all of a budget up to ``limit`` is left to the knapsack.
    """
    size, count = np.asarray(size, np.int64), np.asarray(count, np.int64)
    take = np.zeros(len(size), np.int64)
    whole = int((size * count).sum())
    if budget <= 0 or not whole:
        return take
    if budget >= whole:
        return count.copy()
    if share or budget > limit:
        take = np.array([int(c) * budget // whole for c in count], np.int64)  # Python integers: no overflow
    left = budget - int((take * size).sum())
    down = np.argsort(-size, kind="stable")
    for k in down:
        if left <= limit:
            break
        if size[k]:
            more = min(int(count[k] - take[k]), (left - limit // 2) // int(size[k]))
            take[k] += more
            left -= more * int(size[k])
    if left <= 0:
        return take
    bits, mask, parts, who = 1, (1 << (left + 1)) - 1, [], np.full(left + 1, -1, np.int64)
    for k in down[::-1]:
        n = min(int(count[k] - take[k]), left // int(size[k])) if 0 < size[k] <= left else 0
        part = 1
        while n > 0 and not bits >> left & 1:
            part, n = min(part, n), n - min(part, n)
            new = (bits << (part * int(size[k]))) & mask & ~bits
            if new:
                sums = np.flatnonzero(np.unpackbits(np.frombuffer(new.to_bytes(left // 8 + 1, "little"), np.uint8), bitorder="little"))
                who[sums] = len(parts)
                bits |= new
            parts.append((k, part))
            part *= 2
        if bits >> left & 1:
            break
    at = bits.bit_length() - 1
    while at:
        k, part = parts[who[at]]
        take[k] += part
        at -= part * int(size[k])
    return take


SIZED = {"of": "attesta mix source", "size": "attesta mix size", "pick": "attesta mix pick", "part": "attesta mix part"}


def _of(source) -> F.Column:
    """A source's key, never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _sized(docs: DataFrame, seed: int, names: dict[str, str]) -> DataFrame:
    """The rows of ``docs`` with their size in words, and what sets their order and part."""
    pick = F.xxhash64(F.lit(seed), "doc_id", "text")
    part = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed + 1)), F.lit(PARTS)).cast("int")
    return docs.withColumns({names["of"]: _of(F.col("source")), names["size"]: word_count(F.col("text")), names["pick"]: pick, names["part"]: part})


def _quotas(sized: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """(source, size, part) of each document -> of each such cell: epochs, source_size, target, all (documents of the
    source and length) and quota (how many of the cell's first come before those are used up that are taken once more)."""
    cells = sized.groupBy("source", "size", "part").agg(F.count("*").alias("n"))
    lengths = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    aims = write_table(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long")
    aims = aims.withColumn("epochs", whole).withColumn("budget", F.greatest(F.lit(0), F.round(F.col("target") - F.col("epochs") * F.col("source_size"))).cast("long"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        size, n = pdf["size"].to_numpy(), pdf["n"].to_numpy()
        epochs, budget, whole = (int(pdf[c].iloc[0]) for c in ("epochs", "budget", "source_size"))
        best, gap = (epochs, np.zeros(len(n), np.int64)), budget + 1
        # few documents may fit better when some are taken twice and others not at all
        for e, m, share in sorted(((e, m, s) for e in range(epochs + 1) for m in range(1, max_epochs - e + 1) for s in (True, False)), key=lambda x: (x[1], -x[2], -x[0])):
            extra = fit_lengths(size, n * m, budget + (epochs - e) * whole, share=share)
            left = budget + (epochs - e) * whole - int((extra * size).sum())
            if left < gap:
                best, gap = (e, extra), left
            if gap <= 0.001 * budget:
                break
        return pdf.assign(epochs=best[0], extra=best[1])[["source", "size", "n", "epochs", "source_size", "target", "extra"]]

    fitted = (
        lengths.alias("l").join(aims.alias("a"), F.expr("l.source <=> a.source")).select("l.source", "l.size", "l.n", "a.epochs", "a.budget", "a.source_size", "a.target")
        .groupBy("source").applyInPandas(fit, "source string, size long, n long, epochs long, source_size long, target double, extra long")
    )
    fitted = write_table(fitted, "mix-fitted")
    before = F.sum("n").over(Window.partitionBy("source", "size").orderBy("part")) - F.col("n")
    return (
        cells.withColumn("before", before).alias("c").join(fitted.alias("f"), F.expr("c.source <=> f.source AND c.size = f.size"))
        .select("c.source", "c.size", "c.part", "f.epochs", "f.source_size", "f.target", F.col("f.n").alias("all"), (F.col("extra") - F.col("before")).alias("quota"))
    )


def _chosen(rows: DataFrame, quotas: DataFrame, names: dict[str, str], max_epochs: int) -> tuple[DataFrame, F.Column]:
    """Rows beside their cell (as q), and how often each is taken. A row keeps its columns: nothing is joined back by id."""
    of, size, pick, part = (F.col(f"d.`{names[k]}`") for k in ("of", "size", "pick", "part"))
    quotas = quotas.withColumn("of", _of(F.col("source")))
    both = rows.alias("d").join(quotas.alias("q"), (of == F.col("q.of")) & (size == F.col("q.size")) & (part == F.col("q.part")))
    rank = F.row_number().over(Window.partitionBy(of, size, part).orderBy(pick, F.col("d.doc_id")))
    more = sum((rank <= F.col("q.quota") - k * F.col("q.all")).cast("long") for k in range(max_epochs))
    return both, F.col("q.epochs") + more


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """Rows of (doc_id, source, text) -> doc_id, size, source_size, target, copies, taken."""
    names = {k: k for k in SIZED}
    sized = write_table(_sized(docs.select("doc_id", "source", "text"), seed, names).drop("text"), "mix-sizes")
    both, copies = _chosen(sized, _quotas(sized, weights, max_epochs), names, max_epochs)
    chosen = both.select("d.doc_id", "d.size", "q.source_size", "q.target", copies.alias("copies"))
    return chosen.withColumn("taken", F.col("size") * F.col("copies"))


def take_mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """The rows of ``docs``, all columns, that the mix takes, with ``copies``: how often it takes them.

    A column ``copies`` of ``docs`` gives way to it.
    """
    docs = docs.drop("copies")
    plain = {k: k for k in SIZED}
    sized = write_table(_sized(docs.select("doc_id", "source", "text"), seed, plain).drop("text"), "mix-sizes")
    both, copies = _chosen(_sized(docs, seed, SIZED), _quotas(sized, weights, max_epochs), SIZED, max_epochs)
    return both.select(*(F.col(f"d.`{c}`") for c in docs.columns), copies.alias("copies")).where("copies > 0")
