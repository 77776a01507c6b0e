"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are runs of ASCII letters, digits and anything above ASCII, lower-cased in
A-Z. A window is ``n`` consecutive words of an item; an item of fewer words, but
not none, is one window. Token windows of every text are looked up by hash, hits
are verified word by word, and the words inside them are hit.

What is broadcast has a bound. A benchmark of at most ``BLOCK`` items and
``BLOCK_WORDS`` words, which an aggregate measures first, goes to the tasks as it
is, and texts are scanned and verified in one pass. A larger one stays in Spark:
tasks make its windows, a bitmap of ``SLOTS`` 64-bit slots of their hashes is
broadcast, and the windows of texts that it lets through are verified by a join on
their words. Words that a thousandth of those windows have or more are split by row.

Defined results: a null text has no words and no hits; a null item gives no
window; repeated items share their windows; items without an id count as one item
and aren't named in the digest; empty tables give no hits; texts are scanned whole,
however long; rows stay apart whatever their ids are; other columns of the inputs
are not read by ``scan`` and are kept by ``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.shared import write_table
from attesta.llm.textnum import LOWER, MARKS, Words, same, texts, windows, words

BLOCK, BLOCK_WORDS = 100_000, 4_000_000
SLOTS = 1 << 20
SPLITS = 256
_BITS = 20


class Windows:
    """The windows of few items: for each length the sorted hashes, where each stands, and its items."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.ids = [i for i, _ in items]
        table = pa.array([t for _, t in items], pa.string())
        found: dict[int, list] = {}
        self.words: list[bytes] = []
        for t in texts(table):
            w = words(t, MARKS, LOWER)
            h = w.hashes()
            base = len(self.words)
            self.words += [w.data[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)]
            for k in sorted({min(int(c), n) for c in w.n if c}):
                value, first, doc = windows(h, w, k)
                keep = np.minimum(w.n[doc], n) == k
                found.setdefault(k, []).append((value[keep], first[keep] + base, doc[keep] + t.first))
        self.by_length = {}
        for k, parts in found.items():
            value, first, item = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((item, value))
            value, first, item = value[order], first[order], item[order]
            bits = np.zeros(1 << _BITS, bool)
            bits[(value & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
            at = np.flatnonzero(same(value))
            self.by_length[k] = (value[at], first[at], np.r_[at, len(value)], item, bits)

    def hits(self, w: Words, h: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: the first words of verified windows, and which window."""
        for k, (value, at, _, _, bits) in self.by_length.items():
            mine, first, _ = windows(h, w, k)
            may = np.flatnonzero(bits[(mine & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
            where = np.searchsorted(value, mine[may])
            where[where == len(value)] = 0
            ok = value[where] == mine[may]
            may, where = may[ok], where[ok]
            sure = np.fromiter((all(w.data[w.start[f + j] : w.end[f + j]].tobytes() == self.words[at[x] + j] for j in range(k)) for f, x in zip(first[may], where, strict=True)), bool, len(may))
            yield k, first[may[sure]], where[sure]


FOUND = "n_words long, hit array<struct<first:int,last:int>>, items array<long>"


def _few(benchmark: DataFrame, n: int) -> Windows | None:
    """The windows, where the benchmark's measured size lets every task hold them."""
    # a word has a character and one that ends it
    size = benchmark.where("text IS NOT NULL").agg(F.count("*"), F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()
    if size[0] > BLOCK or size[1] // 2 > BLOCK_WORDS:
        return None
    return Windows([(r[0], r[1]) for r in benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long"), "text").collect()], n)


def _spelt(w: Words, first: np.ndarray, k: int) -> list[str]:
    """The words of windows, parted by blanks, which no word holds."""
    return [b" ".join(w.data[a:b].tobytes() for a, b in zip(w.start[f : f + k], w.end[f : f + k], strict=True)).decode() for f in first]


def benchmark_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """item_id, k (words of the window), value (its hash), words: made in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in texts(b.column("text")):
                w = words(t, MARKS, LOWER)
                h = w.hashes()
                for k in sorted({min(int(c), n) for c in w.n if c}):
                    value, first, doc = windows(h, w, k)
                    keep = np.minimum(w.n[doc], n) == k
                    value, first, doc = value[keep], first[keep], doc[keep]
                    yield pa.RecordBatch.from_pydict({"item_id": b.column("item_id").take(pa.array(doc + t.first)), "k": pa.array(np.full(len(doc), k, np.int32)), "value": pa.array(value.view(np.int64)), "words": pa.array(_spelt(w, first, k), pa.string())})

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, k int, value long, words string").distinct()


def _candidates(docs: DataFrame, known: DataFrame) -> DataFrame:
    """docs(row, doc_id, text) -> row, doc_id, n_words, may: the windows whose hash has its bit in the broadcast bitmap."""
    bits = known.select(F.expr(f"CAST(shiftrightunsigned(value, 6) % {SLOTS} AS int)").alias("slot"), F.expr("shiftleft(1L, CAST(value & 63 AS int))").alias("bit"))
    table = bits.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toPandas()
    slots = np.zeros(SLOTS, np.uint64)
    slots[table["slot"].to_numpy(int)] = table["bits"].to_numpy(np.int64).view(np.uint64)
    lengths = sorted(r[0] for r in known.select("k").distinct().collect())
    shared = docs.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in texts(b.column("text")):
                w = words(t, MARKS, LOWER)
                h = w.hashes()
                doc, place, size, spelt = [np.zeros(0, int)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], []
                for k in lengths:
                    value, first, of = windows(h, w, k)
                    may = np.flatnonzero(shared.value[((value >> np.uint64(6)) % np.uint64(SLOTS)).astype(np.int64)] >> (value & np.uint64(63)) & np.uint64(1))
                    doc.append(of[may])
                    place.append((first[may] - w.at[of[may]]).astype(np.int32))
                    size.append(np.full(len(may), k, np.int32))
                    spelt += _spelt(w, first[may], k)
                doc, place, size = (np.concatenate(x) for x in (doc, place, size))
                order = np.argsort(doc, kind="stable")
                entry = pa.StructArray.from_arrays([pa.array(place), pa.array(size), pa.array(spelt, pa.string())], ["first", "k", "words"]).take(pa.array(order))
                at = np.searchsorted(doc[order], np.arange(len(t) + 1)).astype(np.int32)
                here = {c: b.column(c).slice(t.first, len(t)) for c in ("row", "doc_id")}
                yield pa.RecordBatch.from_pydict(here | {"n_words": pa.array(w.n.astype(np.int64)), "may": pa.ListArray.from_arrays(pa.array(at), entry)})

    return docs.mapInArrow(run, "row long, doc_id long, n_words long, may array<struct<first:int,k:int,words:string>>")


def _hits(scanned: DataFrame, known: DataFrame, *values: str) -> DataFrame:
    """row, first, k, and ``values`` of the benchmark's windows, for the candidates that are windows of the benchmark."""
    may = scanned.select("row", F.explode("may").alias("m")).select("row", "m.*")
    counts = may.groupBy("words").agg(F.count("*").alias("n"))
    many = max(1000, (may.agg(F.count("*")).first()[0]) // 1000)
    hot = F.broadcast(counts.where(F.col("n") >= many).select("words", F.lit(True).alias("_hot")))  # at most a thousand
    own = F.when(F.col("_hot"), F.pmod(F.xxhash64("row"), F.lit(SPLITS))).otherwise(F.lit(0)).cast("int")
    all_of = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SPLITS - 1))).otherwise(F.array(F.lit(0))))
    left = may.join(hot, "words", "left").withColumn("_split", own).drop("_hot")
    right = known.select("words", *values).distinct().join(hot, "words", "left").withColumn("_split", all_of).drop("_hot")
    return left.join(right, ["words", "_split"]).select("row", "first", "k", *values)


def _scan_large(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    known = write_table(benchmark_windows(benchmark, n), "leak-windows")
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    scanned = write_table(_candidates(rows, known), "leak-candidates")  # rows keep their numbers from here on
    by_row = Window.partitionBy("row").orderBy("first", "last")
    before = F.max("last").over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    spans = _hits(scanned, known).select("row", "first", (F.col("first") + F.col("k") - 1).alias("last")).distinct()
    runs = spans.withColumn("new", (F.coalesce(before, F.lit(-2)) + 1 < F.col("first")).cast("int")).withColumn("run", F.sum("new").over(by_row))
    runs = runs.groupBy("row", "run").agg(F.struct(F.min("first").alias("first"), F.max("last").alias("last")).alias("span")).groupBy("row").agg(F.sort_array(F.collect_list("span")).alias("hit"))
    # a struct, as a set leaves nulls out
    named = _hits(scanned, known, "item_id").groupBy("row").agg(F.collect_set(F.struct("item_id")).alias("named")).select("row", F.col("named.item_id").alias("items"))
    out = scanned.drop("may").join(runs, "row", "left").join(named, "row", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return out.select("doc_id", "n_words", none("hit", "array<struct<first:int,last:int>>"), none("items", "array<bigint>"))


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Rows of (doc_id, text) -> doc_id, n_words, runs of hit words (first and last, from 0), items with hits."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    few = _few(benchmark, n)
    if few is None:
        return _scan_large(docs, benchmark, n)
    shared = docs.sparkSession.sparkContext.broadcast(few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            for t in texts(b.column("text")):
                w = words(t, MARKS, LOWER)
                h = w.hashes()
                step = np.zeros(len(h) + 1, np.int32)
                doc, item = [], []
                for k, first, which in known.hits(w, h):
                    np.add.at(step, first, 1)
                    np.add.at(step, first + k, -1)
                    _, _, at, of, _ = known.by_length[k]
                    pair = np.unique(np.c_[w.doc[first], which], axis=0) if len(first) else np.zeros((0, 2), int)
                    count = at[pair[:, 1] + 1] - at[pair[:, 1]]
                    doc.append(np.repeat(pair[:, 0], count))
                    item.append(of[np.repeat(at[pair[:, 1]], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)])
                hit = np.cumsum(step[:-1]) > 0
                got = np.unique(np.c_[np.concatenate(doc), np.concatenate(item)], axis=0) if doc else np.zeros((0, 2), int)
                items_at = np.searchsorted(got[:, 0], np.arange(len(t) + 1))
                head = hit.copy()
                head[1:] &= ~hit[:-1] | (w.doc[1:] != w.doc[:-1])
                tail = hit.copy()
                tail[:-1] &= ~hit[1:] | (w.doc[1:] != w.doc[:-1])
                f, l = np.flatnonzero(head), np.flatnonzero(tail)
                base = w.at[w.doc[f]]
                runs_at = np.searchsorted(f, w.at)
                spans = pa.StructArray.from_arrays([pa.array((f - base).astype(np.int32)), pa.array((l - base).astype(np.int32))], ["first", "last"])
                named = pa.array([known.ids[i] for i in got[:, 1]], pa.int64())
                found = {
                    "n_words": pa.array(w.n.astype(np.int64)),
                    "hit": pa.ListArray.from_arrays(pa.array(runs_at.astype(np.int32)), spans),
                    "items": pa.ListArray.from_arrays(pa.array(items_at.astype(np.int32)), named),
                }
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").slice(t.first, len(t))} | found)

    return docs.mapInArrow(run, f"doc_id long, {FOUND}")


def report(scanned: DataFrame) -> DataFrame:
    """The digest of ``scan``: n_words, n_hit, n_items, items_sha256, contaminated."""
    places = F.array_distinct(F.flatten(F.transform("hit", lambda r: F.sequence(r["first"], r["last"]))))
    names = F.array_join(F.array_sort(F.transform(F.array_distinct("items"), lambda i: i.cast("string"))), ",")
    n_hit = F.size(places).cast("long")
    return scanned.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(F.array_distinct("items")).cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no window of the benchmark occurs."""
    few = _few(benchmark, n)
    if few is None:
        # the rows are written once, so that a row has one number in both of its uses
        rows = write_table(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("kept")), "leak-rows")
        known = write_table(benchmark_windows(benchmark, n), "leak-windows")
        scanned = write_table(_candidates(rows.select("row", F.lit(None).cast("long").alias("doc_id"), F.col("kept.text").alias("text")), known), "leak-candidates")
        return rows.join(_hits(scanned, known).select("row").distinct(), "row", "left_anti").select("kept.*")
    shared = docs.sparkSession.sparkContext.broadcast(few)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = np.ones(b.num_rows, bool)
            for t in texts(b.column(at)):
                w = words(t, MARKS, LOWER)
                for _, first, _ in shared.value.hits(w, w.hashes()):
                    clean[t.first + w.doc[first]] = False
            yield b.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
