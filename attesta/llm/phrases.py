"""Collocations of two to four words from a weighted de Bruijn graph, by language.

Nodes are three words, edges four: an edge's weight is how often its words stand
together in a piece. One job counts edges and derives the rest. Each word of a
piece gives one record, the up to four words that begin there; records short of
four words are what pieces end with. Then, level by level, a phrase's count is
what flows out of its node, the sum over the longer records that begin with it,
plus the pieces that end with it. Every level is dealt out by its phrases' hash and
summed in the tasks before, so that no word or node meets in one task.

Words of fewer than ``least`` occurrences end a piece: no phrase that counts has
one. Which words are left is told to all tasks, up to ``NUMBERED`` of them one by
one, beyond that by a bitmap of fixed size; results are the same.

A node all of whose flow comes in by one edge and leaves by one lies inside a
unary path; ``compact`` joins edges over such nodes to paths, passages that always
repeat as a whole. Such nodes are covered by edges of their own weight and can't be
results, so they leave before scores are made.

Defined results: a null text is empty, a null lang is ``und``; repeated rows count
each; ids aren't read, nor are other columns; an empty table gives an empty
result; texts are read whole, however long; ties are broken by the phrase. Words
have 64-bit hashes that language is part of: two of n words agree with a chance of
about n * n / 2**65; phrases are compared by all their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.shared import BLOB, BLOB_ARROW, drop_table, join_classes, partitions, write_table
from attesta.llm.textnum import LOWER, Texts, Words, combine, mix, same, texts, words

#: Ends of pieces, and what separates words.
BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAPS = BREAKS.copy()
GAPS[[0x20, 0x09]] = True
UNKNOWN, LONGEST = "und", 4
#: Frequent words told one by one (12 bytes each); bits of the bitmap beyond that; records held before a task sums them; bytes of text read at once.
NUMBERED, BITS, HELD, SLICE = 1 << 22, 26, 1 << 20, 1 << 20
#: A language's phrases are ranked in so many parts first.
PARTS = 16


def _langs(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The languages of a batch, a seed of each, and each row's language."""
    coded = pc.fill_null(batch.column("lang"), UNKNOWN).dictionary_encode()
    names = coded.dictionary
    h = np.zeros(len(names), np.uint64)
    for t in texts(names):
        w = Words(t.off[:-1], t.off[1:], t.off[:-1], np.ones(len(t)), np.arange(len(t)), t.data)
        h[t.first : t.first + len(t)] = w.hashes()
    return names.to_pylist(), mix(~h), coded.indices.to_numpy()  # not a word's hash: "de" in "en" is not "en" in "de"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Texts, Words, np.ndarray, np.ndarray, list[str]]]:
    """Slices of texts with their words, hashes of word and language, each word's language, and all languages' names."""
    for batch in batches:
        names, seeds, of = _langs(batch)
        for t in texts(batch.column("text"), SLICE):
            w = words(t, GAPS, LOWER)
            lang = of[t.first + w.doc]
            yield t, w, mix(w.hashes() ^ seeds[lang]), lang, names


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    off = np.r_[0, np.cumsum(size)]
    at = np.repeat(start - off[:-1], size) + np.arange(off[-1])
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data[at].tobytes()))


def count_words(docs: DataFrame) -> DataFrame:
    """Rows of (lang, text) -> lang, word, h, n: every word and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, w, h, lang, names in _read(batches):
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(lang[first])), _strings(w.data, w.start[first], w.end[first]), pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "word", "h", "n"])

    seen = docs.select("lang", "text").mapInArrow(run, "lang string, word string, h long, n long")
    return seen.groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))


def _bitmap(frequent: DataFrame) -> bytes:
    """2 ** BITS bits, set for the top bits of frequent words' hashes: as large for every corpus."""
    bit = F.shiftrightunsigned("h", 64 - BITS) + 1
    rows = frequent.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = bytearray(2**BITS // 8)
    for r in rows:
        at = (r["k"] - 1) * len(r["bits"])
        out[at : at + len(r["bits"])] = r["bits"]
    return bytes(out)


def _pack(w: np.ndarray, n: np.ndarray, buckets: int, kind: int) -> Iterator[pa.RecordBatch]:
    """Phrases in order (a row of words each, 0 for none) and counts, one compressed blob a bucket: columns byte by byte."""
    if not len(n):
        return
    bucket = (combine([c.astype(np.uint64) for c in w.T]) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    w, n, bucket = w[order], n[order], bucket[order]
    at = np.r_[np.flatnonzero(same(bucket)), len(bucket)]
    press, blobs = zstandard.ZstdCompressor(level=1), []
    for a, b in zip(at[:-1], at[1:], strict=True):
        head = np.array([b - a, w.itemsize], np.uint32).tobytes()
        planes = [np.ascontiguousarray(x).view(np.uint8).reshape(b - a, -1).T.tobytes() for x in (*w[a:b].T, n[a:b])]
        blobs.append(press.compress(head + b"".join(planes)))
    yield pa.RecordBatch.from_arrays([pa.array(bucket[at[:-1]], pa.int32()), pa.array(np.full(len(blobs), kind), pa.int32()), pa.array(blobs, pa.binary())], schema=BLOB_ARROW)


def _unpack(column: pa.ChunkedArray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    ws, ns, press = [], [], zstandard.ZstdDecompressor()
    for x in column:
        raw = press.decompress(x.as_buffer())
        n, size = np.frombuffer(raw, np.uint32, 2).tolist()
        planes = np.frombuffer(raw, np.uint8, offset=8)
        whole = lambda at, k, kind: np.ascontiguousarray(planes[at : at + k * n].reshape(k, n).T).view(kind)[:, 0]  # noqa: E731, B023
        ws.append(np.stack([whole(j * size * n, size, f"<u{size}") for j in range(wide)], 1))
        ns.append(whole(wide * size * n, 8, "<u8"))
    return (np.concatenate(ws), np.concatenate(ns)) if ws else (np.zeros((0, wide), np.uint32), np.zeros(0, np.uint64))


def sums(w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each phrase once, in order, with the sum of its counts."""
    if not len(n):
        return w, n
    keys = [*w.T]
    if w.itemsize == 4:  # two words to a key
        keys = [a.astype(np.uint64) << np.uint64(32) | b for a, b in zip(keys[::2], [*keys[1::2], np.zeros(len(n), np.uint32)], strict=False)]
    order = np.lexsort(keys[::-1])
    w, n = w[order], n[order]
    at = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]).any(1)])
    return w[at], np.add.reduceat(n, at)


class Frequent:
    """Frequent words by their hash: numbered by frequency, or, where they are too many to tell to all tasks, by a bitmap.

    The bitmap has 2 ** BITS bits for every corpus; a word that only shares a bit costs work, not correctness. Numbered
    words take fewer bytes; else a word's number is its hash.
    """

    def __init__(self, frequent: DataFrame, numbered: int):
        self.bits = None
        if frequent.count() <= numbered:
            h = np.array([r["h"] for r in frequent.orderBy(F.desc("n"), "h").select("h").toLocalIterator()], np.int64).view(np.uint64)
            self.by_number = np.r_[np.zeros(1, np.uint64), h]
            self.number = np.argsort(h).astype(np.uint32) + np.uint32(1)
            self.sorted = np.sort(h)
        else:
            self.bits = _bitmap(frequent)

    def numbers(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's number, and whether it is frequent."""
        if self.bits is not None:
            bit = h >> np.uint64(64 - BITS)
            return h, np.frombuffer(self.bits, np.uint8)[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 == 1
        if not len(self.sorted):
            return np.zeros(len(h), np.uint32), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return self.number[at], self.sorted[at] == h

    def hashes(self, number: np.ndarray) -> np.ndarray:
        return number if self.bits is not None else self.by_number[number]


def records(t: Texts, w: Words, number: np.ndarray, good: np.ndarray) -> np.ndarray:
    """The up to four good words that begin at each good one, inside its piece; single words are left out."""
    k = np.flatnonzero(good)
    if not len(k):
        return np.zeros((0, LONGEST), number.dtype)
    piece = np.searchsorted(np.flatnonzero(BREAKS[t.data]), w.start[k])
    fresh = np.r_[True, (np.diff(k) > 1) | (np.diff(piece) > 0) | (np.diff(w.doc[k]) > 0)]
    begin = np.flatnonzero(fresh)
    end = np.repeat(np.r_[begin[1:], len(k)], np.diff(np.r_[begin, len(k)]))
    left = end - np.arange(len(k))
    padded = np.r_[number[k], np.zeros(LONGEST, number.dtype)]
    out = np.stack([np.where(left > j, padded[j : j + len(k)], padded[-1]) for j in range(LONGEST)], 1)
    return out[left > 1]


GRAMS = "k int, w1 long, w2 long, w3 long, w4 long, f long"


def count_phrases(docs: DataFrame, frequent: Frequent, least: int) -> DataFrame:
    """Rows of (lang, text) -> k, w1 to w4 (word hashes), f: phrases of two to four words that occur ``least`` times or more."""
    spark = docs.sparkSession
    buckets = partitions(spark)
    told = spark.sparkContext.broadcast(frequent)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for t, w, h, _, _ in _read(batches):
            held.append(records(t, w, *told.value.numbers(h)))
            n += len(held[-1])
            if n >= HELD:
                made = np.concatenate(held)
                yield from _pack(*sums(made, np.ones(len(made), np.uint64)), buckets, LONGEST)
                held, n = [], 0
        if n:
            made = np.concatenate(held)
            yield from _pack(*sums(made, np.ones(len(made), np.uint64)), buckets, LONGEST)

    def flow(k: int):
        """Counts of phrases of k words, and their flow to what they begin with; counts of longer ones pass."""

        def work(table: pa.Table) -> pa.Table:
            kind = table.column("kind").to_numpy()
            done = [table.filter(pa.array(kind > 10))]
            w, n = sums(*_unpack(table.filter(pa.array(kind <= 10)).column("data"), k))
            often = (w[:, k - 1] != 0) & (n >= np.uint64(least)) if len(n) else np.zeros(0, bool)
            out = list(_pack(w[often], n[often], buckets, 10 + k))
            if k > 2:
                out += _pack(*sums(w[:, : k - 1], n), buckets, k - 1)
            return pa.concat_tables([*(x.select(["bucket", "kind", "data"]).cast(BLOB_ARROW) for x in done), pa.Table.from_batches(out, BLOB_ARROW)])

        return work

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for kind, data in zip(b.column("kind").to_pylist(), b.column("data"), strict=True):
                k = kind - 10
                w, n = _unpack([data], k)
                w = told.value.hashes(w)
                w = np.concatenate([w, np.zeros((len(n), LONGEST - k), np.uint64)], 1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), k), pa.int32()), *map(pa.array, np.ascontiguousarray(w.T)), pa.array(n.view(np.int64))], names=["k", "w1", "w2", "w3", "w4", "f"])

    blobs = docs.select("lang", "text").mapInArrow(edges, BLOB)
    for k in range(LONGEST, 1, -1):
        blobs = blobs.groupBy("bucket").applyInArrow(flow(k), BLOB)
    return blobs.mapInArrow(rows, GRAMS)


W = [f"w{k}" for k in range(1, LONGEST + 1)]


def _key(parts: list[str]) -> Column:
    return F.xxhash64(F.lit(len(parts)), *parts)


def _nodes(grams: DataFrame, k: int) -> DataFrame:
    """Phrases of k words -> with out and into: the largest count of one that begins or ends with it and is a word longer."""
    edges = grams.where(F.col("k") == k + 1)
    sides = [edges.groupBy(*(F.col(c).alias(W[j]) for j, c in enumerate(parts))).agg(F.max("f").alias(name)) for name, parts in (("out", W[:k]), ("into", W[1 : k + 1]))]
    return grams.where(F.col("k") == k).join(sides[0], W[:k], "left").join(sides[1], W[:k], "left")


def compact(grams: DataFrame) -> DataFrame:
    """Phrases of four words and three -> w1 to w4, f, path, place: edges joined to unary paths over nodes with one way in and out.

    path is the first edge's hash. Pointers double each round, so a path of n edges takes log n rounds; an edge of
    a ring of unary nodes, which has no first one, is a path of its own. Rounds are written tables.
    """
    unary = _nodes(grams, 3).where((F.col("f") == F.col("out")) & (F.col("f") == F.col("into"))).select(*W[:3])
    edges = grams.where("k = 4").withColumn("edge", _key(W))
    ends = edges.join(unary, W[:3], "left_semi").select(F.col("edge").alias("next"), *W[:3])
    before = edges.join(unary.toDF(*W[1:]), W[1:], "left_semi").select(F.col("edge").alias("before"), *(F.col(c).alias(W[j]) for j, c in enumerate(W[1:])))
    back = ends.join(before, W[:3]).select(F.col("next").alias("edge"), F.col("before").alias("to"), F.lit(1).alias("steps"))
    now = write_table(edges.select("edge").join(back, "edge", "left").select("edge", F.coalesce("to", "edge").alias("to"), F.coalesce("steps", F.lit(0)).alias("steps")), "phrase-paths")
    most = max(1, now.count()).bit_length() + 1
    for _ in range(most):
        far = now.select(F.col("edge").alias("to"), F.col("to").alias("further"), F.col("steps").alias("more"))
        new = write_table(now.join(far, "to").select("edge", F.col("further").alias("to"), (F.col("steps") + F.col("more")).cast("int").alias("steps")), "phrase-paths")
        moved = new.join(now, ["edge", "to"], "left_anti").head(1)
        drop_table(now)
        now = new
        if not moved:
            break
    heads = now.where("steps = 0").select(F.col("edge").alias("to"), F.lit(True).alias("led"))
    path = now.join(heads, "to", "left").select("edge", F.when(F.col("led"), F.col("to")).otherwise(F.col("edge")).alias("path"), F.when(F.col("led"), F.col("steps")).otherwise(0).alias("place"))
    return edges.join(path, "edge").select(*W, "f", "path", "place")


def _look_up(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """Rows with their key's values; keys that many rows have are told to all tasks."""
    classes = rows.groupBy(key).agg(F.count("*").alias("n")).join(table, key)
    return join_classes(rows, classes, key, rows.count())


def collocations(docs: DataFrame, least: int = 30, share: int = 80, most: int = 2000) -> DataFrame:
    """Rows of (lang, text) -> lang, rank, phrase, a, l, r, n, score: each language's ``most`` best phrases.

    A phrase of two to four words occurs a times, ``least`` or more. Its score is the smallest of 2000000 * a / (l + r),
    rounded down, over its cuts into a first part of l occurrences and a rest of r. It gives way to a longer one that
    holds it and has ``share`` percent of its occurrences or more. n: all words of the language.
    """
    vocabulary = write_table(count_words(docs), "phrase-words")
    frequent = vocabulary.where(F.col("n") >= least)
    grams = write_table(count_phrases(docs, Frequent(frequent, NUMBERED), least), "phrase-counts")
    held = [grams.where("k = 4")]
    for k in (3, 2):
        inside = (F.col("f") == F.col("out")) & (F.col("f") == F.col("into"))  # of a unary path
        longer = F.coalesce(F.greatest("out", "into"), F.lit(0)).cast("decimal(20,0)")
        held.append(_nodes(grams, k).where(~F.coalesce(inside, F.lit(False))).where(longer * 100 < F.col("f").cast("decimal(20,0)") * share).select(*grams.columns))
    kept = write_table(held[0].union(held[1]).union(held[2]), "phrase-kept")
    counts = frequent.select(_key(["h"]).alias("key"), F.col("n").alias("c"))
    for k in range(2, LONGEST):
        counts = counts.union(grams.where(F.col("k") == k).select(_key(W[:k]).alias("key"), F.col("f").alias("c")))
    cuts = [(k, c, _key(W[:c]), _key(W[c:k])) for k in range(2, LONGEST + 1) for c in range(1, k)]
    parts = F.array_compact(F.array(*(F.when(F.col("k") == k, F.struct(F.lit(c).alias("cut"), left.alias("left"), right.alias("right"))) for k, c, left, right in cuts)))
    cut = write_table(kept.withColumn("x", F.explode(parts)).select("k", *W, "f", "x.*"), "phrase-cuts")
    both = _look_up(cut.withColumnRenamed("left", "key"), "key", counts).drop("key").withColumnRenamed("c", "l")
    both = _look_up(write_table(both, "phrase-cuts").withColumnRenamed("right", "key"), "key", counts).drop("key").withColumnRenamed("c", "r")
    score = F.expr("(cast(f as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = both.groupBy("k", *W).agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("s"), F.first("f").alias("a"))
    scored = write_table(scored.select("k", *W, "a", "s.*"), "phrase-scores")
    spelt = scored.select(*W, F.posexplode(F.slice(F.array(*W), 1, F.col("k"))).alias("at", "h"))
    spelt = _look_up(write_table(spelt, "phrase-words-of"), "h", frequent.select("h", "lang", "word"))
    named = spelt.groupBy(*W).agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    totals = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    out = scored.join(named, W).withColumn("part", F.pmod(F.xxhash64(*W), F.lit(PARTS)))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= most)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= most)
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
