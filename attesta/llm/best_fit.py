"""Packing of tokenised documents into sequences by bulk-synchronous best fit.

Documents become token ids with an end id. Only longer ones than a sequence are
cut, into whole sequences after a first piece of what is left over. Pieces of
equal length are alike to the packing, and so are gaps of equal size: both are
runs, a first rank and a number. A round sorts the runs of waiting pieces and of
gaps by size into ranges, and sweeps each range from large to small: a piece
takes the smallest gap not smaller than itself that no piece before it took (its
successor), where pieces that want the same gaps come in order of their rank.
What has no match inside its range meets in a sweep over the ranges' rests. The
gaps are then updated (those that stay in a sweep's own range at once), and the
next round begins; when no gap is left for the shortest waiting pieces, as many
sequences as the tokens need are opened. Pieces wait in bands of length, long
before short, as best fit decreasing has them.

Ranks come from the tasks that read the texts: each numbers its pieces of a
length, and prefix sums over tasks make that a rank in the corpus. So the rounds
work on at most a few runs for each length up to ``capacity``, whatever the
corpus, and the pieces move once, when they look up their place.

Defined results: a null text is empty, a document of the end id alone; null or
repeated ids and repeated rows are documents of their own; an empty table gives
an empty result; texts are read whole, however long; other columns of the input
are not read. Which of several pieces of one length gets which place depends on
the input's partitions; how many sequences there are doesn't.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.llm.shared import write_table

TOKENIZER, RANKS, SPECIAL, END = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "<|endoftext|>", 0
#: Beyond these code points two libraries' Unicode tables may differ.
_WIDE = re.compile("[^\x00-ɏ]")
#: Lengths of a band are within this factor; sizes of a range are so many.
BAND, RANGE = 4, 256


@cache
def _encoders():
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    quick = tiktoken.Encoding("attesta-pack", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Tokenizer.from_file(public_tokenizers.path(TOKENIZER)), quick


def encode(text: str) -> array:
    """Ids of ``TOKENIZER`` without added tokens, as 32-bit numbers, and the end id.

    Texts of Latin letters without its special token take the same vocabulary through a library that is quicker.
    """
    whole, quick = _encoders()
    if _WIDE.search(text) or SPECIAL in text:
        ids = array("I", whole.encode(text, add_special_tokens=False).ids)
    else:
        ids = array("I", quick.encode_ordinary(text))
    ids.append(END)
    return ids


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def pieces(docs: DataFrame, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Rows of (doc_id, text) -> pieces, each with its task and its rank among that task's pieces of its length."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())])
    if with_ids:
        schema = schema.append(pa.field("ids", pa.list_(pa.int32())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            out, held = [], 0
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = encode(text.as_py() or "")
                first = (len(ids) - 1) % capacity + 1
                for k, start in enumerate([0, *range(first, len(ids), capacity)]):
                    own = ids[start : start + capacity] if k else ids[:first]
                    n = len(own)
                    row = (doc, k, start, n, zlib.crc32(own.tobytes()), part, seen[n])
                    out.append((*row, np.frombuffer(own, np.int32)) if with_ids else row)
                    seen[n] += 1
                    held += 1 + with_ids * n
                if held >= 1 << 20:
                    yield batch(out)
                    out, held = [], 0
            if out:
                yield batch(out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


GAP, PIECE, PLACED, UPDATED = range(4)
RUNS = "kind int, size long, first long, n long, per long, sequence long, offset long"
COLUMNS = [x.split()[0] for x in RUNS.split(", ")]


def sweep(rows: list[tuple], capacity: int, lowest: int = 1) -> list[tuple]:
    """Runs of gaps and pieces -> placed runs, updated gaps, and the gaps and pieces that found no match.

    (kind, size, first, n, per, sequence, offset): a run of gaps stands for the sequences first to first + n - 1; a run of
    pieces for the ranks first to first + n - 1 of its length. Placed: ``per`` pieces in each of the sequences from
    ``sequence`` on, the first of them at ``offset``. Updated gaps of ``lowest`` or more are taken up in this sweep already.
    """
    out, stack = [], []  # the smallest gap on top
    todo = [(-r[1], *r[:1], *r[2:4]) for r in rows]
    heapify(todo)
    while todo:
        size, kind, first, n = heappop(todo)
        size = -size
        if kind != PIECE:
            stack.append((size, first, n))
            continue
        while n and stack:
            gap, sequence, m = stack.pop()
            per = min(gap // size, n)
            used = min(m, n // per)
            out.append((PLACED, size, first, used * per, per, sequence, capacity - gap))
            first, n, left = first + used * per, n - used * per, gap - per * size
            if left:
                if left >= lowest:
                    heappush(todo, (-left, GAP, sequence, used))
                else:
                    out.append((UPDATED, left, sequence, used, 0, 0, 0))
            if m > used:
                stack.append((gap, sequence + used, m - used))
        if n:
            out.append((PIECE, size, first, n, 0, 0, 0))
    return out + [(GAP, *x, 0, 0, 0) for x in stack]


def _swept(runs: DataFrame, range_size: int | None, capacity: int) -> DataFrame:
    """Each range of sizes swept by itself, in a task; None: all in one."""
    key = F.floor(F.col("size") / range_size) if range_size else F.lit(0)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [tuple(map(int, r)) for r in pdf[COLUMNS].itertuples(index=False)]
        return pd.DataFrame(sweep(rows, capacity, rows[0][1] // range_size * range_size if range_size else 1), columns=COLUMNS)

    return runs.groupBy(key.alias("range")).applyInPandas(work, RUNS)


def _round(spark: SparkSession, runs: list[tuple], capacity: int) -> list[tuple]:
    """A sweep by ranges of size, then one over what the ranges leave. The runs are few: at most some for each size."""
    by_range = _swept(spark.createDataFrame(runs, RUNS), RANGE, capacity)
    rest = _swept(by_range.where(F.col("kind") <= PIECE), None, capacity)
    return [tuple(r) for r in by_range.where(F.col("kind") > PIECE).union(rest).collect()]


def pack_runs(counts: dict[int, int], capacity: int, one_round) -> list[tuple]:
    """Numbers of pieces by length -> placed runs. ``one_round`` sweeps runs; lengths are at most ``capacity``."""
    placed, gaps, opened, high = [], [], 0, capacity
    while high:
        low = high // BAND
        waiting = [(PIECE, k, 0, n, 0, 0, 0) for k, n in counts.items() if low < k <= high and n]
        while waiting:
            least = min(r[1] for r in waiting)
            if not any(g[1] >= least for g in gaps):
                need = -(-sum(r[1] * r[3] for r in waiting) // capacity)
                gaps.append((GAP, capacity, opened, need, 0, 0, 0))
                opened += need
            apart = [g for g in gaps if g[1] < least]
            told = one_round(waiting + [g for g in gaps if g[1] >= least])
            placed += [r for r in told if r[0] == PLACED]
            waiting = [r for r in told if r[0] == PIECE]
            gaps = apart + [(GAP, *r[1:]) for r in told if r[0] in (GAP, UPDATED)]
        high = low
    return placed


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """A written table of ``pieces`` -> the same with sequence_id and offset in place of part and rank."""
    spark = cut.sparkSession
    cells = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    cells = write_table(cells.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")), "pack-cells")
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    placed = np.array(sorted(r[1:] for r in pack_runs(counts, capacity, lambda runs: _round(spark, runs, capacity))), np.int64).reshape(-1, 6)
    ranked = cut.join(cells.select("part", "length", "before"), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    more = [c for c in cut.columns if c not in ("part", "rank")]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, first, _, per, sequence, offset = placed.T
        keys = size << 44 | first
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            run = np.searchsorted(keys, length << 44 | rank, "right") - 1
            row, at = np.divmod(rank - first[run], per[run])
            out = [b.column(c) for c in more]
            yield pa.RecordBatch.from_arrays([*out, pa.array(sequence[run] + row), pa.array(offset[run] + at * length)], names=[*more, "sequence_id", "offset"])

    return ranked.select(*more, "rank").mapInArrow(look_up, PACKED.replace(", sequence", ", ids array<int>, sequence") if "ids" in more else PACKED)


def pack_documents(docs: DataFrame, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Rows of (doc_id, text) -> each piece's place; with_ids: and its ids, for ``sequences``."""
    return pack(write_table(pieces(docs, capacity, with_ids), "pack-pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """Places with ids -> sequence_id, ids: what a trainer reads. A sequence has at most ``capacity`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
