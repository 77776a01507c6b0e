"""Removing repeated strings with a logarithmic family of suffix arrays.

Every byte covered by a ``length``-byte string that also starts earlier (in a
smaller doc_id, or earlier in the same document) is removed.

1. Of every ``length`` bytes the k bytes with the smallest hash are an anchor:
   equal strings have the same anchor at the same place. Anchors that occur once
   are put aside.
2. The suffixes that begin at the other anchors, and the bytes before them, are
   dealt out by the anchor's hash.
3. In each bucket they come in batches in the order of the corpus. A batch gets
   its suffix array; it is scanned against itself and each existing level, where
   common prefixes of suffixes, and of what stands before them, say which strings
   are repeated. It then becomes a level; equal-sized levels merge, so there are
   as many as the logarithm of the batches.
4. Spans come back to their documents.

Defined results: a null text is empty; strings are compared as UTF-8 bytes and
never reach over the end of a text; different texts of one doc_id are documents
of their own, in the order of a hash; rows that agree in id and text count as one
document and get the same result each; a null doc_id counts as the smallest; a
text may have up to 2 GB (its anchors are sought in pieces); empty tables give
empty results; other columns of the input are not read. Rows are told apart by a
hash of id and text with 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm import textnum
from attesta.llm.shared import BLOB, BLOB_ARROW, n_buckets, pack, unpack
from attesta.llm.textnum import Texts, mix, powers, same, texts

LENGTH, K = 100, 32
#: Suffixes of a batch.
BATCH = 1 << 15
#: Bytes of a long text that are searched for anchors at a time.
PIECE = 1 << 22
_POS = 27


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes at each place."""
    pw, ip = powers(len(data) + 1)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(textnum._R[data] * pw[:-1], out=c[1:])
    return mix((c[k:] - c[:-k]) * ip[: len(data) - k + 1])


def anchors(t: Texts, length: int, k: int, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all anchors, their hashes and texts. One long text is read in pieces that share ``length`` - 1 bytes."""
    none = np.zeros(0, np.int64)
    if len(t.data) < length:
        return none, none.astype(np.uint64), none
    if len(t) == 1 and len(t.data) >= piece + length:
        parts = []
        for a in range(0, len(t.data) - length + 1, piece):
            data = t.data[a : a + piece + length - 1]
            at, h, _ = anchors(Texts(data, np.array([0, len(data)]), 0), length, k, piece)
            parts.append((at + a, h))
        at, first = np.unique(np.concatenate([x for x, _ in parts]), return_index=True)
        return at, np.concatenate([h for _, h in parts])[first], np.zeros(len(at), np.int64)
    h = gram_hashes(t.data, k)
    m = (h >> np.uint64(_POS) << np.uint64(_POS)) | np.arange(len(h), dtype=np.uint64)
    w, have = length - k + 1, 1
    while 2 * have <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < w:
        m = np.minimum(m[: len(m) - (w - have)], m[w - have :])
    inside = np.zeros(len(t.data) + 1, np.int8)  # windows that don't reach over the end of a text
    size = np.diff(t.off)
    full = size >= length
    np.add.at(inside, t.off[:-1][full], 1)
    np.add.at(inside, t.off[1:][full] - length + 1, -1)
    m = m[np.cumsum(inside)[: len(m)] > 0] & np.uint64((1 << _POS) - 1)
    at = np.unique(m[same(m)]).astype(np.int64)
    return at, h[at], np.searchsorted(t.off, at, "right") - 1


#: part: the upper bits of an anchor's hash; should two anchors agree in it and the bucket, both only come further than needed.
SEEN = np.dtype([("part", "<u4"), ("row", "<i8"), ("pos", "<i4")])
_HASHED = np.dtype([("hash", "<u8"), ("row", "<i8"), ("pos", "<i4")])


def squeezed(records: np.ndarray, bucket: np.ndarray, kind: int) -> pa.RecordBatch:
    """``pack``, each blob as its length and Zstandard: contexts of neighbours say the same bytes, which short blocks of the shuffle's own codec don't see."""
    zstd = pa.Codec("zstd", compression_level=3)
    b = pack(records, bucket, kind)
    data = [len(x).to_bytes(8, "little") + zstd.compress(x, asbytes=True) for x in b.column(2).to_pylist()]
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.binary())], schema=BLOB_ARROW)


def unsqueezed(column: pa.ChunkedArray, dtype: np.dtype) -> np.ndarray:
    """All records of a column of ``squeezed`` blobs."""
    zstd = pa.Codec("zstd")
    parts = []
    for x in column:
        raw = memoryview(x.as_buffer())
        parts.append(np.frombuffer(zstd.decompress(raw[8:], int.from_bytes(raw[:8], "little")), dtype))
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _places(row: np.ndarray, pos: np.ndarray) -> pa.Table:
    """A row for each document with its places."""
    order = np.argsort(row, kind="stable")
    row, pos = row[order], pos[order].astype(np.int32)
    at = np.flatnonzero(same(row))
    return pa.table({"row": pa.array(row[at]), "places": pa.ListArray.from_arrays(pa.array(np.r_[at, len(row)].astype(np.int32)), pa.array(pos))})


_PLACES = "row long, places array<int>"


def _anchor_blobs(docs: DataFrame, length: int, k: int, buckets: int) -> DataFrame:
    """kind 0: anchors by hash; of those that a task has more than once only a sign (place -1). kind 1: the places of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            r = np.concatenate(held)
            held.clear()
            r = r[np.argsort(r["hash"], kind="stable")]
            first = same(r["hash"])
            alone = first & np.r_[first[1:], True]
            for kind, own in ((0, r[first]), (1, r[~alone])):
                out = np.zeros(len(own), SEEN)
                out["part"], out["row"], out["pos"] = own["hash"] >> np.uint64(32), own["row"], own["pos"]
                if not kind:
                    out["pos"][~alone[first]] = -1
                by = (own["hash"] & np.uint64(0xFFFFFFFF)) % np.uint64(buckets) if not kind else own["row"] % buckets
                yield pack(out, by.astype(np.int32), kind)

        for b in batches:
            rows = b.column("row").to_numpy()
            for t in texts(b.column("text")):
                at, h, doc = anchors(t, length, k)
                r = np.zeros(len(at), _HASHED)
                r["hash"], r["row"], r["pos"] = h, rows[t.first + doc], at - t.off[doc]
                held.append(r)
                if sum(map(len, held)) > 500_000:
                    yield from flush()
        if held:
            yield from flush()

    return docs.mapInArrow(run, BLOB)


def _repeated(table: pa.Table) -> pa.Table:
    """Places of a bucket's anchors that more than one task has, and those that came as repeated."""
    kind = table.column("kind").to_numpy()
    r = unpack(table.filter(pa.array(kind == 0)).column("data"), SEEN)
    r = r[np.argsort(r["part"], kind="stable")]
    first = same(r["part"])
    r = r[~(first & np.r_[first[1:], True]) & (r["pos"] >= 0)]
    more = unpack(table.filter(pa.array(kind == 1)).column("data"), SEEN)
    return _places(np.r_[r["row"], more["row"]], np.r_[r["pos"], more["pos"]])


def context_dtype(length: int, k: int) -> np.dtype:
    return np.dtype([("doc", "<i8"), ("row", "<i8"), ("pos", "<i4"), ("a", "<i2"), ("b", "<i2"), ("right", f"S{length}"), ("left", f"S{length - k}")])


def contexts(data: np.ndarray, off: np.ndarray, doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, rows: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each place the bytes from it on, and those before it backwards; 1 is added, so that 0 stands for none. And the anchors' hashes."""
    out = np.zeros(len(pos), context_dtype(length, k))
    at = off[doc] + pos
    out["doc"], out["row"], out["pos"] = ids[doc], rows[doc], pos
    a, b = np.minimum(pos, length - k), np.minimum(off[doc + 1] - at, length)
    out["a"], out["b"] = a, b
    padded = np.concatenate([data + np.uint8(1), np.zeros(length, np.uint8)])
    right = padded[at[:, None] + np.arange(length)]
    right[np.arange(length) >= b[:, None]] = 0
    left = padded[at[:, None] - 1 - np.arange(length - k)]
    left[np.arange(length - k) >= a[:, None]] = 0
    out["right"], out["left"] = np.ascontiguousarray(right).view(f"S{length}").ravel(), np.ascontiguousarray(left).view(f"S{length - k}").ravel()
    pw, _ = powers(k + 1)
    return out, mix((textnum._R[right[:, :k] - np.uint8(1)] * pw[:k]).sum(axis=1, dtype=np.uint64))


def _prefixes(column: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each entry with the one before it in a sorted order."""
    width = column.dtype.itemsize
    x = np.ascontiguousarray(column[order]).view(np.uint8).reshape(-1, width)
    differ = x[1:] != x[:-1]
    return np.r_[0, np.where(differ.any(axis=1), differ.argmax(axis=1), width)]


def repeats(c: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts in the order of the corpus -> of each the most bytes before and behind its place that repeated strings cover; -1: none."""
    most, least = np.full(len(c), -1), np.full(len(c), length + 1)
    order_r, order_l = np.argsort(c["right"], kind="stable"), np.argsort(c["left"], kind="stable")
    lcp_r, lcp_l = _prefixes(c["right"], order_r), _prefixes(c["left"], order_l)
    kind_r, kind_l = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
    for o in range(length - k + 1):
        kind_r[order_r] = np.cumsum(lcp_r < length - o)
        kind_l[order_l] = np.cumsum(lcp_l < o)
        ok = np.flatnonzero((c["a"] >= o) & (c["b"] >= length - o))
        ok = ok[np.bincount(kind_r[ok], minlength=1)[kind_r[ok]] > 1]
        key = kind_l[ok] * (len(c) + 1) + kind_r[ok]
        by = np.argsort(key, kind="stable")
        later = ok[by[~same(key[by])]]
        most[later] = o
        least[later] = np.minimum(least[later], o)
    return most, np.where(most < 0, -1, length - least)


class Family:
    """Levels of suffix arrays; each batch stands behind all earlier ones in the corpus."""

    def __init__(self, length: int = LENGTH, k: int = K):
        self.length, self.k = length, k
        self.levels: list[np.ndarray] = []

    def add(self, batch: np.ndarray) -> np.ndarray:
        """Spans (row, first byte, end) of the batch that earlier strings repeat."""
        before, behind = repeats(batch, self.length, self.k)
        heads = np.unique(batch["right"].astype(f"S{self.k}"))
        for level in self.levels:
            own = level["right"].astype(f"S{self.k}")  # sorted, as the level is
            begin, end = np.searchsorted(own, heads, "left"), np.searchsorted(own, heads, "right")
            take = np.repeat(begin - np.cumsum(end - begin) + (end - begin), end - begin) + np.arange((end - begin).sum())
            if len(take):
                a, b = repeats(np.concatenate([level[take], batch]), self.length, self.k)
                before, behind = np.maximum(before, a[len(take) :]), np.maximum(behind, b[len(take) :])
        self.levels.append(batch[np.argsort(batch["right"], kind="stable")])
        while len(self.levels) > 1 and len(self.levels[-2]) <= len(self.levels[-1]):
            both = np.concatenate([self.levels[-2], self.levels[-1]])
            self.levels[-2:] = [both[np.argsort(both["right"], kind="stable")]]
        hit = before >= 0
        out = np.zeros(int(hit.sum()), SPAN)
        out["row"], out["start"], out["end"] = batch["row"][hit], batch["pos"][hit] - before[hit], batch["pos"][hit] + behind[hit]
        return out


def _spans(r: np.ndarray) -> np.ndarray:
    """Spans of one document that touch become one."""
    r = r[np.lexsort((r["start"], r["row"]))]
    if not len(r):
        return r
    base = np.cumsum(same(r["row"])) << 32
    reach = np.maximum.accumulate(r["end"] + base)
    at = np.flatnonzero(np.r_[True, (r["start"] + base)[1:] > reach[:-1]])
    out = r[at]
    out["end"] = (reach[np.r_[at[1:] - 1, len(r) - 1]] & 0xFFFFFFFF).astype(np.int32)
    return out


SPAN = np.dtype([("row", "<i8"), ("start", "<i4"), ("end", "<i4")])


def _context_blobs(rows: DataFrame, length: int, k: int, buckets: int) -> DataFrame:
    """doc_id, row, text, places -> contexts by hash; of equal ones in a task the first, whose copies' spans come as kind 1."""
    kind = context_dtype(length, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            r, h = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((r["pos"], r["row"], r["doc"], h))
            r, h = r[order], h[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (r["row"][1:] != r["row"][:-1]) | (r["pos"][1:] != r["pos"][:-1])] if len(r) else np.zeros(0, bool)
            r, h = r[new], h[new]
            raw = r.view(np.uint8).reshape(len(r), kind.itemsize)[:, kind.fields["right"][1] :]
            pw, _ = powers(raw.shape[1])
            body = np.zeros(len(r), np.uint64)
            for x in range(0, len(r), 10_000):
                body[x : x + 10_000] = mix((textnum._R[raw[x : x + 10_000]] * pw).sum(axis=1, dtype=np.uint64))
            by = np.argsort(body, kind="stable")  # stable: the first of equal ones is the first of the corpus
            again = ~same(body[by])
            whom = by[np.flatnonzero(~again)[np.cumsum(~again) - 1]] if len(by) else by
            again &= (raw[by] == raw[whom]).all(axis=1)
            x = r[by[again]]
            copies = x[x["a"] + x["b"] >= length]
            s = np.zeros(len(copies), SPAN)
            s["row"], s["start"], s["end"] = copies["row"], copies["pos"] - copies["a"], copies["pos"] + copies["b"]
            own = by[~again]
            yield squeezed(r[own], (h[own] % np.uint64(buckets)).astype(np.int32), 0)
            s = _spans(s)
            yield squeezed(s, (s["row"] % buckets).astype(np.int32), 1)

        for b in batches:
            ids, keys = b.column("doc_id").to_numpy(), b.column("row").to_numpy()
            for t in texts(b.column("text")):
                own = [np.unique(np.concatenate([np.asarray(x, np.int64) for x in b.column("places")[t.first + d].as_py()])) for d in range(len(t))]
                doc = np.repeat(np.arange(len(t)), [len(x) for x in own])
                pos = np.concatenate(own)
                ok = np.flatnonzero(pos + k <= np.diff(t.off)[doc])
                mine = slice(t.first, t.first + len(t))
                for x in range(0, len(ok), 100_000):
                    some = ok[x : x + 100_000]
                    held.append(contexts(t.data, t.off, doc[some], pos[some], ids[mine], keys[mine], length, k))
                    if sum(len(x) for x, _ in held) > 150_000:
                        yield from flush()
        if held:
            yield from flush()

    return rows.mapInArrow(run, BLOB)


#: Columns that tell a row from others and that hold what repeats of it.
ROW, SPANS = "attesta suffix row", "attesta suffix spans"


def with_spans(docs: DataFrame, length: int = LENGTH, k: int = K, batch: int = BATCH) -> DataFrame:
    """The rows of ``docs``, all columns, with ``SPANS``: lists of byte spans to remove, which may overlap; null: none.

    Rows meet their anchors' places, and later their spans, by one and the same exchange of all columns: texts
    are dealt out once. So nothing is cut off in between, and only this exchange waits for the end.
    """
    buckets = n_buckets(docs.sparkSession)
    keyed = docs.withColumn(ROW, _row())
    row = F.col(f"`{ROW}`")
    # null ids become the smallest
    whole = (F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), row.alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    placed = _anchor_blobs(keyed.select(*whole), length, k, buckets).groupBy("bucket").applyInArrow(_repeated, _PLACES)
    placed = placed.groupBy(F.col("row").alias(ROW)).agg(F.collect_list("places").alias("attesta suffix places"))
    others = [F.col(f"`{c}`").alias(f"other {i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]  # else they would be left out of this exchange, and it made twice
    rows = keyed.join(placed, ROW).select(*whole, F.col("`attesta suffix places`").alias("places"), *others)

    def work(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        c = unsqueezed(table.filter(pa.array(kind == 0)).column("data"), context_dtype(length, k))
        c = c[np.lexsort((c["pos"], c["row"], c["doc"]))]
        family = Family(length, k)
        found = [family.add(c[x : x + batch]) for x in range(0, len(c), batch)]
        found.append(unsqueezed(table.filter(pa.array(kind == 1)).column("data"), SPAN))
        s = _spans(np.concatenate(found))
        at = np.flatnonzero(same(s["row"]))
        pairs = pa.StructArray.from_arrays([pa.array(s["start"]), pa.array(s["end"])], ["start", "end"])
        return pa.table({"row": pa.array(s["row"][at]), "spans": pa.ListArray.from_arrays(pa.array(np.r_[at, len(s)].astype(np.int32)), pairs)})

    spans = _context_blobs(rows, length, k, buckets).groupBy("bucket").applyInArrow(work, "row long, spans array<struct<start:int,end:int>>")
    spans = spans.groupBy(F.col("row").alias(ROW)).agg(F.flatten(F.collect_list("spans")).alias(SPANS))
    return keyed.join(spans, ROW, "left").drop(ROW)


def _row() -> F.Column:
    """What tells documents apart: a hash of id and text, whatever is null."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, batch: int = BATCH, keep: bool = False) -> DataFrame:
    """Rows of (doc_id, text) -> a row each: bytes, removed bytes, removed runs, digest of the rest, and the rest where ``keep``."""
    found = with_spans(docs.select("doc_id", "text"), length, k, batch)
    found = found.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col(f"`{SPANS}`").alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column("spans")
            for t in texts(b.column("text")):
                out = []
                for d in range(len(t)):
                    raw = t.bytes(d)
                    runs: list[list[int]] = []
                    for s in sorted((s["start"], s["end"]) for s in spans[t.first + d].as_py() or ()):
                        if runs and s[0] <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], s[1])
                        else:
                            runs.append([s[0], s[1]])
                    kept, at = [], 0
                    for x, y in runs:
                        kept.append(raw[at:x])
                        at = y
                    rest = b"".join([*kept, raw[at:]])
                    out.append((len(raw), len(raw) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest if keep else None))
                cols = [pa.array(x, y) for x, y in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(t.first, len(t)), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return found.mapInArrow(run, REMOVED)


def strip_repeats(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """The rows of ``docs``, all columns, with repeated strings cut out of ``text`` (broken characters at the cuts go too); n_chars follows where there is one."""
    rows = with_spans(docs, length, k)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            text = b.column(names.index("text")).to_pylist()
            for d, spans in enumerate(b.column(len(names))):
                if spans.is_valid and text[d] is not None:
                    raw, kept, at = text[d].encode(), [], 0
                    for x, y in sorted((s["start"], s["end"]) for s in spans.as_py()):
                        kept.append(raw[at : max(at, x)])
                        at = max(at, y)
                    text[d] = b"".join([*kept, raw[at:]]).decode("utf-8", "ignore")
            cols = [pa.array(text, b.column(k).type) if n == "text" else b.column(k) for k, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    out = rows.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
