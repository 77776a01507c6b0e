"""Exact Jaccard join of word shingle sets, with set relations skipping work.

A document's set holds its distinct shingles of ``k`` words; two link when the
intersection has at least ``percent`` in a hundred of the union.

1. Equal sets are one class from here on (a set's digest has 64 bits).
2. Shingles are ordered by hash, with frequent ones last, and each set posts its
   prefix: two sets that link share a shingle there. Most shingles are in no other
   prefix. So prefixes are first dealt out as four bytes a shingle, and a bitmap
   of bounded size tells all tasks which shingles came twice: only these are
   posted. (One that just shares a bit is a list of one.) Postings of a shingle are a
   list; the lists of a bucket are worked on together. Shingles that very many
   documents have are no lists in one task: their postings go on as they are, to
   the smallest digest among them, which a grouped minimum finds.
3. Lists are sorted by set size and position and cut into blocks. Pairs of blocks
   whose sizes and positions rule out every link are skipped as a whole; of the
   others, postings without a partner that could link are left out.
4. What is left of a list goes to its hub, the smallest digest. In a hub's group
   each set is held as what it has more and less than the hub. The overlap of two
   sets then follows from the hub's answers and those small differences, and is
   only looked at where a bound from both allows a link and the two aren't in one
   component yet. So a list of n sets costs n rows, not n * n pairs.
5. A long list is dealt to cells of about ``chunk`` sets, each with the hub. What
   is not in the hub's component there is then held against the other cells, again
   in chunks; what the hub has linked needs no look at each other. So no task has
   more than a cell, however many sets a list has. Only texts of sets in a list
   are dealt out, each in Zstandard from the first exchange on.
   Before that, sets of lists of one cell are sieved by sketches, a bit for the
   parity of the shingles that fall on it: sketches differ in no more bits than
   their sets in shingles, so what can't link with any other goes without its text.
6. Components of all groups are merged.

Defined results: a null or empty text has an empty set, no link, and its own id
as component; fewer than k words make one shingle; rows of a repeated id count
each and share the component of any of them only where their texts link; rows
without an id link like others, a component's id is the smallest that there is,
null if none is there; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.components import components
from attesta.llm.shared import BLOB, Packer, drop_table, join_classes, may_be_in, n_buckets, pack, unpack, write_table
from attesta.llm.textnum import LOWER, SPACE, Texts, mix, same, texts, windows, words

#: Frequent shingles that are put last, at most; any choice gives the same result.
FREQUENT = 200_000
_TOP = np.uint64(1 << 63)
HELD = np.dtype([("token", "<u8"), ("key", "<u8")])
POSTING = np.dtype([("token", "<u8"), ("key", "<u8"), ("prev", "<u8"), ("n", "<i4"), ("pos", "<i4")])
#: Documents with a shingle from which on its postings don't meet in one task: so many, and a thousandth of all.
HOT = 5_000
#: Postings in a block of a list; lists of FEW or less are not cut.
BLOCK, FEW = 64, 10
#: Sets in a cell of a long list, about.
CHUNK = 256
#: Bits that tell which shingles are in two prefixes: 2 ** BITS at most. Shingles a task holds before it deals them out.
BITS, GATHERED = 27, 1_000_000


def shingles(t: Texts, k: int, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The sets of all texts one behind the other, each sorted, and where each begins. ``last``: shingles to sort last."""
    w = words(t, SPACE, LOWER)
    value, _, doc = windows(w.hashes(), w, k, short=True)
    value >>= np.uint64(1)
    if last is not None and len(last):
        at = np.searchsorted(last, value)
        at[at == len(last)] = 0
        value[last[at] == value] |= _TOP
    off = np.searchsorted(doc, np.arange(len(t) + 1))
    for a, b in zip(off[:-1], off[1:], strict=True):
        value[a:b].sort()
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.r_[0, np.cumsum(new)][off]


def digests(value: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A digest of each set, whatever its order; 0 for an empty one."""
    n = np.diff(off)
    plain = mix(value & ~_TOP)
    c = np.r_[np.zeros(1, np.uint64), np.cumsum(plain, dtype=np.uint64)]
    d = np.r_[np.zeros(1, np.uint64), np.cumsum(mix(plain ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)]
    out = mix((c[off[1:]] - c[off[:-1]]) ^ mix((d[off[1:]] - d[off[:-1]]) + n.astype(np.uint64)))
    out[n == 0] = 0
    return out


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The smallest intersection of sets of a and b shingles that link."""
    return -(-percent * (a + b) // (100 + percent))


def _profile(docs: DataFrame, k: int) -> DataFrame:
    """kind 0: a row for each document, kind 1: shingles that are frequent where they were read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        often: list[tuple[np.ndarray, np.ndarray]] = []

        def count() -> None:
            v, n = np.unique(np.concatenate(held), return_counts=True)
            often.append((v[n > 1], n[n > 1]))
            held.clear()

        def rows(kind, row, ids, key, n):
            m = len(key)
            return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)), row, ids, pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "row", "doc_id", "key", "n"])

        for b in batches:
            for t in texts(b.column("text")):
                value, off = shingles(t, k)
                held.append(value)
                if sum(map(len, held)) > 1_000_000:
                    count()
                yield rows(0, *(b.column(c).slice(t.first, len(t)) for c in ("row", "doc_id")), digests(value, off), np.diff(off))
        if held:
            count()
        if often:
            v, n = (np.concatenate(x) for x in zip(*often, strict=True))
            order = np.argsort(v, kind="stable")
            v, n = v[order], n[order]
            at = np.flatnonzero(same(v))
            n = np.add.reduceat(n, at) if len(at) else n
            v = v[at]
            none = pa.nulls(int((n > 2).sum()), pa.int64())
            yield rows(1, none, none, v[n > 2], n[n > 2])

    return docs.mapInArrow(run, "kind int, row long, doc_id long, key long, n long")


class Prefixes:
    """The prefixes of the sets that a task hasn't had before."""

    def __init__(self, percent: int):
        self.percent, self.seen = percent, set()

    def __call__(self, value: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """Digests and sizes of all sets; of each shingle in a prefix the set, the place in it, and the place in ``value``."""
        n, key = np.diff(off), digests(value, off)
        fresh = np.zeros(len(n), bool)
        for d, x in enumerate(key.tolist()):
            if x not in self.seen and n[d]:
                self.seen.add(x)
                fresh[d] = True
        p = np.where(fresh, n - (self.percent * n + 99) // 100 + 1, 0)
        doc = np.repeat(np.arange(len(n)), p)
        pos = np.arange(len(doc)) - np.repeat(np.cumsum(p) - p, p)
        return key, n, doc, pos, off[:-1][doc] + pos


def _among(token: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which of ``token`` are in the sorted ``held``."""
    if not len(held):
        return np.zeros(len(token), bool)
    where = np.searchsorted(held, token)
    where[where == len(held)] = 0
    return held[where] == token


def _short(token: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A shingle as its bucket and four bytes more. Two that agree in these are taken for one shingle, which only lets more through."""
    return (token % np.uint64(buckets)).astype(np.int32), (token // np.uint64(buckets)).astype(np.uint32)


def _bit(rest: np.ndarray, width: int) -> np.ndarray:
    """The bit of a shingle among its bucket's."""
    return (mix(rest.astype(np.uint64)) % np.uint64(width)).astype(np.int64)


def _shared(docs: DataFrame, k: int, percent: int, last: Broadcast, hot: Broadcast, buckets: int, postings: int) -> np.ndarray:
    """``buckets`` rows of bits, set for every shingle that two prefixes have or more; ``hot`` ones are left out."""
    width = 8 * max(1, min(1 << BITS, postings) // (8 * buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes, held = Prefixes(percent), []

        def flush() -> pa.RecordBatch:
            v = np.sort(np.concatenate(held))
            held.clear()
            keep = np.ones(len(v), bool)
            keep[2:] = v[2:] != v[:-2]  # twice tells as much as more
            bucket, rest = _short(v[keep], buckets)
            return pack(rest, bucket)

        for b in batches:
            for t in texts(b.column("text")):
                value, off = shingles(t, k, last.value)
                token = value[prefixes(value, off)[-1]]
                held.append(token[~_among(token, hot.value)])
                if sum(map(len, held)) >= GATHERED:
                    yield flush()
        if held:
            yield flush()

    def twice(t: pa.Table) -> pa.Table:
        rest = np.sort(unpack(t.column("data"), np.dtype("<u4")))
        bits = np.zeros(width, bool)
        bits[_bit(rest[1:][rest[1:] == rest[:-1]], width)] = True
        return pa.table({"bucket": t.column("bucket").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros((buckets, width // 8), np.uint8)
    for r in docs.select("text").mapInArrow(run, BLOB).groupBy("bucket").applyInArrow(twice, "bucket int, bits binary").collect():
        out[r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
    return out


def _post(docs: DataFrame, k: int, percent: int, last: Broadcast, hot: Broadcast, shared: Broadcast, buckets: int) -> DataFrame:
    """kind 0: postings by shingle, of those that ``shared`` has; kind 1: those of the ``hot`` shingles, by set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, wide = Packer(POSTING, buckets, "token"), Packer(HELD, buckets, "key", kind=1)
        prefixes, bits = Prefixes(percent), shared.value
        for b in batches:
            for t in texts(b.column("text")):
                value, off = shingles(t, k, last.value)
                key, n, doc, pos, at = prefixes(value, off)
                often = _among(value[at], hot.value)
                held = np.zeros(int(often.sum()), HELD)
                held["token"], held["key"] = value[at][often], key[doc[often]]
                if len(held):
                    yield from wide.add(held)
                bucket, rest = _short(value[at], buckets)
                bit = _bit(rest, 8 * bits.shape[1])
                here = ~often & (bits[bucket, bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
                doc, pos, at = doc[here], pos[here], at[here]
                r = np.zeros(len(doc), POSTING)
                r["token"], r["key"], r["n"], r["pos"] = value[at], key[doc], n[doc], pos
                r["prev"] = np.where(pos > 0, value[np.maximum(at - 1, 0)], np.uint64(0))
                yield from packer.add(r)
        yield from packer.flush()
        yield from wide.flush()

    return docs.select("text").mapInArrow(run, BLOB)


def _may_link(r: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """For pairs of postings of one shingle: may the two sets link, with this as the first shingle that they share?"""
    nx, ny = r["n"][x].astype(np.int64), r["n"][y].astype(np.int64)
    rest = np.minimum(nx - r["pos"][x], ny - r["pos"][y])
    first = (r["pos"][x] == 0) | (r["pos"][y] == 0) | (r["prev"][x] != r["prev"][y])
    return first & (rest >= least_overlap(nx, ny, percent)) & (r["key"][x] != r["key"][y])


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... count[0] of them, then those of begin[1]."""
    return np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())


def hubs(r: np.ndarray, percent: int) -> np.ndarray:
    """Postings -> distinct rows (hub, member), the hub among its own members."""
    r = r[np.argsort(r["token"], kind="stable")]
    head = same(r["token"])
    size = np.diff(np.r_[np.flatnonzero(head), len(r)])
    r = r[np.repeat(size > 1, size)]
    if not len(r):
        return np.zeros((0, 2), np.uint64)
    r = r[np.lexsort((r["key"], r["pos"], r["n"], r["token"]))]
    r = r[np.r_[True, (r["token"][1:] != r["token"][:-1]) | (r["key"][1:] != r["key"][:-1])]]
    head = same(r["token"])
    list_of = np.cumsum(head) - 1
    begin = np.flatnonzero(head)
    end = np.r_[begin[1:], len(r)]
    # blocks of a list: sizes are sorted; a block's smallest position bounds what its sets can still share
    place = np.arange(len(r)) - begin[list_of]
    block_at = np.flatnonzero(place % BLOCK == 0)
    block_end = np.r_[block_at[1:], len(r)]
    low, high = r["n"][block_at].astype(np.int64), r["n"][block_end - 1].astype(np.int64)
    rest = np.maximum.reduceat((r["n"] - r["pos"]).astype(np.int64), block_at)
    of = list_of[block_at]
    last_block = np.searchsorted(of, of, "right")
    keep = np.zeros(len(r), bool)
    size = end - begin
    for m in range(2, FEW + 1):  # short lists of one length at once
        at = begin[size == m]
        for i in range(m if len(at) else 0):
            for j in range(i + 1, m):
                ok = _may_link(r, at + i, at + j, percent)
                keep[at[ok] + i] = True
                keep[at[ok] + j] = True
    for i in np.flatnonzero(size[of] > FEW):  # a block against itself and those behind it in its list
        j = np.arange(i, last_block[i])
        fits = (100 * high[i] >= percent * low[j]) & (np.minimum(rest[i], rest[j]) >= least_overlap(low[i], low[j], percent))
        mine = np.arange(block_at[i], block_end[i])
        for q in j[fits]:
            other = np.arange(block_at[q], block_end[q])
            if keep[mine].all() and keep[other].all():
                continue
            x, y = np.repeat(mine, len(other)), np.tile(other, len(mine))
            if q == i:
                x, y = x[x < y], y[x < y]
            ok = _may_link(r, x, y, percent)
            keep[x[ok]] = True
            keep[y[ok]] = True
    r, list_of = r[keep], list_of[keep]
    if not len(r):
        return np.zeros((0, 2), np.uint64)
    begin = np.flatnonzero(same(list_of))
    hub = np.minimum.reduceat(r["key"], begin)
    out = np.c_[np.repeat(hub, np.diff(np.r_[begin, len(r)])), r["key"]]
    return np.unique(out, axis=0)


class Group:
    """Sets around a hub; ``add`` finds out which components each one joins."""

    def __init__(self, key: int, tokens: np.ndarray, percent: int):
        self.hub, self.percent = tokens, percent
        self.keys = [key]
        self.plus, self.minus = [tokens[:0]], [tokens[:0]]
        # of each set: size, shared with the hub, not in the hub, component, component at first
        self.facts = np.array([[len(tokens)], [len(tokens)], [0], [0], [0]])
        self.placed = 0

    @staticmethod
    def _same(a: np.ndarray, b: np.ndarray) -> int:
        if len(a) > len(b):
            a, b = b, a
        if not len(a):
            return 0
        at = np.searchsorted(b, a)
        at[at == len(b)] = 0
        return int((b[at] == a).sum())

    def place(self, key: int, tokens: np.ndarray, linked: bool) -> None:
        """Takes in a set that was compared before; from now on sets are compared with the placed ones only."""
        self.add(key, tokens, root=0 if linked else len(self.keys), compare=False)
        self.placed = len(self.keys)

    def add(self, key: int, tokens: np.ndarray, root: int | None = None, compare: bool = True) -> None:
        at = np.searchsorted(self.hub, tokens)
        at[at == len(self.hub)] = 0
        hit = self.hub[at] == tokens
        missing = np.ones(len(self.hub), bool)
        missing[at[hit]] = False
        plus, minus = tokens[~hit], self.hub[missing]
        inside, me = int(hit.sum()), len(self.keys)
        if me == self.facts.shape[1]:
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)], axis=1)
        mine = me if root is None else root
        self.facts[:, me] = len(tokens), inside, len(plus), mine, mine
        self.keys.append(key)
        self.plus.append(plus)
        self.minus.append(minus)
        if not compare:
            return
        n, shared, extra, root_of, _ = self.facts[:, : self.placed or me]
        need = least_overlap(n, len(tokens), self.percent)
        spare = np.minimum(shared, inside) + np.minimum(extra, len(plus)) - need
        open_ = np.flatnonzero(spare >= 0)
        open_ = open_[np.argsort(-spare[open_], kind="stable")]
        while len(open_):
            k, open_ = int(open_[0]), open_[1:]
            both = len(self.hub) - len(self.minus[k]) - len(minus) + self._same(self.minus[k], minus)
            if both + self._same(self.plus[k], plus) >= need[k]:
                open_ = open_[root_of[open_] != root_of[k]]
                low, high = sorted((int(root_of[k]), mine))
                roots = self.facts[3, : me + 1]
                roots[roots == high] = low
                mine = low

    def links(self) -> list[tuple]:
        """Rows of 0 and two sets that one component holds."""
        return [(0, self.keys[r], k, None) for k, r, first in zip(self.keys, *self.facts[3:, : len(self.keys)], strict=True) if r != first]

    def apart(self) -> list[tuple]:
        """Rows of 1, the hub, and a set that is not in its component."""
        return [(1, self.keys[0], k, None) for k, r in zip(self.keys, self.facts[3], strict=False) if r]


def _deal(members: DataFrame, chunk: int) -> DataFrame:
    """Rows (hub, key) -> (hub, key, cell, part, parts, side): a list's sets dealt to cells, its hub to each of them."""
    sizes = members.groupBy("hub").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / chunk).cast("int"))
    known = join_classes(members, sizes, "hub", members.count())
    own = F.array(F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    cell = F.explode(F.when(F.col("key") == F.col("hub"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own))
    return known.select("hub", "key", cell.alias("cell"), F.lit(0).alias("part"), "parts", (F.col("key") != F.col("hub")).cast("int").alias("side"))


def _deal_apart(dealt: DataFrame, apart: DataFrame, chunk: int) -> DataFrame:
    """The rows of ``_deal`` for a second round: sides 1 and 2 are sets out of and in their hub's component, side 3 those out of it for all other cells."""
    lists = dealt.where("parts > 1")
    rounds = apart.groupBy("hub").agg(F.ceil(F.count("*") / chunk).cast("int").alias("rounds"))
    # of all lists, those with no set apart too: their rows must not meet by hub either
    sizes = lists.groupBy("hub").agg(F.count("*").alias("n")).join(rounds, "hub", "left")
    out = apart.select("hub", "key", F.lit(True).alias("out"))
    cells = join_classes(lists, sizes, "hub", lists.count()).where("rounds IS NOT NULL").join(out, ["hub", "key"], "left")
    parts = F.explode(F.sequence(F.lit(0), F.col("rounds") - 1))
    side = F.when(F.col("side") == 0, 0).when(F.col("out"), 1).otherwise(2)
    held = cells.select("hub", "key", "cell", parts.alias("part"), "parts", side.alias("side"))
    others = F.explode(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda c: c != F.col("cell")))
    part = F.pmod(F.xxhash64("key", F.lit(1)), F.col("rounds")).cast("int")
    return held.union(cells.where("out").select("hub", "key", others.alias("cell"), part.alias("part"), "parts", F.lit(3).alias("side")))


FOUND = "kind int, a long, b long, text binary"
CELL = ["hub", "cell", "part"]


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kind, a, b, text = zip(*found, strict=True)
    ids = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)]
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), *ids, pa.array(text, pa.binary())], names=["kind", "a", "b", "text"])


def _zipped(docs: DataFrame) -> DataFrame:
    """Rows of (row, text), each text in Zstandard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for t in texts(b.column("text")):
                data = pa.array([press.compress(t.bytes(i)) for i in range(len(t))], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("row").slice(t.first, len(t)), data], names=["row", "text"])

    return docs.select("row", "text").mapInArrow(run, "row long, text binary")


def _sketches(docs: DataFrame, k: int) -> DataFrame:
    """Rows of (row, text) -> row, size of the set, and its sketch: two to four bits a shingle, a power of two of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in texts(b.column("text")):
                value, off = shingles(t, k)
                n, value, made = np.diff(off), mix(value), []
                for d in range(len(t)):
                    bits = 1 << max(6, int(2 * n[d] - 1).bit_length())
                    at = (value[off[d] : off[d + 1]] & np.uint64(bits - 1)).astype(np.int64)
                    made.append(np.packbits((np.bincount(at, minlength=bits) & 1).astype(bool), bitorder="little").tobytes())
                yield pa.RecordBatch.from_arrays([b.column("row").slice(t.first, len(t)), pa.array(n.astype(np.int64)), pa.array(made, pa.binary())], names=["row", "n", "sketch"])

    return docs.select("row", "text").mapInArrow(run, "row long, n long, sketch binary")


def may_have_link(n: np.ndarray, sketches: list[bytes], percent: int) -> np.ndarray:
    """Which of different sets may link with another of them, by sizes and sketches."""
    keep = np.zeros(len(n), bool)
    size = np.array([len(x) for x in sketches])
    for width in np.unique(size):  # sets that link differ in size by less than half: sketches are as long, or twice as long
        if 2 * percent < 100:
            keep[:] = True
            break
        at = np.r_[np.flatnonzero(size == width), np.flatnonzero(size == 2 * width)]
        own = int((size == width).sum())
        bits = np.frombuffer(b"".join(sketches[i] for i in at[:own]), np.uint64).reshape(own, -1)
        if len(at) > own:
            twice = np.frombuffer(b"".join(sketches[i] for i in at[own:]), np.uint64).reshape(len(at) - own, 2, -1)
            bits = np.r_[bits, twice[:, 0] ^ twice[:, 1]]
        for i in range(own):
            apart = np.bitwise_count(bits[i + 1 :] ^ bits[i]).sum(1, dtype=np.int64)
            both = n[at[i]] + n[at[i + 1 :]]
            ok = at[i + 1 :][(both - apart) // 2 >= least_overlap(n[at[i]], n[at[i + 1 :]], percent)]
            if len(ok):
                keep[at[i]] = keep[ok] = True
    return keep


def _sieve(members: DataFrame, percent: int) -> DataFrame:
    """Rows of ``_deal``, of lists of one cell, with n and sketch -> those that may link with another of their list."""
    out = [c for c in members.columns if c not in ("n", "sketch")]

    def kept(t: pa.Table) -> Iterator[pa.RecordBatch]:
        hub, key, n, sketch = t["hub"].to_numpy(), t["key"].to_numpy(), t["n"].to_numpy(), t["sketch"].to_pylist()
        head = same(hub)
        begin = np.flatnonzero(head)
        fresh = np.flatnonzero(head | np.r_[True, key[1:] != key[:-1]])  # a row may be there repeatedly
        keep = np.zeros(len(t), bool)
        for a, b in zip(*(np.searchsorted(fresh, x) for x in (begin, np.r_[begin[1:], len(t)])), strict=True):
            at = fresh[a:b]
            if len(at) > 1:
                keep[at] = may_have_link(n[at], [sketch[i] for i in at], percent)
        yield from t.select(out).filter(pa.array(keep)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            hub = b.column("hub").to_numpy()
            if not len(hub):
                continue
            last = int(np.searchsorted(hub, hub[-1]))  # where the list begins that may go on
            if last or held and held[-1].column("hub")[-1].as_py() != hub[0]:
                yield from kept(pa.Table.from_batches([*held, b.slice(0, last)]))
                held = []
            held.append(b.slice(last))
        if held:
            yield from kept(pa.Table.from_batches(held))

    kinds = dict(members.dtypes)
    return members.repartition("hub").sortWithinPartitions("hub", "key").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in out))


def _unzipped(column: pa.Array, limit: int = 1 << 19) -> Iterator[Texts]:
    """As ``texts``, of a column of ``_zipped``."""
    press, held, first = zstandard.ZstdDecompressor(), [], 0
    for i, x in enumerate(column, 1):
        held.append(press.decompress(x.as_buffer()))
        if i == len(column) or sum(map(len, held)) >= limit:
            yield Texts(np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)]), first)
            held, first = [], i


def _deal_out(members: DataFrame) -> DataFrame:
    return members.repartition(*CELL).sortWithinPartitions(*CELL, "side", "key")


def _resolve(members: DataFrame, k: int, percent: int) -> DataFrame:
    """Rows of ``_deal`` with the text of ``_zipped`` -> kind 0: links that span the components of each cell. Of lists of several
    cells also kind 1: sets that are not in their hub's component, and kind 2: every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, cell, parts = None, None, 1

        def found():
            return group.links() + (group.apart() if parts > 1 else []) if group else []

        for b in batches:
            hub_of, key_of = (b.column(c).to_numpy().view(np.uint64) for c in ("hub", "key"))
            cell_of, parts_of = (b.column(c).to_numpy() for c in ("cell", "parts"))
            text, done = b.column("text"), []
            for t in _unzipped(text):
                value, off = shingles(t, k)
                true = digests(value, off)
                for d in np.flatnonzero(true == key_of[t.first : t.first + len(t)]):  # else another row of the same id
                    i = t.first + int(d)
                    key, this = int(key_of[i]), (int(hub_of[i]), int(cell_of[i]))
                    tokens = value[off[d] : off[d + 1]]
                    if this == cell and key == group.keys[-1]:
                        continue
                    if this != cell:
                        done += found()
                        cell, parts, group = this, int(parts_of[i]), Group(key, tokens.copy(), percent)
                    else:
                        group.add(key, tokens)
                    if parts > 1 and (key != this[0] or this[1] == 0):
                        done.append((2, this[0], key, text[i].as_py()))
            if done:
                yield _rows(done)
        if done := found():
            yield _rows(done)

    return _deal_out(members).mapInArrow(run, FOUND)


def _resolve_apart(members: DataFrame, k: int, percent: int) -> DataFrame:
    """Rows of ``_deal_apart`` with the texts -> more links, as kind 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, cell = None, None
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in (*CELL, "side", "key")), strict=True))
            done = []
            for t in _unzipped(b.column("text")):
                value, off = shingles(t, k)
                for d, (hub, cell_no, part, side, key) in enumerate(rows[t.first : t.first + len(t)]):
                    tokens, key = value[off[d] : off[d + 1]], key % (1 << 64)
                    if (hub, cell_no, part) != cell:
                        done += group.links() if group else []
                        cell, group = (hub, cell_no, part), Group(key, tokens.copy(), percent)
                    elif side < 3:
                        group.place(key, tokens, side == 2)
                    else:
                        group.add(key, tokens)
            if done:
                yield _rows(done)
        if group and (done := group.links()):
            yield _rows(done)

    return _deal_out(members).mapInArrow(run, FOUND)


def _row() -> F.Column:
    """What tells texts apart: a hash of id and text, whatever is null."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


def _components(docs: DataFrame, k: int, percent: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Rows of (row, doc_id, text) -> sets (row, doc_id, key, n) of all rows, and classes (key, n, first, root): of each
    set that isn't empty its rows, its smallest doc_id, and a name of its component."""
    spark = docs.sparkSession
    profile = write_table(_profile(docs, k), "jaccard-profile")
    # every task that read texts may hand in a count of a shingle that is frequent everywhere: summed in two steps
    parts = profile.where("kind = 1").groupBy("key", F.pmod(F.spark_partition_id(), F.lit(16)).alias("part")).agg(F.sum("n").alias("n"))
    often = parts.groupBy("key").agg(F.sum("n").alias("n")).where("n >= 32").orderBy(F.desc("n"), "key").limit(FREQUENT)
    common = often.select("key", "n").toPandas()
    codes = common["key"].to_numpy(np.int64).view(np.uint64)
    last = spark.sparkContext.broadcast(np.sort(codes))
    size = profile.where("kind = 0").agg(F.count("*").alias("rows"), F.sum(F.expr(f"n - (({percent} * n + 99) div 100) + 1")).alias("postings")).first()
    many = max(HOT, size["rows"] // 1000)
    hot = spark.sparkContext.broadcast(np.sort(codes[common["n"].to_numpy() >= many] | _TOP))  # as they stand in a set
    sets = profile.where("kind = 0").select("row", "doc_id", "key", "n")
    buckets = n_buckets(spark)
    shared = spark.sparkContext.broadcast(_shared(docs, k, percent, last, hot, buckets, size["postings"] or 0))

    def work(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        got = hubs(unpack(table.filter(pa.array(kind == 0)).column("data"), POSTING), percent).view(np.int64)
        held = unpack(table.filter(pa.array(kind == 1)).column("data"), HELD)
        token, key = held["token"].view(np.int64), held["key"].view(np.int64)
        none = lambda n: pa.nulls(n, pa.int64())
        parts = ((pa.array(got[:, 0]), none(len(token))), (pa.array(got[:, 1]), pa.array(key)), (none(len(got)), pa.array(token)))
        return pa.table({n: pa.chunked_array(x) for n, x in zip(("hub", "key", "token"), parts, strict=True)})

    posted = _post(docs, k, percent, last, hot, shared, buckets).groupBy("bucket").applyInArrow(work, "hub long, key long, token long")
    members = write_table(posted.distinct(), "jaccard-members")
    if len(hot.value):
        wide = members.where("token IS NOT NULL")
        least = wide.groupBy("token").agg(F.min("key").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
        found = wide.select("token", "key").join(F.broadcast(least), "token").select("hub", "key")  # FREQUENT rows at most
        both = write_table(members.where("token IS NULL").select("hub", "key").union(found).distinct(), "jaccard-members")
        drop_table(members)
        members = both
    classes = sets.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("first"), F.min("row").alias("row"), F.count("*").alias("n"))
    dealt = write_table(_deal(members.select("hub", "key"), chunk).join(classes.select("key", "row"), "key"), "jaccard-cells")
    drop_table(members)
    read = lambda rows: may_be_in(docs.select("row", "text"), "row", rows.select("row").distinct())
    short = dealt.where("parts = 1")
    sieved = write_table(_sieve(short.join(_sketches(read(short), k), "row"), percent).select(dealt.columns).union(dealt.where("parts > 1")), "jaccard-sieved")
    found = write_table(_resolve(sieved.join(_zipped(read(sieved)), "row"), k, percent), "jaccard-links")
    drop_table(sieved)
    links = found.where("kind = 0").select("a", "b")
    apart = found.where("kind = 1").select(F.col("a").alias("hub"), F.col("b").alias("key"))
    if apart.head(1):
        again = _deal_apart(dealt.drop("row"), apart, chunk)
        texts_of = found.where("kind = 2").select(F.col("a").alias("hub"), F.col("b").alias("key"), "text")
        more = _resolve_apart(again.join(texts_of, ["hub", "key"]), k, percent)
        links = links.union(write_table(more.select("a", "b"), "jaccard-links"))
    drop_table(dealt)
    roots = components(links)
    return sets, classes.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "n", "first", "root")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, chunk: int = CHUNK) -> DataFrame:
    """Rows of (doc_id, text) -> a row each: doc_id, n_shingles, component_id."""
    docs = docs.select(_row().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets, classes = _components(docs, k, percent, chunk)
    tied = classes.where("root IS NOT NULL")
    least = tied.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    # by root as classes: a large component's sets don't meet in one task
    known = join_classes(tied.select("key", F.col("n").alias("rows"), "root"), least, "root", tied.count())
    of_class = known.select("key", F.col("rows").alias("n"), "component_id").union(classes.where("root IS NULL").select("key", "n", "first"))
    filled = sets.where("n > 0").withColumnRenamed("n", "n_shingles")
    full = join_classes(filled, of_class, "key", sets.count()).select("doc_id", "n_shingles", "component_id")
    return full.union(sets.where("n = 0").select("doc_id", "n", "doc_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns: of each component one row, that with the smallest doc_id (null last), and of
    several such the one whose hash of id and text is smallest. Texts without a word link with nothing and stay.
    """
    rows = docs.select(_row().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets, classes = _components(rows, k, percent, CHUNK)
    best = sets.where("n > 0").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first"), F.count("*").alias("n"))
    firsts = best.join(classes.select("key", "root"), "key")
    mine = F.coalesce("root", "key")  # a component's name is the key of one of its sets
    winners = firsts.groupBy(mine.alias("root")).agg(F.min("first").alias("first")).select("first.row", F.lit(True).alias("wins"))
    # most rows stay, and need no exchange: only those that may go, or may be repeated, are looked at by row
    row, may = "attesta near row", "attesta near may"
    times = sets.where("n > 0").groupBy("row").agg(F.count("*").alias("times"))
    doubt = write_table(times.join(winners, "row", "left").where("wins IS NULL OR times > 1").select(F.col("row").alias(row), "wins"), "jaccard-doubt")
    marked = may_be_in(docs.withColumn(row, _row()), row, doubt.select(row), may)
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    held = marked.where(worded & F.col(f"`{may}`")).drop(may)
    kept = held.join(doubt.where("wins IS NULL").select(row), row, "left_anti").dropDuplicates([row]).drop(row)
    return kept.unionByName(marked.where(~(worded & F.col(f"`{may}`"))).drop(row, may))
