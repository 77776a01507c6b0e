"""Words, hashes and sets of whole texts as numpy arrays over their UTF-8 bytes.

Texts are taken from Arrow string columns without making Python strings. A null
text counts as empty. Hashes have 64 bits: two different values of n agree with
a chance of about n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Separators of words made of anything but ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of words made of ASCII letters, digits and all above ASCII.
MARKS = np.zeros(256, bool)
MARKS[:128] = True
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    MARKS[_a:_b] = False

KEEP = np.arange(256, dtype=np.uint8)
LOWER = KEEP.copy()
LOWER[0x41:0x5B] += 32

_R = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_IP = pow(_P, -1, 2**64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        m = max(n, 1 << 20)
        for k, base in enumerate((_P, _IP)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Texts:
    """Consecutive texts: text k is data[off[k]:off[k + 1]]; rows first to first + len - 1 of the batch."""

    data: np.ndarray
    off: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.off) - 1

    def bytes(self, k: int) -> bytes:
        return self.data[self.off[k] : self.off[k + 1]].tobytes()


def texts(column: pa.Array, limit: int = 1 << 19) -> Iterator[Texts]:
    """Slices of a string column of about ``limit`` bytes; a longer text is a slice of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    off = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(off) - 1:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield Texts(data[off[a] : off[b]], off[a : b + 1] - off[a], a)
        a = b


@dataclass
class Words:
    """start, end: byte places of the words; at: of text k they are at[k] to at[k + 1]; doc: each word's text."""

    start: np.ndarray
    end: np.ndarray
    at: np.ndarray
    n: np.ndarray
    doc: np.ndarray
    data: np.ndarray

    def hashes(self) -> np.ndarray:
        """A hash of each word's bytes in ``data``."""
        pw, ip = powers(len(self.data) + 1)
        c = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_R[self.data] * pw[:-1], out=c[1:])
        h = (c[self.end] - c[self.start]) * ip[self.start]
        return mix(h ^ ((self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def words(t: Texts, sep: np.ndarray = SPACE, fold: np.ndarray = KEEP) -> Words:
    """The maximal runs of bytes outside ``sep``; none reaches over the end of a text."""
    data = t.data if fold is KEEP else fold[t.data]
    n = len(data)
    inside = ~sep[data]
    cut = np.zeros(n + 1, bool)
    cut[t.off] = True
    head = inside.copy()
    head[1:] &= ~inside[:-1] | cut[1:n]
    tail = inside.copy()
    tail[:-1] &= ~inside[1:] | cut[1:n]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    at = np.searchsorted(start, t.off)
    count = np.diff(at)
    return Words(start, end, at, count, np.repeat(np.arange(len(count)), count), data)


def windows(h: np.ndarray, w: Words, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of k consecutive words of a text, their first word and their text.

    short: a text of fewer words, but not none, gives all of its words as one window.
    """
    left = np.repeat(w.at[1:], w.n) - np.arange(len(h))  # words from this one to the end of its text
    first = np.flatnonzero(left >= k)
    value = combine([h[first + j] for j in range(k)])
    doc = w.doc[first]
    if short:
        few = np.flatnonzero((w.n > 0) & (w.n < k))
        if len(few):
            value = np.r_[value, np.array([combine([h[w.at[d] + j : w.at[d] + j + 1] for j in range(w.n[d])])[0] for d in few], np.uint64)]
            first, doc = np.r_[first, w.at[few]], np.r_[doc, few]
            order = np.argsort(first, kind="stable")
            value, first, doc = value[order], first[order], doc[order]
    return value, first, doc


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """A hash of a sequence of hashes; sequences of other lengths get others."""
    x = np.full(len(parts[0]), 0x8EBC6AF09C88C6E3 + len(parts), np.uint64)
    for p in parts:
        x = x * np.uint64(0xC2B2AE3D27D4EB4F) + p
        x = x ^ (x >> np.uint64(29))
    return mix(x)


def same(a: np.ndarray) -> np.ndarray:
    """For a sorted array: where a value begins that differs from the one before."""
    return np.r_[True, a[1:] != a[:-1]] if len(a) else np.zeros(0, bool)
