"""Fill-in-the-middle forms of documents, cut at lines that memoised chunks locate.

A rolling hash over 32 bytes cuts each text into content-defined chunks, so that
passages which documents share become the same chunks. A task's cache, keyed by a
chunk's bytes and so verified by them, holds what a chunk adds: its line ends, its
code points, and whether a mark stands in it. Prefix sums of these over a text's
chunks tell the chunk in which a cut falls; only that chunk is searched.

A document's cuts and form come from the SHA-256 of seed and id, so reruns agree.

Defined results: a null text is empty, and empty texts are plain; a null id is
hashed as the seed alone; repeated rows are transformed alike, each for itself;
an empty table gives an empty result; texts are read whole, however long, and one
of them is a task's unit; other columns of the input are not read. A text that
holds a mark is plain, as its output couldn't be told apart again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.textnum import texts

#: Begin prefix, suffix and middle. Each must begin with a character that it has nowhere else.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes that the rolling hash sees, bits of it that are zero at a cut, and the longest chunk.
WINDOW, BITS, LONGEST = 32, 9, 1 << 16
#: Bytes of chunks that a task's cache may hold before it starts anew.
CACHE = 32 << 20

_GEAR = np.random.default_rng(11).integers(0, 2**32, 256, dtype=np.uint32)
_INSIDE = bytes(range(0x80, 0xC0))  # UTF-8 bytes that begin no code point


def chunk_ends(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sorted ends of the chunks of consecutive texts; each text's own end is one, and no window reaches over it."""
    h = _GEAR[data]
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    at = np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1
    begun = off[np.searchsorted(off, at, "left") - 1]
    ends = np.union1d(at[at - begun >= WINDOW], off[1:])
    gaps = np.diff(np.r_[0, ends])
    long = np.flatnonzero(gaps > LONGEST)
    if len(long):
        ends = np.union1d(ends, np.concatenate([np.arange(ends[k] - gaps[k] + LONGEST, ends[k], LONGEST) for k in long]))
    return ends


class Chunks:
    """What chunks add to a text, by their bytes."""

    def __init__(self, marks: tuple[bytes, ...], room: int = CACHE):
        self.marks, self.room, self.held = marks, room, 0
        self.known: dict[bytes, tuple[int, int, bool]] = {}
        self.reach = max(map(len, marks)) - 1

    def has_mark(self, part: bytes) -> bool:
        return any(m in part for m in self.marks)

    def summary(self, chunk: bytes) -> tuple[int, int, bool]:
        """Line ends, code points, and whether a mark lies inside."""
        found = self.known.get(chunk)
        if found is None:
            found = chunk.count(b"\n"), len(chunk.translate(None, _INSIDE)), self.has_mark(chunk)
            if self.held > self.room:
                self.known.clear()
                self.held = 0
            self.known[chunk] = found
            self.held += len(chunk)
        return found

    def read(self, text: bytes, ends: list[int]) -> tuple[list[int], list[int], bool]:
        """Line ends and code points before each chunk and at the end, and whether the text has a mark."""
        lines, points, marked, tail = [0], [0], False, b""
        for a, b in pairwise([0, *ends]):
            chunk = text[a:b]
            n, c, m = self.summary(chunk)
            lines.append(lines[-1] + n)
            points.append(points[-1] + c)
            if self.reach:
                marked = marked or m or self.has_mark(tail + chunk[: self.reach])
                tail = (tail + chunk[-self.reach :])[-self.reach :]
            else:
                marked = marked or m
        return lines, points, marked


def place(text: bytes, ends: list[int], lines: list[int], points: list[int], units: int, n: int) -> tuple[int, int]:
    """Bytes and code points of a text's first ``units`` of n lines."""
    if units >= n:
        return len(text), points[-1]
    if not units:
        return 0, 0
    k = int(np.searchsorted(lines, units)) - 1  # the first chunk after which so many lines have ended
    begin = at = ends[k - 1] if k else 0
    for _ in range(units - lines[k]):
        at = text.index(b"\n", at) + 1
    return at, points[k] + len(text[begin:at].translate(None, _INSIDE))


def draws(doc_id: int | None, seed: int) -> list[int]:
    said = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(said[8 * k : 8 * k + 8], 16) for k in range(4)]


FORMS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def fill_middle(docs: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Rows of (doc_id, text) -> doc_id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars, output."""
    raw = tuple(m.encode() for m in marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(raw)
        p, s, m = raw
        for batch in batches:
            ids = batch.column("doc_id")
            for t in texts(batch.column("text")):
                out = []
                all_ends = chunk_ends(t.data, t.off)
                cut = np.searchsorted(all_ends, t.off, "right")
                for k in range(len(t)):
                    text, doc = t.bytes(k), ids[t.first + k].as_py()
                    ends = (all_ends[cut[k] : cut[k + 1]] - t.off[k]).tolist() if text else []
                    lines, points, marked = chunks.read(text, ends)
                    n = lines[-1] + (text[-1:] not in (b"", b"\n"))
                    h1, h2, h3, h4 = draws(doc, seed)
                    if not text or marked or h3 % 100 >= percent:
                        out.append((doc, n, "plain", None, None, text))
                        continue
                    (a, pa_), (b, pb) = (place(text, ends, lines, points, u, n) for u in sorted((h1 % (n + 1), h2 % (n + 1))))
                    pre, mid, suf = text[:a], text[a:b], text[b:]
                    form, made = ("spm", s + suf + p + pre + m + mid) if h4 % 100 < spm_percent else ("psm", p + pre + s + suf + m + mid)
                    out.append((doc, n, form, pa_, pb - pa_, made))
                *rest, made = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, f.type) for x, f in zip(rest, _ARROW, strict=False)), pa.array(made, pa.binary()).cast(pa.string())], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FORMS)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "|".join(re.escape(m) for m in marks), -1)
    psm, spm = (F.concat(*(F.get(parts, F.lit(k)) for k in order)) for order in ((1, 3, 2), (2, 3, 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
