"""Listed names scored under a recogniser's frames: one forward pass over a trie of their letters for each crop.

Names that begin alike share the forward columns of what they share: a node of the
trie is a prefix, and holds the likelihood of the frames so far having said it,
with a letter last or a blank. A step over a frame is a few numpy operations over
all nodes, and only the nodes are kept, so a crop may have any number of frames.
Crops are dealt out by key and their frames stream through Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

from attesta.functions.text import match_key


def keyed(spark: SparkSession, names: list[str], key: Callable[[Column], Column] = match_key) -> list[tuple[str, str]]:
    """Each listed name with the letters it is scored by."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(list(enumerate(names)), "i int, name string").select("i", "name", key(F.col("name")).alias("key")).collect()
    return [(r["name"], r["key"]) for r in sorted(rows, key=lambda r: r["i"])]


class Trie:
    """Nodes in order of their parents; ``end`` is each usable name's node. Names without letters, or with one that no symbol has, are left out."""

    def __init__(self, names: list[tuple[str, str]], symbols: list[str], blank: int = 0):
        place = {s: k for k, s in enumerate(symbols)}
        self.blank, self.names, self.parent, self.symbol = blank, [], [0], [blank]
        known: dict[tuple[int, int], int] = {}
        end = []
        for name, letters in names:
            if not letters or any(c not in place for c in letters):
                continue
            at = 0
            for c in letters:
                step = at, place[c]
                if step not in known:
                    known[step] = len(self.parent)
                    self.parent.append(at)
                    self.symbol.append(place[c])
                at = known[step]
            self.names.append(name)
            end.append(at)
        self.end = np.array(end, int)
        self.parent, self.symbol = np.array(self.parent), np.array(self.symbol)
        self.repeats = (self.symbol == self.symbol[self.parent]) & (self.parent > 0)  # a letter twice needs a blank between

    def begin(self) -> tuple[np.ndarray, np.ndarray]:
        """Before the first frame, nothing is said: likelihoods of (a letter last, a blank last)."""
        letter, blank = np.full((2, len(self.parent)), -np.inf)
        blank[0] = 0.0
        return letter, blank

    def step(self, state: tuple[np.ndarray, np.ndarray], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        letter, blank = state
        before = np.where(self.repeats, -np.inf, letter[self.parent])
        said = np.logaddexp(np.logaddexp(letter, before), blank[self.parent]) + logp[self.symbol]
        said[0] = -np.inf
        return said, np.logaddexp(letter, blank) + logp[self.blank]

    def scores(self, state: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return np.logaddexp(*state)[self.end]


def _per_crop(frames: DataFrame, key: str, trie: Trie, told: Callable[[np.ndarray], tuple[list, ...]], out: str) -> DataFrame:
    """``told`` makes columns of a crop's scores; they come with the crop's key."""
    names = [key, *(x.split()[0] for x in out.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None

        def batch(own: pa.Scalar) -> pa.RecordBatch:
            columns = [pa.array(c) for c in told(trie.scores(state))]
            return pa.RecordBatch.from_arrays([pa.array([own.as_py()] * len(columns[0]), own.type), *columns], names=names)

        for b in batches:
            logp = b.column("logp")
            for k, own in enumerate(b.column(key)):
                if state is None or own.as_py() != held.as_py():
                    if state is not None:
                        yield batch(held)
                    held, state = own, trie.begin()
                state = trie.step(state, np.asarray(logp[k].as_py(), float))
        if state is not None:
            yield batch(held)

    kind = frames.schema[key].dataType.simpleString()
    return frames.select(key, "t", "logp").repartition(key).sortWithinPartitions(key, "t").mapInArrow(run, f"{key} {kind}, {out}")


def all_scores(frames: DataFrame, key: str, trie: Trie) -> DataFrame:
    """Every crop with every usable name."""
    return _per_crop(frames, key, trie, lambda s: (trie.names, s.tolist()), "name string, score double")


def best_names(frames: DataFrame, key: str, trie: Trie) -> DataFrame:
    """Each crop's best name, the first of equal ones in the list, its score and its lead over the next; none where fewer than two can be scored."""

    def best(s: np.ndarray) -> tuple[list, ...]:
        first, second = np.argsort(-s, kind="stable")[:2]
        lead = s[first] - s[second] if np.isfinite(s[second]) else np.inf
        return [trie.names[first]], [float(s[first])], [float(lead)]

    if len(trie.names) < 2:
        return frames.limit(0).selectExpr(key, "'' AS name", "0D AS score", "0D AS margin")
    return _per_crop(frames, key, trie, best, "name string, score double, margin double")
