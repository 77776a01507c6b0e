"""Quality rules as a learned decision list over statistics of whole texts.

Sequential covering on labelled rows: a conjunction of thresholds grows by
information gain on two thirds of the rows, loses its last conditions as long as
that helps on the other third, and is kept if it is precise there; what it
covers is taken out and the next one grows. The list is an ordered Spark
conditional expression. Learning reads at most ``SAMPLE`` labelled rows, those
with the smallest hash of their id; statistics cover all rows.

Defined results: a null or empty text has zero statistics and fails the base
rule; a row without a label is judged but not learned from; no labels give an
empty list, which keeps all; repeated rows get a row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.textnum import SPACE, mix, texts, windows, words

#: Labelled rows that the list is learned from, at most.
SAMPLE = 20_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct")
SYMBOLS = b"#*$%&|<>"
_LINE = np.zeros(256, bool)
_LINE[0x0A] = True


def _per(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many flags each text has."""
    out = np.zeros(len(off) - 1, np.int64)
    full = np.flatnonzero(np.diff(off))
    if len(full):
        out[full] = np.add.reduceat(flag.view(np.uint8), off[full], dtype=np.int64)
    return out


def _kinds() -> dict[str, np.ndarray]:
    code = np.arange(256)
    return {
        "n_symbols": np.isin(code, list(SYMBOLS)),
        "n_upper": (code >= 65) & (code <= 90),
        "n_digits": (code >= 48) & (code <= 57),
        "n_marks": (code > 32) & (code < 127) & ~((code >= 48) & (code <= 57)) & ~((code >= 65) & (code <= 90)) & ~((code >= 97) & (code <= 122)),
        "chars": ((code & 0xC0) != 0x80) & ~SPACE,
    }


KINDS = _kinds()


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of each text of a string column."""
    parts: dict[str, list[np.ndarray]] = {k: [] for k in COUNTS}
    for t in texts(column):
        w = words(t)
        h = w.hashes()
        got = {k: _per(KINDS[k][t.data], t.off) for k in ("n_symbols", "n_upper", "n_digits", "n_marks")}
        got["word_chars"] = _per(KINDS["chars"][t.data], t.off)
        got["n_words"] = w.n
        line = words(t, _LINE)
        filled = np.r_[0, np.cumsum(~SPACE[t.data])]
        has = filled[line.end] > filled[line.start]
        lh, ld = line.hashes()[has], line.doc[has]
        got["n_lines"] = np.bincount(ld, minlength=len(t))
        got["n_dup_lines"] = got["n_lines"] - _distinct(lh, ld, len(t))
        value, first, doc = windows(h, w, 3)
        key = mix(value ^ ((doc + 1).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))
        ordered = np.sort(key)
        double = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        twice = first[:0]
        if len(double):
            at = np.searchsorted(double, key)
            at[at == len(double)] = 0
            twice = first[double[at] == key]
        for x, y in zip(w.at[:-1], w.at[1:], strict=True):
            h[x:y].sort()
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (w.doc[1:] != w.doc[:-1])
        got["n_distinct"] = _per(new, w.at)
        step = np.zeros(len(h) + 1, np.int64)
        np.add.at(step, twice, 1)
        np.add.at(step, twice + 3, -1)
        got["n_repeat_words"] = _per(np.cumsum(step[:-1]) > 0, w.at)
        for k in COUNTS:
            parts[k].append(got[k])
    return {k: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for k, v in parts.items()}


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
    return np.bincount(doc[new], minlength=n)


def with_counts(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """All rows and columns of ``docs`` with the statistics of ``text`` behind them."""
    names = [prefix + k for k in COUNTS]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(k, T.LongType()) for k in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = counts(b.column(b.schema.names.index(text)))
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(got[k]) for k in COUNTS)], names=[*b.schema.names, *names])

    return docs.mapInArrow(run, schema)


# What conditions compare: shares and sizes, as SQL over the statistics. pandas and Spark both read them.
FEATURES = {
    "symbols per word": "n_symbols / (n_words + 1)",
    "marks per word": "n_marks / (n_words + 1)",
    "upper per char": "n_upper / (word_chars + 1)",
    "digits per char": "n_digits / (word_chars + 1)",
    "repeated share": "n_repeat_words / (n_words + 1)",
    "repeated lines": "n_dup_lines / (n_lines + 1)",
    "distinct share": "n_distinct / (n_words + 1)",
    "chars per word": "word_chars / (n_words + 1)",
    "words per line": "n_words / (n_lines + 1)",
    "words": "n_words / 1.0",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    limit: float

    def test(self, x: pd.DataFrame) -> np.ndarray:
        v = x[self.feature].to_numpy()
        return v > self.limit if self.above else v <= self.limit

    def column(self, prefix: str = "") -> Column:
        text = FEATURES[self.feature]
        for k in COUNTS:
            text = text.replace(k, f"`{prefix}{k}`")
        return F.expr(text) > self.limit if self.above else F.expr(text) <= self.limit

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.limit:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: pd.DataFrame) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.test(x)
    return out


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))) if p else -1.0


def _grow(x: pd.DataFrame, bad: np.ndarray, cuts: int, most: int) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(x), bool)
    while len(rule) < most:
        p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
        if not n0 or not p0:
            break
        best, add = 1e-9, None
        for f in FEATURES:
            v, y = x[f].to_numpy()[inside], bad[inside]
            limits = np.unique(np.quantile(v, np.linspace(0, 1, cuts + 1)[1:-1]))
            if len(limits) > 1:  # between two values, not on one
                limits = np.r_[limits, (limits[1:] + limits[:-1]) / 2]
            for limit in limits:
                high = v > limit
                p, n = int(y[high].sum()), int((~y[high]).sum())
                for above, a, b in ((True, p, n), (False, p0 - p, n0 - n)):
                    g = _gain(a, b, p0, n0)
                    if g > best or above and add and g == best and (f, True) == (add.feature, add.above):  # of equal limits the one that rejects least
                        best, add = g, Condition(f, above, float(limit))
        if add is None:
            break
        rule += (add,)
        inside &= add.test(x)
    return rule


def learn(labelled: pd.DataFrame, precision: float = 0.97, least: int = 4, most_rules: int = 12, cuts: int = 48, most: int = 4, seed: int = 5) -> list[Rule]:
    """Rows of COUNTS and ``quality`` (0: reject) -> the ordered rules that reject."""
    if labelled.empty:
        return []
    x = pd.DataFrame({k: labelled.eval(e) for k, e in FEATURES.items()})
    bad = labelled["quality"].to_numpy() == 0
    part = np.random.default_rng(seed).random(len(x)) < 2 / 3
    rules: list[Rule] = []
    open_ = np.ones(len(x), bool)
    while len(rules) < most_rules and (bad & open_ & part).sum() >= least:
        g, q = open_ & part, open_ & ~part
        rule = _grow(x[g], bad[g], cuts, most)
        xq, bq = x[q], bad[q]

        def worth(r: Rule, xq=xq, bq=bq) -> float:
            c = _covers(r, xq)
            return (bq[c].sum() - (~bq[c]).sum()) / max(1, c.sum())

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        c = _covers(rule, x) & open_
        sure = (bad & c).sum() / max(1, c.sum())
        held = (bad & c & ~part).sum() / max(1, (c & ~part).sum())
        if not rule or (bad & c).sum() < least or sure < precision or held < precision:
            break
        rules.append(rule)
        open_ &= ~c
    return rules


def rejected_by(rules: list[Rule], prefix: str = "") -> Column:
    """The ordered conditional expression: the number of the first rule that fits, from 1, else null."""
    out = None
    for k, rule in enumerate(rules, 1):
        fits = rule[0].column(prefix)
        for c in rule[1:]:
            fits &= c.column(prefix)
        out = F.when(fits, k) if out is None else out.when(fits, k)
    return F.lit(None).cast("int") if out is None else out


def base_failed(prefix: str = "") -> Column:
    n, r = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


def learn_from(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Learn from the statistics of rows whose doc_id has a label that isn't null."""
    known = labels.where("quality IS NOT NULL").select("doc_id", "quality")
    rows = stats.select("doc_id", *COUNTS).join(known, "doc_id").where(~base_failed())
    n, order = known.count(), F.pmod(F.xxhash64("doc_id"), F.lit(2**31))
    if n > 2 * sample:  # of many rows only those with a small hash can be among the smallest: fewer to order
        rows = rows.where(order < int(2**31 * 2 * sample / n))
    return learn(rows.orderBy(order, "doc_id", "quality", *COUNTS).limit(sample).toPandas())


def quality(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """Rows of (doc_id, text) -> statistics, base_failed, rule (first that fits, else null), kept; and the rules."""
    stats = with_counts(docs.select("doc_id", "text")).drop("text")
    rules = learn_from(stats, labels)
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", rejected_by(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that base rule and list keep."""
    rules = learn_from(with_counts(docs.select("doc_id", "text")).drop("text"), labels)
    prefix = "attesta quality "
    kept = with_counts(docs, prefix=prefix).where(~base_failed(prefix) & rejected_by(rules, prefix).isNull())
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
