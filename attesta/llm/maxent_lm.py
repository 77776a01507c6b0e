"""Language-model scores from a hashed maximum-entropy model with class-factored softmax.

Tokens are words of anything but ASCII white space, lower-cased in A-Z, and one
end for each text. Documents whose crc32(doc_id as text) leaves remainder 1 by 5
are held out; all others are learned from, whole.

Counts of all training tokens give the base score, and the model's vocabulary:
its ``VOCAB`` most frequent tokens in classes of ``PER_CLASS``; other tokens fall
into classes by the form of the word. A softmax over classes and one over the
words of a class read the same kind of features: the hashed word before, the two
words before, and the words two, three and four back (skips). Words outside the
vocabulary share their class by their counts, so all of the corpus's counts enter
the score. Weights come from gradient updates in every shard of a round's share of
the training documents, averaged by tokens after each round. Shards have a fixed
size and order, so how the input is partitioned doesn't matter.

The ``FREQUENT`` most frequent tokens' counts are broadcast; others meet their
counts in packed exchanges by token, and come back to their row.

Defined results: a null or empty text is one end; a null doc_id is not held out;
without training documents every token is unknown; repeated rows get a row each;
other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.shared import BLOB, pack, partitions, unpack, write_table
from attesta.llm.textnum import LOWER, SPACE, Texts, mix, same, texts, words

VOCAB, PER_CLASS, FORMS, FREQUENT = 512, 16, 16, 1 << 18
#: Rows of the hashed weights: of classes, of words in their class.
ROWS, WORD_ROWS = 8192, 1024
ROUNDS, BATCH, RATE = 2, 8192, 0.15
#: Tokens of a shard, bytes of its texts learned from at once, and shards whose weights are averaged at a time.
SHARD, SLICE, MERGE = 2_000_000, 1 << 19, 64
END = np.uint64(0x5EED0E4D0F7E0000)
_FORM = np.uint64(FORMS - 1)
COUNT = np.dtype([("token", "<u8"), ("n", "<i8")])


def tokens(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of the texts, ends among them, and where each text's begin. The lowest bits hold a word's form."""
    w = words(t, SPACE, LOWER)
    h = w.hashes()
    last, before = w.data[w.end - 1].astype(np.uint64), w.data[np.maximum(w.end - 2, w.start)].astype(np.uint64)
    high = np.r_[0, np.cumsum(w.data >= 128)]
    form = (mix(last * np.uint64(257) + before) & np.uint64(7)) | ((high[w.end] > high[w.start]).astype(np.uint64) << np.uint64(3))
    code = (h & ~_FORM) | form
    return np.insert(code, w.at[1:], END), w.at + np.arange(len(w.at))


def _bucket(token: np.ndarray, buckets: int) -> np.ndarray:
    return ((token >> np.uint64(4)) % np.uint64(buckets)).astype(np.int32)


def _sum(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    order = np.argsort(v, kind="stable")
    v, n = v[order], n[order]
    at = np.flatnonzero(same(v))
    out = np.zeros(len(at), COUNT)
    out["token"] = v[at]
    out["n"] = np.add.reduceat(n, at) if len(at) else n
    return out


def count_tokens(train: DataFrame) -> DataFrame:
    """Rows of (text) -> for each bucket: packed counts, its most frequent tokens, and sums: tokens and kinds of each form."""
    buckets = partitions(train.sparkSession)
    most = -(-FREQUENT // buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            v, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            out = np.zeros(len(v), COUNT)
            out["token"], out["n"] = v, n
            return pack(out, _bucket(v, buckets))

        for b in batches:
            for t in texts(b.column("text")):
                held.append(tokens(t)[0])
                if sum(map(len, held)) > 2_000_000:
                    yield flush()
        if held:
            yield flush()

    def work(table: pa.Table) -> pa.Table:
        r = unpack(table.column("data"), COUNT)
        r = _sum(r["token"], r["n"])
        form = (r["token"] & _FORM).astype(np.int64)
        form[r["token"] == END] = FORMS
        sums = np.r_[np.bincount(form, r["n"], FORMS + 1), np.bincount(form, minlength=FORMS + 1)].astype(np.int64)
        top = r[np.lexsort((r["token"], -r["n"]))[:most]]
        return pa.table({"bucket": table.column("bucket").slice(0, 1).cast(pa.int32()), "data": pa.array([r.tobytes()], pa.binary()), "top": pa.array([np.sort(top, order="token").tobytes()], pa.binary()), "sums": pa.array([sums.tolist()], pa.list_(pa.int64()))})

    return write_table(train.mapInArrow(run, BLOB).groupBy("bucket").applyInArrow(work, "bucket int, data binary, top binary, sums array<long>"), "lm-counts")


class Model:
    """Weights and what is needed to score: vocabulary, frequent counts, sums of the other words' counts by form."""

    def __init__(self, counts: DataFrame):
        got = counts.agg(*(F.sum(F.col("sums")[i]) for i in range(2 * FORMS + 2))).first()
        n, v = (np.array([x or 0 for x in got[a : a + FORMS + 1]], np.int64) for a in (0, FORMS + 1))
        self.total, self.kinds = int(n.sum()), int(v.sum())
        parts = [np.frombuffer(r[0], COUNT) for r in counts.select("top").toLocalIterator()]
        top = np.sort(np.concatenate([np.zeros(0, COUNT), *parts]), order="token")
        self.frequent, self.frequent_n = top["token"].copy(), top["n"].copy()
        by = top[np.lexsort((top["token"], -top["n"]))]
        by = np.concatenate([by[by["token"] == END], by[by["token"] != END]])[:VOCAB]
        # word k of the vocabulary is number k; where each frequent token stands in it
        self.number = np.full(len(top), -1, np.int32)
        self.number[np.searchsorted(self.frequent, by["token"])] = np.arange(len(by))
        form = (by["token"] & _FORM).astype(np.int64)[by["token"] != END]
        rest = by["n"][by["token"] != END]
        self.form_n = n[:FORMS] - np.bincount(form, rest, FORMS).astype(np.int64)
        self.form_v = v[:FORMS] - np.bincount(form, minlength=FORMS)
        self.heads = -(-max(1, len(by)) // PER_CLASS)
        self.w = np.zeros((ROWS, self.heads + FORMS), np.float32)
        self.u = np.zeros((WORD_ROWS, self.heads, PER_CLASS), np.float32)
        # words that pad the last class out stay improbable
        self.u[0, -1, len(by) - (self.heads - 1) * PER_CLASS :] = -30

    def look_up(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of frequent tokens (-1: not one of them) and vocabulary numbers (-1: none)."""
        if not len(self.frequent):
            return np.full(len(code), -1), np.full(len(code), -1, np.int32)
        at = np.searchsorted(self.frequent, code)
        at[at == len(self.frequent)] = 0
        hit = self.frequent[at] == code
        return np.where(hit, self.frequent_n[at], -1), np.where(hit, self.number[at], -1)

    def features(self, code: np.ndarray, number: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token its class, and rows of the class weights and of the word weights; row 0 is in both."""
        form = (code & _FORM).astype(np.int64)
        symbol = np.where(number >= 0, number, VOCAB + form)
        place = np.arange(len(code)) - np.repeat(off[:-1], np.diff(off))
        back = [np.where(place >= k, np.r_[np.full(k, 0), symbol[: max(0, len(symbol) - k)]][: len(symbol)], VOCAB + FORMS).astype(np.uint64) for k in (1, 2, 3, 4)]
        row = lambda kind, x, size: (mix(x * np.uint64(8) + np.uint64(kind)) % np.uint64(size - 1)).astype(np.int32) + 1
        zero = np.zeros(len(code), np.int32)
        pair = back[0] * np.uint64(4096) + back[1]
        cls = np.where(number >= 0, number // PER_CLASS, self.heads + form)
        wide = np.stack([zero, row(1, back[0], ROWS), row(2, pair, ROWS), row(3, back[1], ROWS), row(4, back[2], ROWS), row(5, back[3], ROWS)], axis=1)
        narrow = np.stack([zero, row(1, back[0], WORD_ROWS), row(3, back[1], WORD_ROWS)], axis=1)
        return cls, wide, narrow

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z

    def classes(self, wide: np.ndarray) -> np.ndarray:
        z = self.w[wide[:, 0]]
        for k in range(1, wide.shape[1]):
            z += self.w[wide[:, k]]
        return self._softmax(z)

    def in_class(self, cls: np.ndarray, narrow: np.ndarray) -> np.ndarray:
        z = self.u[narrow[:, 0], cls]
        for k in range(1, narrow.shape[1]):
            z += self.u[narrow[:, k], cls]
        return self._softmax(z)

    def log10(self, code: np.ndarray, number: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Of each token log10 of class, and of the word where it is in the vocabulary; else without its count's part."""
        cls, wide, narrow = self.features(code, number, off)
        out = np.empty(len(code))
        for a in range(0, len(code), BATCH):
            s = slice(a, a + BATCH)
            p = self.classes(wide[s])
            out[s] = np.log10(np.maximum(p[np.arange(len(p)), cls[s]], 1e-30))
            own = np.flatnonzero(number[s] >= 0)
            q = self.in_class(cls[s][own], narrow[s][own])
            out[a + own] += np.log10(np.maximum(q[np.arange(len(q)), number[s][own] % PER_CLASS], 1e-30))
        form = (code & _FORM).astype(np.int64)
        return out - np.where(number >= 0, 0, np.log10(self.form_n + 0.5 * (self.form_v + 1))[form])


class Learner:
    """Adaptive gradient steps on one partition's tokens."""

    def __init__(self, model: Model):
        self.m = model
        self.gw, self.gu = np.full(model.w.shape, 1.0, np.float32), np.full((WORD_ROWS * model.heads, PER_CLASS), 1.0, np.float32)

    @staticmethod
    def _step(weights: np.ndarray, seen: np.ndarray, rows: np.ndarray, grad: np.ndarray) -> None:
        width = rows.shape[1]
        flat = rows.ravel()
        order = np.argsort(flat, kind="stable")
        at = np.flatnonzero(same(flat[order]))
        g = np.add.reduceat(grad[order // width], at)
        r = flat[order[at]]
        seen[r] += g * g
        weights[r] -= RATE * g / np.sqrt(seen[r])

    def learn(self, code: np.ndarray, number: np.ndarray, off: np.ndarray) -> None:
        cls, wide, narrow = self.m.features(code, number, off)
        u = self.m.u.reshape(-1, PER_CLASS)
        for a in range(0, len(code), BATCH):
            s = slice(a, a + BATCH)
            p = self.m.classes(wide[s])
            p[np.arange(len(p)), cls[s]] -= 1
            self._step(self.m.w, self.gw, wide[s], p)
            own = np.flatnonzero(number[s] >= 0)
            if len(own):
                q = self.m.in_class(cls[s][own], narrow[s][own])
                q[np.arange(len(q)), number[s][own] % PER_CLASS] -= 1
                self._step(u, self.gu, narrow[s][own].astype(np.int64) * self.m.heads + cls[s][own][:, None], q)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Texts]]:
    """Each shard's texts in slices that end with the text that fills them, however the rows come in batches."""
    held, size, shard = [], 0, None
    for b in batches:
        of, text = b.column("shard").to_numpy(), pc.fill_null(b.column("text"), "")
        long, a = pc.binary_length(text).to_numpy(), 0
        for k in range(len(of)):
            if of[k] != shard:
                held.append(text.slice(a, k - a))
                if shard is not None and sum(map(len, held)):
                    yield from ((shard, t) for t in texts(pa.concat_arrays(held), 1 << 62))
                held, size, a, shard = [], 0, k, of[k]
            size += int(long[k]) + 1
            if size >= SLICE:
                held.append(text.slice(a, k + 1 - a))
                yield from ((shard, t) for t in texts(pa.concat_arrays(held), 1 << 62))
                held, size, a = [], 0, k + 1
        held.append(text.slice(a))
    if sum(map(len, held)):
        yield from ((shard, t) for t in texts(pa.concat_arrays(held), 1 << 62))


def train(model: Model, docs: DataFrame, rounds: int = ROUNDS) -> Model:
    """Rounds of gradient updates on all texts of ``docs``, each on its share.

    A round's documents are dealt to shards of about ``SHARD`` tokens by a hash of id and text, and learned from in the order
    of that hash; shards' weights are averaged by tokens. So the model depends on the documents, not on how they are
    partitioned, and a shard has enough tokens to be better than counts before it is averaged.
    """
    spark = docs.sparkSession
    blocks = 8
    shards = max(1, round(model.total / max(1, rounds) / SHARD))
    for r in range(rounds if model.total else 0):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import copy

            def told(shard: int, m: Model, n: int) -> pa.RecordBatch:
                flat = np.concatenate([m.w.ravel(), m.u.ravel()])
                parts = [x.astype(np.float32).tobytes() for x in np.array_split(flat, blocks)]
                return pa.RecordBatch.from_arrays([pa.array(np.arange(blocks, dtype=np.int32)), pa.array(np.full(blocks, shard, np.int32)), pa.array(np.full(blocks, n)), pa.array(parts, pa.binary())], names=["block", "part", "n", "data"])

            own, m, learner, n = None, None, None, 0
            for shard, t in _slices(batches):
                if shard != own:
                    if n:
                        yield told(own, m, n)
                    m = copy.copy(shared.value)
                    m.w, m.u = m.w.copy(), m.u.copy()
                    own, learner, n = shard, Learner(m), 0
                code, off = tokens(t)
                learner.learn(code, m.look_up(code)[1], off)
                n += len(code)
            if n:
                yield told(own, m, n)

        def average(table: pa.Table) -> pa.Table:
            table = table.sort_by("part")  # sums in one order
            n = table.column("n").to_numpy()
            total, x = 0.0, 0
            for data, k in zip(table.column("data"), n, strict=True):
                x = x + np.frombuffer(data.as_buffer(), np.float32).astype(np.float64) * k
                total += k
            return pa.table({"block": table.column("block").slice(0, 1), "part": table.column("part").slice(0, 1), "n": pa.array([int(total)]), "data": pa.array([(x / total).astype(np.float32).tobytes()], pa.binary())})

        kind = "block int, part int, n long, data binary"
        key = F.xxhash64("doc_id", "text")
        share = docs.where(F.pmod(key, F.lit(rounds)) == r).select("text", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"), key.alias("key"))
        learned = share.repartition(shards, "shard").sortWithinPartitions("shard", "key").drop("key").mapInArrow(run, kind)
        # a tree of averages: a group has MERGE shards' blocks, the last one a MERGE ** 2-th of all
        for part in (F.floor(F.col("part") / MERGE), F.floor(F.col("part") / MERGE), F.lit(0)):
            learned = learned.withColumn("part", part.cast("int")).groupBy("block", "part").applyInArrow(average, kind)
        rows = sorted((x["block"], bytes(x["data"])) for x in learned.collect())
        if rows:
            flat = np.concatenate([np.frombuffer(x, np.float32) for _, x in rows])
            model.w = flat[: model.w.size].reshape(model.w.shape).copy()
            model.u = flat[model.w.size :].reshape(model.u.shape).copy()
    return model


LEFT = np.dtype([("token", "<u8"), ("row", "<i8"), ("n", "<i4")])
COUNTED = np.dtype([("row", "<i8"), ("n", "<i4"), ("count", "<i8")])
ROW = np.dtype([("row", "<i8"), ("doc", "<i8"), ("no_doc", "?"), ("held", "?"), ("n", "<i8"), ("known", "<i8"), ("base", "<f8"), ("score", "<f8")])
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Rows of (doc_id, held_out, text) -> a row each, of SCORED."""
    spark = docs.sparkSession
    buckets = partitions(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        row = TaskContext.get().partitionId() << 36
        left: list[np.ndarray] = []
        done: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            x, r = np.concatenate(left), np.concatenate(done)
            left.clear()
            done.clear()
            yield pack(x, _bucket(x["token"], buckets), 1)
            yield pack(r, (r["row"] % buckets).astype(np.int32), 2)

        for b in batches:
            ids, held = b.column("doc_id"), b.column("held_out").to_numpy(zero_copy_only=False)
            no_doc = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            for t in texts(b.column("text")):
                code, off = tokens(t)
                n, number = m.look_up(code)
                doc = np.repeat(np.arange(len(t)), np.diff(off))
                got = m.log10(code, number, off)
                log_n = np.where(n >= 0, np.log10(np.maximum(n, 0) + 0.5), 0)
                r = np.zeros(len(t), ROW)
                s = slice(t.first, t.first + len(t))
                r["row"], r["doc"], r["no_doc"], r["held"] = row + np.arange(len(t)), ids[s], no_doc[s], held[s]
                r["n"], r["known"] = np.diff(off), np.bincount(doc, n > 0, len(t))
                r["base"] = np.bincount(doc, log_n, len(t))
                r["score"] = np.bincount(doc, got + np.where((n >= 0) & (number < 0), log_n, 0), len(t))
                done.append(r)
                at = np.flatnonzero(n < 0)
                x = np.zeros(len(at), LEFT)
                x["token"], x["row"], x["n"] = code[at], row + doc[at], 1
                x = x[np.lexsort((x["token"], x["row"]))]
                new = np.flatnonzero(np.r_[True, (x["token"][1:] != x["token"][:-1]) | (x["row"][1:] != x["row"][:-1])]) if len(x) else np.zeros(0, int)
                x, times = x[new], np.diff(np.r_[new, len(x)])
                x["n"] = times
                left.append(x)
                row += len(t)
                if sum(map(len, left)) + sum(map(len, done)) > 300_000:
                    yield from flush()
        if done:
            yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        part = lambda k, dtype: unpack(table.filter(pa.array(kind == k)).column("data"), dtype)
        own, x, r = part(0, COUNT), part(1, LEFT), part(2, ROW)
        out = np.zeros(len(x), COUNTED)
        out["row"], out["n"] = x["row"], x["n"]
        if len(own):
            own = np.sort(own, order="token")
            at = np.searchsorted(own["token"], x["token"])
            at[at == len(own)] = 0
            out["count"] = np.where(own["token"][at] == x["token"], own["n"][at], 0)
        return pa.concat_tables(pa.Table.from_batches([pack(a, (a["row"] % buckets).astype(np.int32), k)]) for k, a in ((1, out), (2, r)))

    total, kinds = model.total, model.kinds

    def close(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        x = unpack(table.filter(pa.array(kind == 1)).column("data"), COUNTED)
        r = np.sort(unpack(table.filter(pa.array(kind == 2)).column("data"), ROW), order="row")
        at = np.searchsorted(r["row"], x["row"])
        log_n = np.bincount(at, x["n"] * np.log10(x["count"] + 0.5), len(r))
        known = r["known"] + np.bincount(at, x["n"] * (x["count"] > 0), len(r)).astype(np.int64)
        base = r["base"] + log_n - r["n"] * np.log10(total + 0.5 * (kinds + 1))
        return pa.table(
            {
                "doc_id": pa.array(r["doc"], mask=r["no_doc"]), "held_out": pa.array(r["held"]), "n_tokens": pa.array(r["n"]), "n_known": pa.array(known),
                "train_tokens": pa.array(np.full(len(r), total)), "base_score": pa.array(base), "score": pa.array(r["score"] + log_n),
            }
        )

    blobs = docs.mapInArrow(run, BLOB).union(counts.select("bucket", F.lit(0).alias("kind"), "data"))
    return blobs.groupBy("bucket").applyInArrow(meet, BLOB).groupBy("bucket").applyInArrow(close, SCORED)


def score_documents(docs: DataFrame) -> DataFrame:
    """Learn from the training documents, score all of them."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    learned = rows.where(~F.col("held_out"))
    counts = count_tokens(learned.select("text"))
    return score(rows, train(Model(counts), learned), counts)
