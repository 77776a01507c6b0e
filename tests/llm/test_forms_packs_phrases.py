"""Fill-in-the-middle forms, best-fit packing and phrases against plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_operators import odd_docs

from attesta.llm import best_fit, fill_middle, phrases

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["1 AS n", "'x' AS output", "2 AS piece", "3 AS rank", "4 AS bucket", "5 AS part", "6 AS h", "'w' AS word"]


def more_docs():
    rows = odd_docs()
    rng = np.random.default_rng(4)
    page = "\n".join(" ".join(f"w{rng.integers(90)}" for _ in range(9)) for _ in range(70))
    texts = ["\n", "\n\n\n", "a\nb", "a\nb\n", "é\nßx\n日本\n", "x" * 200_000 + "\n" + "y" * 70_000, page, page + "\ntail", "head\n" + page, "<P>", "a\n<S>\nb", "<M", "<|endoftext|> a", "tab\tand  spaces ", "日本語 " * 900, page.replace("w1 ", ", ")]
    rows += [(100 + k, t, [None, "en", "de"][k % 3], "s", None) for k, t in enumerate(texts)]
    return [*rows, (None, page, "en", None, 1), (None, page, "en", None, 1)]


@pytest.fixture(scope="module", params=["table", "odd", "empty"])
def docs(request, spark, sf):
    if request.param == "table":
        return spark.read.parquet(f"{sf}/documents.parquet")
    return spark.createDataFrame(more_docs() if request.param == "odd" else [], DOCS).selectExpr("*", *CLASH)


def plain_form(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(brute.sha(f"7:{'' if doc_id is None else doc_id}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in fill_middle.MARKS):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 50:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_middle(docs):
    want = Counter((r.doc_id, *plain_form(r.doc_id, r.text), r.text or "") for r in docs.select("doc_id", "text").collect())
    made = fill_middle.fill_middle(docs)
    got = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert Counter(tuple(r) for r in got) == want


def test_fill_middle_shares(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('line\n', 9) AS text")
    forms = Counter(r.form for r in fill_middle.fill_middle(docs, percent=50, spm_percent=0).collect())
    assert set(forms) == {"plain", "psm"} and 140 < forms["plain"] < 260


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<", "P", ">", "<P>", "S>", "M", "\n", "é", "日", "ab" * 40, "c\n" * 30]), max_size=40).map("".join), st.integers(1, 6), st.data())
def test_chunks_add_up(text, size, data):
    """Wherever the chunks end, inside marks and code points too."""
    raw = text.encode()
    ends = sorted(data.draw(st.sets(st.integers(1, max(1, len(raw))), max_size=12)) | {len(raw)}) if raw else []
    chunks = fill_middle.Chunks(tuple(m.encode() for m in fill_middle.MARKS), room=size * 8)
    ends = [e for e in ends if e <= len(raw)]
    for _ in range(2):
        lines, points, marked = chunks.read(raw, ends)
        assert (lines[-1], points[-1], marked) == (text.count("\n"), len(text), any(m in text for m in fill_middle.MARKS))
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        for k in range(len(units) + 1):
            pre = "".join(units[:k])
            assert fill_middle.place(raw, ends, lines, points, k, len(units)) == (len(pre.encode()), len(pre))


def test_chunks_follow_content():
    rng = np.random.default_rng(3)
    shared = rng.integers(97, 123, 40_000).astype(np.uint8)
    data = np.concatenate([shared, rng.integers(97, 123, 777).astype(np.uint8), shared])
    off = np.array([0, 40_000, len(data)])
    ends = fill_middle.chunk_ends(data, off)
    first, second = ends[ends <= 40_000], ends[ends > 40_777] - 40_777
    assert 40 < len(first) < 160 and len(set(first) & set(second)) >= len(first) - 2
    assert {40_000, len(data)} <= set(ends)
    alike = fill_middle.chunk_ends(np.full(200_000, 97, np.uint8), np.array([0, 200_000]))
    assert np.diff(np.r_[0, alike]).max() <= fill_middle.LONGEST


def ids_of(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids, 0]


def test_encode_agrees_with_the_tokenizer():
    rng = np.random.default_rng(8)
    marks = list("aeiou'sdt nrl\n\t  .,;0123é ß\u0080\u0085-_<|>") + ["don't", "  ", "\r\n", "<|endoftext|>", "日", " ", "🙂"]
    for _ in range(150):
        text = "".join(rng.choice(marks, rng.integers(0, 80)))
        assert list(best_fit.encode(text)) == ids_of(text)


def checked(placed, documents, capacity):
    """The pieces are the documents', and sequences have neither gaps nor overlaps; how many there are."""
    crcs = Counter()
    for doc_id, ids in documents:
        first = (len(ids) - 1) % capacity + 1
        for k, a in enumerate([0, *range(first, len(ids), capacity)]):
            own = ids[a : a + capacity] if k else ids[:first]
            crcs[doc_id, k, a, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed) == crcs
    at = Counter()
    for r in sorted(placed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert not at or max(at.values()) <= capacity
    return len(at)


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        gap = min(fits, default=capacity)
        if fits:
            gaps.remove(gap)
        gaps.append(gap - n)
    return len(gaps)


def test_best_fit(docs):
    placed = best_fit.pack_documents(docs.repartition(3)).collect()
    documents = [(r.doc_id, ids_of(r.text)) for r in docs.select("doc_id", "text").collect()]
    used = checked(placed, documents, 2048)
    tokens = sum(len(x) for _, x in documents)
    assert used <= max(-(-tokens // 2048) + 1, best_fit_decreasing([r.length for r in placed], 2048))


def test_packed_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(k, "word " * (k * 7 % 40), None, None, None) for k in range(60)], DOCS).repartition(4)
    packed = best_fit.pack_documents(docs, capacity=64, with_ids=True).collect()
    back = {r.sequence_id: r.ids for r in best_fit.sequences(spark.createDataFrame(packed, "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>, sequence_id long, offset long")).collect()}
    for r in packed:
        assert back[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert sum(map(len, back.values())) == sum(len(ids_of("word " * (k * 7 % 40))) for k in range(60))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12), st.integers(2, 12))
def test_rounds_of_sweeps(counts, width):
    """Ranges swept apart, then what they leave: every rank is placed once, no sequence overflows, about as few as best fit needs."""

    def one_round(runs):
        by = {}
        for r in runs:
            by.setdefault(r[1] // width, []).append(r)
        out = [x for k, g in by.items() for x in best_fit.sweep(g, 30, max(1, k * width))]
        return [r for r in out if r[0] > best_fit.PIECE] + best_fit.sweep([r for r in out if r[0] <= best_fit.PIECE], 30)

    placed = best_fit.pack_runs(dict(counts), 30, one_round)
    seen, fill = Counter(), {}
    for _, size, first, n, per, sequence, offset in placed:
        for k in range(n):
            seen[size, first + k] += 1
            fill.setdefault(sequence + k // per, []).append((offset + k % per * size, size))
    assert seen == Counter((k, j) for k, n in counts.items() for j in range(n))
    for parts in fill.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 30
    lengths = [k for k, n in counts.items() for _ in range(n)]
    assert len(fill) <= best_fit_decreasing(lengths, 30) * 1.1 + 1


def plain_phrases(docs, least, share=80, most=2000):
    f, total = {}, Counter()
    for lang, text in docs:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\n-\r]", brute.lower(text)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        cand = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in cand.items():
            inside = lambda h: len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))  # noqa: E731, B023
            if any(inside(h) and 100 * b >= share * a for h, b in cand.items()):
                continue
            score, cut = min((2000000 * a // (c[g[:k]] + c[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), c[g[:cut]], c[g[cut:]]))
        out += [(lang, k + 1, p.decode(), -a, left, right, total[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(rows)[:most])]
    return out


NAMES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def test_phrases(docs):
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    got = [tuple(r[n] for n in NAMES) for r in phrases.collocations(docs, least=30).collect()]
    assert sorted(got) == sorted(plain_phrases(rows, 30))


@pytest.mark.parametrize("numbered", [0, 1 << 22])
def test_phrases_few_words(spark, monkeypatch, numbered):
    """Many ties, rings and repeated rows; words that are names of languages; a language's list is cut."""
    monkeypatch.setattr(phrases, "NUMBERED", numbered)
    rng = np.random.default_rng(6)
    rows = [(int(k % 4), " ".join(rng.choice(["en", "de", "a", "b", "und", "C"], rng.integers(0, 12))) + ". x y z x y z x y", [None, "en", "de", "und"][k % 4]) for k in range(160)]
    rows += [(None, None, None), (7, "", "fr"), (7, "one two, three", "fr")] + [(8, "p q r s t u v; p q r s t u v", "it")] * 9
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string").repartition(5)
    want = plain_phrases([(x, t) for _, t, x in rows], 8, most=25)
    got = [tuple(r[n] for n in NAMES) for r in phrases.collocations(docs, least=8, most=25).collect()]
    assert sorted(got) == sorted(want)


def test_paths_of_passages(spark):
    """A passage that always repeats as a whole is one path; a ring has none."""
    rows = [("p q r s t u v w",)] * 4 + [("k l m n k l m n k l m n k l m",)] * 3 + [("a b c d e",)] * 2 + [("a b c d f",)] * 3
    docs = spark.createDataFrame(rows, "text string").selectExpr("text", "'en' AS lang")
    words = phrases.count_words(docs)
    grams = spark.createDataFrame(phrases.count_phrases(docs, phrases.Frequent(words, 10**6), 2).collect(), phrases.GRAMS)
    name = {r.h: r.word for r in words.collect()}
    paths = {}
    for r in phrases.compact(grams).collect():
        paths.setdefault(r.path, []).append((r.place, "".join(name[r[w]] for w in phrases.W), r.f))
    told = sorted(sorted(p) for p in paths.values())
    assert [(k, f"{'pqrstuvw'[k : k + 4]}", 4) for k in range(5)] in told
    assert [(0, "abcd", 5)] in told and [(0, "bcde", 2)] in told and [(0, "bcdf", 3)] in told
    assert sum(len(p) for p in told) == grams.where("k = 4").count()


def test_flow_gives_single_words(spark):
    """Records that begin with a word are its occurrences: flow and piece ends."""
    import pyarrow as pa

    text = ["a b c d e. a b, a", "b b b b b b"]
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array(text)], names=["lang", "text"])
    ((t, w, h, _, _),) = phrases._read([batch])
    made = phrases.records(t, w, h, np.ones(len(h), bool))
    single = np.isin(np.arange(len(h)), np.r_[4, 6, 7, len(h) - 1])  # last words of pieces
    assert len(made) == len(h) - single.sum()
    sums, n = phrases.sums(made[:, :3], np.ones(len(made), np.uint64))
    assert n.sum() == len(made) and len(sums) == len(np.unique(sums, axis=0))
