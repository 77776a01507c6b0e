"""Each operator against a plain version: the smallest tables, and rows that are odd in every way."""

import math
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.llm import chat_format, decontaminate, jaccard_join, license_scan, maxent_lm, quality_rules, source_mix, suffix_dedup, url_filter, warc_bundles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(60_000))


def odd_docs():
    base = " ".join(f"word{i}" for i in range(120))
    near = base.replace("word7 ", "other ")
    texts = [None, "", " \t\n ", "one", "one", "One two\x0bthree", base, base, near, base.upper(), LONG, LONG + " end", "é" * 300, "é" * 300 + "x", "a\n\na\nb\n a\na", "all rights reserved CC-BY general public license", "all rights", "<s>x</s>", "0" * 500, "\x1c\x1d sep \x85 nel   nbsp", base[:99] + "|", base[:100] + "|", base[:101] + "|"]
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, (30, base, None, "s1", None), (30, base, None, "s1", None)]


@pytest.fixture(scope="module", params=["table", "odd", "empty"])
def docs(request, spark, sf):
    if request.param == "table":
        return spark.read.parquet(f"{sf}/documents.parquet")
    rows = odd_docs() if request.param == "odd" else []
    # columns of other operators' names must not matter
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS n", "'x' AS key", "2 AS size", "3 AS `bucket`", "true AS kept")


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_quality_counts(docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out, rules = quality_rules.quality(docs, labels)
    assert rules == []
    want = [(d, *brute.quality(t)) for d, t in pairs(docs)]
    assert rows(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)
    assert all(r.kept == (not r.base_failed) for r in out.collect())


def test_license_scan(docs):
    out = license_scan.license_scan(docs)
    want = [(d, *brute.licenses(t, license_scan.PHRASES)) for d, t in pairs(docs)]
    assert rows(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)
    for r in out.collect():
        assert 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))


def test_license_templates(spark):
    text = license_scan.TEMPLATES[0][0]
    cut = text.split()
    made = [(0, "x " + text + " y"), (1, " ".join(cut[:12] + ["odd", "words"] + cut[12:])), (2, " ".join(cut[:4])), (3, " ".join(reversed(cut)))]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got[0].labels == got[1].labels == "mit" and got[0].score == 1 and got[1].score > 0.9
    assert got[2].labels == got[3].labels == ""
    # each template alone carries its label, whole or in two halves with a few words between
    for cut_in in (False, True):
        whole = []
        for k, (t, _) in enumerate(license_scan.TEMPLATES):
            w = t.split()
            whole.append((k, " ".join(w[: len(w) // 2] + ["qq", "zz"] * cut_in + w[len(w) // 2 :])))
        for r in license_scan.license_scan(spark.createDataFrame(whole, "doc_id long, text string")).collect():
            assert license_scan.TEMPLATES[r.doc_id][1] in r.labels.split(",") and (r.score == 1 or cut_in and r.score > 0.9)


def longest_common(a, b):
    best = [0] * (len(b) + 1)
    top = 0
    for x in a:
        best = [0] + [best[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        top = max(top, *best)
    return top


def test_license_labels_follow_from_shared_words(docs):
    """A label of the method's own needs a shared run of words, and one that covers a template is enough."""
    templates = [(t.split(), label) for t, label in license_scan.TEMPLATES]
    for r, (_, text) in zip(license_scan.license_scan(docs.orderBy("doc_id", "text")).orderBy("doc_id").collect(), pairs(docs), strict=True):
        w = brute.TERM.findall(brute.lower(text))[:3000]
        own = set(filter(None, r.labels.split(","))) - set(filter(None, r.base_labels.split(",")))
        if len(w) == 3000:
            continue
        run = {}
        for t, label in templates:
            run[label] = max(run.get(label, 0), longest_common(w, t) / len(t)) if own or "license" in w or "permission" in w else 0
        assert all(run[label] > 0 for label in own)
        assert all(label in r.labels.split(",") for label, share in run.items() if share >= 0.6)



@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=12), min_size=1, max_size=4), st.lists(st.sampled_from("abc"), max_size=40))
def test_automaton_statistics(templates, text):
    a = license_scan.Automaton((), [(" ".join(t), str(i)) for i, t in enumerate(templates)], 1)
    ids = [a.spelt.index(x.encode()) for x in text if x.encode() in a.spelt]
    text = [x for x in text if x.encode() in a.spelt]
    inside = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    best = [max((k for k in range(e + 1) if tuple(text[e - k + 1 : e + 1]) in inside or k == 0), default=0) for e in range(len(text))]
    best = [max(k for k in range(0, e + 2) if k == 0 or tuple(text[e + 1 - k : e + 1]) in inside) for e in range(len(text))]
    _, matches = a.read(ids, 0)
    want = [(e + 1 - best[e], best[e]) for e in range(len(text)) if best[e] and (e + 1 == len(text) or best[e + 1] <= best[e])]
    assert [(f, n) for f, n, _ in matches] == want


def test_suffix_dedup(docs):
    out = suffix_dedup.remove_repeats(docs)
    want = brute.repeats(pairs(docs.dropDuplicates(["doc_id", "text"])))
    got = rows(out.distinct(), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert out.count() == docs.count()
    assert got == sorted(want, key=repr)


def test_suffix_dedup_small_alphabet(spark):
    rng = np.random.default_rng(3)
    parts = ["".join(rng.choice(list("ab \né"), 130)) for _ in range(12)]
    made = [(i, "".join(parts[j][: int(rng.integers(60, 130))] for j in rng.integers(0, 12, 4)) + "ab" * int(rng.integers(0, 90))) for i in range(120)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    for k, batch in ((32, 1 << 15), (24, 7), (48, 40)):  # small batches: many levels
        assert rows(suffix_dedup.remove_repeats(df, k=k, batch=batch), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.repeats(made), key=repr)


def test_decontaminate(docs, spark, sf, monkeypatch):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    more = spark.createDataFrame([(900, "one"), (901, None), (902, ""), (903, "word1 word2 word3"), (904, "word1 WORD2 word3"), (905, " ".join(f"word{i}" for i in range(100, 115)))], "item_id long, text string")
    bench = bench.select("item_id", "text").union(more)
    want = sorted(brute.contamination(pairs(docs), [(r.item_id, r.text) for r in bench.collect()]), key=repr)
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(decontaminate.report(decontaminate.scan(docs, bench)), *names) == want
    monkeypatch.setattr(decontaminate, "BLOCK", 20)
    assert rows(decontaminate.report(decontaminate.scan(docs, bench)).distinct(), *names) == sorted(set(want), key=repr)
    none = decontaminate.report(decontaminate.scan(docs, bench.where("item_id < 0"))).collect()
    assert all(not r.contaminated for r in none) and len(none) == docs.count()


def test_jaccard(docs):
    assert rows(jaccard_join.jaccard_components(docs), "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard(pairs(docs)), key=repr)


@pytest.mark.parametrize("hot", [5, 5_000])
def test_jaccard_chains_and_crowds(spark, monkeypatch, hot):
    """Links that only hold step by step, many near copies, and lists that are long without a link; many shingles hot, or none."""
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    rng = np.random.default_rng(5)
    made, shared = [], [f"s{i}" for i in range(12)]
    for g in range(40):
        words = [f"g{g}w{i}" for i in range(int(rng.integers(8, 90)))]
        for _ in range(int(rng.integers(1, 60))):
            if rng.random() < 0.6:
                words = words.copy()
                words[int(rng.integers(len(words)))] = f"n{rng.integers(1 << 30)}"
            made.append((len(made), " ".join(shared + words if g % 2 else words)))
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    for percent in (80, 60):
        assert rows(jaccard_join.jaccard_components(df, 3, percent), "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard(made, 3, percent), key=repr)


@pytest.mark.parametrize("chunk", [1, 3, 16])
def test_jaccard_long_lists_in_cells(spark, chunk):
    """Different near copies of one text, chains that only touch away from the hub, and a second crowd that shares one shingle."""
    rng = np.random.default_rng(chunk)
    base = [f"w{i}" for i in range(60)]
    made = [(0, " ".join(base))]
    for i in range(1, 60):
        w = list(base)
        for at in rng.choice(60, int(rng.integers(1, 4)), replace=False):
            w[at] = f"x{i}"
        made.append((i, " ".join(w)))
    for i in range(60, 90):
        made.append((i, " ".join(base[:7] + [f"y{j}" for j in range((i - 60) * 2, (i - 60) * 2 + 30)])))
    df = spark.createDataFrame(made, "doc_id long, text string")
    for percent in (60, 80):
        got = rows(jaccard_join.jaccard_components(df, 3, percent, chunk), "doc_id", "n_shingles", "component_id")
        assert got == sorted(brute.jaccard(made, 3, percent), key=repr)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(0, 5)), max_size=12), st.integers(0, 400))
def test_fit_lengths(lengths, budget):
    size, count = np.array([s for s, _ in lengths], int), np.array([c for _, c in lengths], int)
    take = source_mix.fit_lengths(size, count, budget)
    assert ((take >= 0) & (take <= count)).all() and (take * size).sum() <= budget
    if sum(size * count) < budget or len(lengths) == 0:
        return
    bits = 1
    for s, c in lengths:
        for _ in range(c):
            bits |= bits << s
    nearest = max(k for k in range(budget + 1) if bits >> k & 1)
    # without a share taken first all is left to the knapsack, which finds the nearest sum there is
    full = source_mix.fit_lengths(size, count, budget, limit=10**6, share=False)
    assert ((full >= 0) & (full <= count)).all() and (full * size).sum() == nearest


def test_source_mix(docs):
    out = source_mix.mix_sources(docs).collect()
    src = {r.doc_id: (r.source, len(brute.WORD.findall(r.text or ""))) for r in docs.collect()}
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(brute.WORD.findall(r.text or ""))
    aims = brute.mix_targets(sizes) if sizes else {}
    taken = defaultdict(int)
    for r in out:
        s, n = src[r.doc_id]
        assert r["size"] == n and r.source_size == sizes[s] and math.isclose(r.target, aims[s], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 3 * n and (n == 0 or r.taken % n == 0)
        taken[s] += r.taken
    for s, t in aims.items():
        largest = max(n for x, n in src.values() if x == s)
        assert abs(taken[s] - t) <= max(1, min(largest, 0.02 * t) if len(out) > 100 else largest)
    assert len(out) == docs.count()
    again = source_mix.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def test_lm_base(docs):
    out = maxent_lm.score_documents(docs)
    want = sorted(brute.base_scores(pairs(docs)), key=repr)
    got = rows(out, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


def test_lm_beats_base_on_held_out_text(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = maxent_lm.score_documents(df).where("held_out").collect()
    assert sum(r.score for r in out) > sum(r.base_score for r in out) * 0.97
    assert all(r.score < 0 for r in out)


def test_lm_is_a_distribution(spark):
    """Over every token that can follow, probabilities sum to one."""
    text = "a b a c b a . d e A b " * 30
    df = spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string")
    counts = maxent_lm.count_tokens(df)
    m = maxent_lm.train(maxent_lm.Model(counts), df)
    number = np.arange(int(m.number.max()) + 1)
    code = np.zeros(len(number), np.uint64)
    cls, wide, narrow = m.features(np.zeros(1, np.uint64), np.array([3]), np.array([0, 1]))
    p = m.classes(wide)
    q = m.in_class(np.arange(m.heads), np.repeat(narrow, m.heads, 0))
    inside = sum(p[0, k // maxent_lm.PER_CLASS] * q[k // maxent_lm.PER_CLASS, k % maxent_lm.PER_CLASS] for k in number)
    assert abs(inside + p[0, m.heads :].sum() - 1) < 1e-3 and len(code)


def test_lm_score_word_by_word(spark):
    """``score`` against the model's probabilities taken one token at a time, with what stands before it."""
    rows = [(i, f"a b {'c d' if i % 2 else 'd c'} é e{i} x") for i in range(40)] + [(100, None), (101, "new words a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    docs = df.selectExpr("doc_id", "false AS held_out", "coalesce(text, '') AS text")
    train = docs.join(spark.createDataFrame([(i,) for (i, _), h in zip(rows, held, strict=True) if not h], "doc_id long"), "doc_id")
    counts = maxent_lm.count_tokens(train.select("text"))
    m = maxent_lm.train(maxent_lm.Model(counts), train)
    got = {r.doc_id: r.score for r in maxent_lm.score(docs, m, counts).collect()}
    kinds = Counter(x for (_, t), h in zip(rows, held, strict=True) if not h for x in [*brute.WORD.findall(brute.lower(t)), None])
    for i, t in rows:
        code, off = maxent_lm.tokens(next(maxent_lm.texts(pa.array([t or ""]))))
        words = [*brute.WORD.findall(brute.lower(t)), None]
        n, number = m.look_up(code)
        total = 0.0
        for k, w in enumerate(words):
            some, many = code[: k + 1], number[: k + 1]
            cls, wide, narrow = m.features(some, many, np.array([0, k + 1]))
            z = sum(m.w[r] for r in wide[k])
            p = math.exp(z[cls[k]] - max(z)) / sum(math.exp(x - max(z)) for x in z)
            if number[k] >= 0:
                u = sum(m.u[r, cls[k]] for r in narrow[k])
                p *= math.exp(u[number[k] % maxent_lm.PER_CLASS] - max(u)) / sum(math.exp(x - max(u)) for x in u)
            else:
                form = int(code[k]) % maxent_lm.FORMS
                p *= (kinds[w] + 0.5) / (m.form_n[form] + 0.5 * (m.form_v[form] + 1))
            total += math.log10(p)
        assert math.isclose(got[i], total, rel_tol=1e-4)


def test_lm_averages_in_a_tree(spark, monkeypatch):
    """Shards' weights meet a few at a time, with the same result."""
    monkeypatch.setattr(maxent_lm, "SHARD", 20)
    df = spark.createDataFrame([(i, f"a b c{i % 7} d") for i in range(60)], "doc_id long, text string").repartition(7, "doc_id")
    m = []
    for merge in (2, 64):
        monkeypatch.setattr(maxent_lm, "MERGE", merge)
        m.append(maxent_lm.train(maxent_lm.Model(maxent_lm.count_tokens(df.select("text"))), df))
    assert np.allclose(m[0].w, m[1].w, atol=1e-5) and np.allclose(m[0].u, m[1].u, atol=1e-5) and np.abs(m[0].w).max() > 0


@pytest.mark.parametrize("shard", [2_000, 2_000_000])
def test_lm_does_not_depend_on_partitions(spark, sf, monkeypatch, shard):
    monkeypatch.setattr(maxent_lm, "SHARD", shard)
    monkeypatch.setattr(maxent_lm, "SLICE", 10_000)
    df = spark.read.parquet(f"{sf}/documents.parquet")
    scores = []
    for n in (2, 8, 33):
        scores.append({r.doc_id: r.score for r in maxent_lm.score_documents(df.repartition(n, "n_chars")).collect()})
    assert all(math.isclose(scores[0][k], s[k], rel_tol=1e-6) for s in scores[1:] for k in s) and len(scores[0]) == df.count()


def test_chat(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    odd = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (-8, None, None, None), (-8, 1, "assistant", "␛.␛<|end|><|<|end|>turn|>"), (-8, 1, "assistant", "a\nb"), (-8, 1, "assistant", "a\nb"), (None, 1, "<|text|>", "x"), (-9, 2, "assistant", ""), (-10, 0, "assistant", LONG[:50_000])]
    df = table.unionByName(spark.createDataFrame(odd, "conv_id long, turn long, role string, text string"))
    by = defaultdict(list)
    for r in df.orderBy("turn", "role", "text").collect():
        by[r.conv_id].append((r.role or "", r.text or ""))
    by[-8].sort(key=lambda x: (x != ("", ""), x))
    want = []
    for c, turns in by.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        want.append((c, len(turns), brute.sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), brute.sha(loss)))
    made = chat_format.format_conversations(df)
    assert rows(chat_format.read_back(made), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == sorted(want, key=repr)
    assert chat_format.read_back(chat_format.format_conversations(df.where("conv_id = 10000000"))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*chat_format.CONTROLS, "␛", ".", "<", "|>", "[", "x"]), max_size=8).map("".join))
def test_escape(text):
    out = chat_format.escape(text)
    assert chat_format.unescape(out) == text
    assert not any(c in out for c in chat_format.CONTROLS)


def test_warc(spark, tmp_path):
    big, small = "x" * 100, "y" * 99
    made = [(5, "http://a/\r\nb", big), (3, None, big), (9, "u", big), (3, "u", big), (7, "u", small), (8, "u", small), (1, "u", None), (None, "u", big), (2, "u", "é" * 60)] + [(100 + i, f"http://h/{i}", f"<p>{i % 40}</p>" * 50) for i in range(300)]
    df = spark.createDataFrame(made, "page_id long, url string, payload string").selectExpr("page_id", "url", "cast(coalesce(payload, '') AS binary) AS payload").repartition(3)
    bundles = warc_bundles.write_bundles(warc_bundles.revisits(df))
    least = {}
    for i, _, p in made:
        if i is not None:
            least[p] = min(least.get(p, i), i)
    want = []
    for i, _, p in made:
        raw = (p or "").encode()
        first = least[p] if len(raw) >= 100 else i
        want.append((i, len(raw), brute.sha(raw), "response" if i == first else "revisit", None if i == first else first))
    got = warc_bundles.read_bundles(bundles)
    assert rows(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    full = {r.page_id: bytes(r.payload) for r in got.where("record_type = 'response'").collect()}
    assert full[2].decode() == "é" * 60 and full[1] == b""
    files = warc_bundles.export_bundles(bundles, str(tmp_path)).collect()
    import zstandard

    data = open(files[0].path, "rb").read()
    whole = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data)
    assert whole.startswith(b"WARC/1.1\r\n") and len(warc_bundles.seek_table(data)) >= 1
    assert warc_bundles.write_bundles(warc_bundles.revisits(df.limit(0))).count() == 0


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.org/en/12?x", "https://a.example.org/es/", "http://example.org", "http://notexample.org/es/1", "x://shop.com/fr/9#a", "x://shop.com/de/", "x://com/de/1", "x://a.net/?q=://z", "ÀB://É.org/", "http://example.org/en/1/2"]
    want = [("", "", None), ("", "", None), ("", "", None), ("example.org", "/en/12", "example.org/en/1"), ("a.example.org", "/es/", "example.org/es/"), ("example.org", "", None), ("notexample.org", "/es/1", "org/"), ("shop.com", "/fr/9", "com/fr/"), ("shop.com", "/de/", "com/de/"), ("com", "/de/1", "com/de/"), ("a.net", "/", None), ("É.org", "/", "org/"), ("example.org", "/en/1/2", "example.org/en/1")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.filter_urls(pages, pages.selectExpr("url", "1 AS label")).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule) for r in got] == want
    kind = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block", None: "allow"}
    assert [r.verdict for r in got] == [kind[r["rule"]] for r in got]
    assert url_filter.filter_urls(pages.limit(0), pages.selectExpr("url", "1 AS label").limit(0)).count() == 0


def plain_rule(url):
    """The longest rule that fits, word by word."""
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        tail = rest[end:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h + p), h + p, kind) for kind, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules_of_all_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id AS page_id", "quality AS label")
    got = url_filter.filter_urls(pages, pages.join(labels, "page_id")).collect()
    want = {r.page_id: plain_rule(r.url) for r in pages.collect()}
    assert len(got) == pages.count()
    for r in got:
        host, path, rule, verdict = want[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("allow" if r.score >= 0.5 else "block"))


def test_url_own_label_is_no_feature(spark):
    """Suffixes of one url each say nothing about it: as many good as bad of them, trees find nothing."""
    made = [(i, f"http://s{i}.x{i}/", i % 2) for i in range(400)]
    df = spark.createDataFrame(made, "page_id long, url string, label int")
    out = url_filter.filter_urls(spark.createDataFrame([(-1, "http://a.new/"), (-2, None)], "page_id long, url string"), df).collect()
    assert all(0.2 < r.score < 0.8 for r in out)


def test_url_trees_learn(spark):
    made = [(i, f"http://h{i % 17}.net/{'9' * 30 if i % 3 == 0 else 'about'}/{i}", int(i % 3 != 0)) for i in range(600)]
    df = spark.createDataFrame(made, "page_id long, url string, label int")
    out = url_filter.filter_urls(df.where("page_id % 2 = 0"), df.where("page_id % 2 = 1").select("url", "label"))
    assert all((r.verdict == "allow") == (r.page_id % 3 != 0) for r in out.collect())


def test_rules_replayed(spark, sf):
    """The learned list, read off its text and applied word by word, keeps what the query keeps."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.createDataFrame([(r.doc_id, int(r.n_chars % 3 > 0), 0) for r in docs.collect()], "doc_id long, quality int, toxic int")
    for most in (labels, spark.read.parquet(f"{sf}/labels.parquet")):
        out, rules = quality_rules.quality(docs, most)
        for r in out.collect():
            env = {k: r[k] for k in quality_rules.COUNTS}
            first = None
            for n, rule in enumerate(rules, 1):
                tests = []
                for c in rule:
                    v = eval(quality_rules.FEATURES[c.feature], {}, env)
                    tests.append(v > c.limit if c.above else v <= c.limit)
                if all(tests):
                    first = n
                    break
            assert r.rule == first and r.kept == (not r.base_failed and first is None)


def test_rules_learn(spark):
    rng = np.random.default_rng(1)
    plain = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.integers(1000)) for _ in range(80))
    made = [(i, plain() if i % 4 else " ".join(w + "***" for w in plain().split())) for i in range(400)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    out, rules = quality_rules.quality(docs, labels)
    assert rules and all(r.kept == (r.doc_id % 4 != 0) for r in out.collect())
    assert sorted(r.doc_id for r in quality_rules.keep_good(docs, labels).collect()) == [i for i in range(400) if i % 4]
