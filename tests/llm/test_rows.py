"""Rows that share an id or have none, repeated rows, null columns, clashing names: each stage and operator against a plain version."""

import collections

import brute
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from attesta.llm import decontaminate, jaccard_join, source_mix, suffix_dedup, warc_bundles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["1 AS row", "'k' AS key", "2 AS size", "3 AS copies", "4 AS n", "5 AS bucket", "6 AS pick", "'h' AS hit", "7 AS spans"]


def made():
    rng = np.random.default_rng(2)
    base = [" ".join(f"w{rng.integers(400)}" for _ in range(90)) for _ in range(5)]
    near = base[0].split()
    near[40] = "changed"
    rows = [
        (None, base[0]), (None, base[1] + " tail one"), (None, base[0]), (7, base[2]), (7, base[3]), (7, base[2]), (3, base[2] + " end"), (9, " ".join(near)),
        (None, ""), (None, None), (4, ""), (4, ""), (5, " \t\n"), (11, base[4][:150]), (11, "x" + base[4]), (12, base[4]), (13, base[4]), (-5, base[1]), (20, "é" * 200), (20, "é" * 199 + "z"), (21, "short"), (None, "short"),
    ]
    return [(i, t, "en", [None, "a", "b"][k % 3], None if t is None else len(t)) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), DOCS).selectExpr("*", *CLASH).repartition(3)


def key(r):
    return repr((r["doc_id"], r["text"]))


def counted(rows):
    return collections.Counter(rows)


def ordered(spark, rows):
    """Documents in the order that suffix_dedup gives them: by id, null first, then by the hash of the row; each once."""
    df = spark.createDataFrame(sorted(set((i, t or "") for i, t in rows), key=repr), "doc_id long, text string")
    got = df.select("doc_id", "text", suffix_dedup._row().alias("row")).collect()
    return [(r.doc_id, r.text) for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.row))]


def test_suffix_dedup_keeps_rows_apart(spark, docs):
    rows = [(r[0], r[1]) for r in made()]
    order = ordered(spark, rows)
    want = {(d, t): w for (d, t), w in zip(order, brute.repeats(order), strict=True)}
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    got = [tuple(r[n] for n in names) for r in suffix_dedup.remove_repeats(docs).collect()]
    assert counted(got) == counted(want[d, t or ""] for d, t in rows)
    cut = suffix_dedup.strip_repeats(docs)
    assert cut.columns == docs.columns
    cover = {}
    seen = set()
    for d, t in order:
        raw = t.encode()
        flags = bytearray(len(raw))
        for i in range(len(raw) - 99):
            g = raw[i : i + 100]
            if g in seen:
                flags[i : i + 100] = b"\1" * 100
            seen.add(g)
        cover[d, t] = bytes(b for b, x in zip(raw, flags) if not x).decode("utf-8", "ignore")
    assert counted((r.doc_id, r.text) for r in cut.collect()) == counted((d, None if t is None else cover[d, t]) for d, t in rows)


def test_suffix_dedup_deals_texts_out_once(spark):
    """One exchange of texts serves both joins: with anchors' places, and with spans."""
    docs = spark.createDataFrame(made(), DOCS)
    for out in (suffix_dedup.remove_repeats(docs), suffix_dedup.strip_repeats(docs)):
        out.collect()
        assert out._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") == 1


def test_suffix_dedup_squeezes_contexts():
    rng = np.random.default_rng(3)
    words = [f"{w:x}" for w in rng.integers(1 << 20, size=2000)]
    data = np.frombuffer(" ".join(words[i] for i in rng.integers(2000, size=20_000)).encode(), np.uint8)
    pos = np.arange(100, len(data) - 100, 35)
    zero = np.zeros(1, np.int64)
    c, _ = suffix_dedup.contexts(data, np.array([0, len(data)]), np.zeros(len(pos), np.int64), pos, zero, zero, 100, 32)
    blobs = suffix_dedup.squeezed(c, (np.arange(len(c)) % 4).astype(np.int32), 0)
    back = np.concatenate([suffix_dedup.unsqueezed(pa.chunked_array([blobs.column("data").slice(i, 1)]), c.dtype) for i in range(4)])
    assert (np.sort(back, order="pos") == c).all()
    assert sum(len(x) for x in blobs.column("data").to_pylist()) < 0.5 * c.nbytes
    assert not len(suffix_dedup.unsqueezed(pa.chunked_array([], pa.binary()), c.dtype))


def test_anchors_of_a_long_text_in_pieces():
    from attesta.llm.textnum import Texts

    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 30_000).astype(np.uint8)
    whole = suffix_dedup.anchors(Texts(data, np.array([0, len(data)]), 0), 100, 32)
    parts = suffix_dedup.anchors(Texts(data, np.array([0, len(data)]), 0), 100, 32, piece=1000)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_jaccard_rows_without_an_id(docs):
    rows = [(r[0], r[1]) for r in made()]
    sets = brute.jaccard([(k, t) for k, (_, t) in enumerate(rows)])  # by place
    least = {}
    for k, (_, _, root) in enumerate(sets):
        own = rows[k][0]
        if own is not None:
            least[root] = min(least.get(root, own), own)
    want = counted((rows[k][0], n, least.get(root) if n else rows[k][0]) for k, (_, n, root) in enumerate(sets))
    got = counted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect())
    assert got == want


def test_near_copy_stage(spark, docs):
    rows = [(r[0], r[1]) for r in made()]
    sets = brute.jaccard([(k, t) for k, (_, t) in enumerate(rows)])
    groups = collections.defaultdict(list)
    for k, (_, n, root) in enumerate(sets):
        groups[root if n else ("empty", k)].append(rows[k])
    kept = corpus_pipeline.near_copy_stage(spark, docs, "")
    assert sorted(kept.columns) == sorted(docs.columns)
    left = counted((r.doc_id, r.text) for r in kept.collect())
    assert sum(left.values()) == len(groups)
    for g in groups.values():
        ids = [i for i, _ in g if i is not None]
        may = [x for x in g if x[0] == (min(ids) if ids else None)]
        assert sum(left[x] > 0 for x in set(may)) == 1 if len(may) > 1 else left[may[0]] >= 1
    assert corpus_pipeline.near_copy_stage(spark, docs.limit(0), "").count() == 0


def test_repeat_stage_empty_and_length(spark, docs):
    out = corpus_pipeline.repeat_stage(spark, docs, "")
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect()) and out.schema == docs.schema
    assert corpus_pipeline.repeat_stage(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("block", [1, 100])
def test_leak_stage(spark, docs, tmp_path, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    words = made()[3][1].split()
    items = [(1, " ".join(words[5:20])), (2, "short"), (3, None), (None, "z z z")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(r[0], r[1]) for r in made()]
    want = counted(x for x, c in zip(rows, brute.contamination(rows, items), strict=True) if not c[5])
    out = corpus_pipeline.leak_stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and counted((r.doc_id, r.text) for r in out.collect()) == want
    assert corpus_pipeline.leak_stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_quality_stage(spark, docs, tmp_path):
    labels = [(i, i % 2, 0) for i in range(5)] + [(None, 1, 0), (7, None, None), (7, 1, 0), (7, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.quality_stage(spark, docs, str(tmp_path))
    # too few labels for a rule: what is left is the base rule
    assert out.columns == docs.columns
    assert counted((r.doc_id, r.text) for r in out.collect()) == counted((i, t) for i, t, *_ in made() if not brute.quality(t)[5])
    assert corpus_pipeline.quality_stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_mix_stage(spark, docs):
    rows = made()
    sizes = collections.Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(brute.WORD.findall(t or ""))
    aims = brute.mix_targets(sizes)
    out = corpus_pipeline.mix_stage(spark, docs, "")
    assert sorted(out.columns) == sorted(docs.columns)  # copies gave way
    got = out.collect()
    taken = collections.Counter()
    for r in got:
        assert 1 <= r.copies <= 3
        taken[r.source] += r.copies * len(brute.WORD.findall(r.text))
    whole = counted((i, t, s) for i, t, _, s, _ in rows)
    assert all(n <= whole[x] for x, n in counted((r.doc_id, r.text, r.source) for r in got).items())
    for s, t in aims.items():
        assert abs(taken[s] - t) <= max(len(brute.WORD.findall(x[1] or "")) for x in rows if x[3] == s)
    assert counted((r.doc_id, r.text, r.copies) for r in corpus_pipeline.mix_stage(spark, docs.repartition(5), "").collect()) == counted((r.doc_id, r.text, r.copies) for r in got)
    assert corpus_pipeline.mix_stage(spark, docs.limit(0), "").count() == 0
    # null ids and one source: no row is lost
    same = spark.createDataFrame([(None, "a b", "s"), (None, "c d", "s"), (1, "e f", "s")], "doc_id long, text string, source string")
    assert source_mix.take_mix(same).count() == 3


def test_whole_pipeline(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing that occurs")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "text", "copies"} <= set(out.columns) and out.count() > 0


def test_warc_null_payload_and_odd_urls(spark):
    rows = [(1, "http://a/%0Ab", None), (2, "http://a/\nb c\x00", "x" * 100), (None, None, "x" * 100), (2, "http://é/%", ""), (4, "", "é" * 60)]
    df = spark.createDataFrame(rows, "page_id long, url string, payload string").selectExpr("page_id", "url", "cast(payload AS binary) AS payload", "1 AS digest", "2 AS key")
    got = warc_bundles.read_bundles(warc_bundles.write_bundles(warc_bundles.revisits(df))).collect()
    want = [(i, u, None if i is None else (p or "").encode(), len((p or "").encode()), 2 if i is None else None) for i, u, p in rows]
    assert sorted(((r.page_id, r.url, None if r.record_type == "revisit" else bytes(r.payload), r.payload_bytes, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    raw = warc_bundles.record(1, "u", b"p", "d", 1, None)
    fields, payload = warc_bundles.parse(raw)
    assert payload == b"p" and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "Content-Type"} <= fields.keys()
