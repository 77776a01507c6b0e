"""Keys that very many rows share don't bring those rows into one task."""

import collections

import numpy as np
from pyspark.sql import functions as F

from attesta.llm import jaccard_join, shared, warc_bundles


def test_small_and_repeated_payloads_are_dealt_out(spark):
    """Two thirds of the pages are empty, a sixth share a long payload, some have no id."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(old, ("32", "false", "-1"), strict=True):
        spark.conf.set(k, v)
    try:
        body = F.when(F.col("id") % 3 > 0, F.lit(None)).when(F.col("id") % 6 == 0, F.lit("x" * 300)).otherwise(F.concat(F.lit("y" * 200), (F.col("id") % 500).cast("string")))
        pages = spark.range(0, 6000, 1, 16).select(F.when(F.col("id") % 30 > 0, F.col("id")).alias("page_id"), F.lit("u").alias("url"), body.cast("binary").alias("payload"))
        out = warc_bundles.revisits(pages)
        rows = out.select("page_id", "payload", "refers_to", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(rows) == 6000
    tasks = collections.Counter(r.task for r in rows)
    assert len(tasks) > 20 and max(tasks.values()) < 4 * 6000 / 32
    first = {}
    for r in rows:
        if len(r.payload) >= 100 and r.page_id is not None:
            first[r.payload] = min(r.page_id, first.get(r.payload, r.page_id))
    groups = collections.Counter(r.payload for r in rows)
    for r in rows:
        want = first.get(r.payload) if len(r.payload) >= 100 and groups[r.payload] > 1 and r.page_id != first.get(r.payload) else None
        assert r.refers_to == want


def _shuffled(spark, job):
    """Bytes that a job writes for exchanges, and its result."""
    sc, jvm = spark._jsc.sc(), spark._jvm
    none = lambda: jvm.java.util.ArrayList()

    def stages() -> dict[int, int]:
        sc.listenerBus().waitUntilEmpty()
        got = sc.statusStore().stageList(none(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none())
        return {got.apply(i).stageId(): got.apply(i).shuffleWriteBytes() for i in range(got.size())}

    before = stages()
    out = job()
    return sum(n for k, n in stages().items() if k not in before), out


def test_near_copies_deal_out_little(spark):
    """Shingles of one prefix, texts of no list and rows that stay are in no exchange, whose files stay until the driver collects its garbage."""
    rng = np.random.default_rng(7)
    made = [(i, " ".join(map(str, rng.integers(1 << 40, size=400)))) for i in range(300)]
    made += [(300 + i, made[i][1] + " more") for i in range(20)] + made[:2]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3).cache()
    size = sum(len(t) for _, t in made)
    assert df.count() == len(made)
    moved, got = _shuffled(spark, lambda: jaccard_join.jaccard_components(df).collect())
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((i, i - 300 if i >= 300 else i) for i, _ in made)
    assert moved < size / 2
    moved, got = _shuffled(spark, lambda: jaccard_join.keep_one(df).collect())
    assert sorted((r.doc_id, r.text) for r in got) == made[:300]
    assert moved < size / 2
    df.unpersist()


def test_sketches_keep_all_that_link(spark):
    """Sets in lists of one shingle: all with a link are kept, whatever the sizes, most without one are not."""
    rng = np.random.default_rng(11)
    sets = [set(rng.integers(1 << 40, size=int(n)).tolist()) for n in rng.integers(2, 900, size=60)]
    for s in sets[:30]:  # sets of other sizes that just link, or just don't
        for share in (0.82, 0.79):
            sets.append(set(list(s)[: max(1, int(len(s) * share))]))
    df = spark.createDataFrame([(i, " ".join(map(str, s))) for i, s in enumerate(sets)], "row long, text string")
    got = {r.row: r for r in jaccard_join._sketches(df, 1).collect()}
    n, sketches = np.array([got[i].n for i in range(len(sets))]), [bytes(got[i].sketch) for i in range(len(sets))]
    assert n.tolist() == [len(s) for s in sets]
    for percent in (40, 50, 80, 100):
        keep = jaccard_join.may_have_link(n, sketches, percent)
        linked = [any(100 * len(s & t) >= percent * len(s | t) for j, t in enumerate(sets) if j != i) for i, s in enumerate(sets)]
        assert all(keep[np.flatnonzero(linked)])
        assert percent < 80 or keep.sum() < sum(linked) + 25


def test_rows_that_may_be_in_a_table(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 100 > 0, F.col("id")).alias("a b"), F.lit(1).alias("part"))
    among = df.where("`a b` % 7 = 3").select("a b")
    got = shared.may_be_in(df, "a b", among, "may").collect()
    assert len(got) == 5000 and got[0].asDict().keys() == {"a b", "part", "may"}
    assert all(r["may"] for r in got if (r["a b"] or 0) % 7 == 3) and sum(r["may"] for r in got) < 5000 / 7 * 1.7
    assert shared.may_be_in(df, "a b", among.limit(0)).count() == 0
    assert 700 < shared.may_be_in(df, "a b", among).count() < 1300
