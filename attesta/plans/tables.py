"""The given tables in the shapes that the operators take; each with the same shape in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators.statistics import cells_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


STEP_OF = {"1-URGENT": "document", "2-HIGH": "selfie", "3-MEDIUM": "antispoof", "4-NOT SPECIFIED": "face_match", "5-LOW": "liveness"}


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as step results of customers' cases: the newest order of each priority."""
    o = table(spark, sf_dir, "orders")
    step = F.element_at(F.create_map(*(F.lit(x) for kv in STEP_OF.items() for x in kv)), F.col("o_orderpriority"))
    newest = F.struct("o_orderkey", "o_orderstatus", "o_totalprice")
    o = o.groupBy(F.col("o_custkey").alias("case_id"), step.alias("step")).agg(F.max(newest).alias("x"))
    decision = F.when(F.col("x.o_orderstatus") == "F", "pass").when(F.col("x.o_orderstatus") == "O", "review").otherwise("fail")
    status = F.when(F.col("x.o_orderkey") % 11 == 0, "unavailable").otherwise("done")
    return o.select("case_id", "step", F.col("x.o_orderkey").alias("result_id"), status.alias("status"), decision.alias("decision"), F.round(F.col("x.o_totalprice") / 500000, 4).alias("score"))


RESULTS = """
    results AS (SELECT o_custkey AS case_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'document' WHEN '2-HIGH' THEN 'selfie' WHEN '3-MEDIUM' THEN 'antispoof' WHEN '4-NOT SPECIFIED' THEN 'face_match' ELSE 'liveness' END AS step,
        o_orderkey AS result_id, CASE WHEN o_orderkey % 11 = 0 THEN 'unavailable' ELSE 'done' END AS status,
        CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'O' THEN 'review' ELSE 'fail' END AS decision, round(o_totalprice / 500000, 4) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1),
    reasons AS (SELECT case_id, step, CASE WHEN decision = 'fail' THEN CASE result_id % 3 WHEN 0 THEN 'spoof_detected' WHEN 1 THEN 'faces_do_not_match' ELSE 'national_id_checksum' END ELSE 'under_age' END AS code,
        CASE decision WHEN 'fail' THEN 'error' ELSE 'warn' END AS severity FROM results WHERE decision = 'fail' OR (decision = 'review' AND result_id % 2 = 0))
"""


def reasons(res: DataFrame) -> DataFrame:
    k = F.col("result_id")
    code = F.when(F.col("decision") == "fail", F.when(k % 3 == 0, "spoof_detected").when(k % 3 == 1, "faces_do_not_match").otherwise("national_id_checksum")).otherwise("under_age")
    some = res.where((F.col("decision") == "fail") | ((F.col("decision") == "review") & (k % 2 == 0)))
    return some.select("case_id", "step", code.alias("code"), F.when(F.col("decision") == "fail", "error").otherwise("warn").alias("severity"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of users' sessions; k is what props say."""
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "ts", "event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


FRAMES = "frames AS (SELECT user_id, ts, event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"
ORDER = ["ts", "event_id"]


#: Features of a line item.
FEATURES = ["quantity", "discount", "tax"]


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as regions of photos, with a column for each feature."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("photo"), F.col("l_returnflag").alias("region"), *(F.col(f"l_{f}").cast("double").alias(f) for f in FEATURES))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as cells: photo, region, and three features as rows."""
    return cells_of(measured(spark, sf_dir), FEATURES)


CELLS = """cells AS (SELECT l_orderkey AS photo, l_returnflag AS region, 'quantity' AS feature, CAST(l_quantity AS DOUBLE) AS value FROM lineitem
    UNION ALL SELECT l_orderkey, l_returnflag, 'discount', CAST(l_discount AS DOUBLE) FROM lineitem UNION ALL SELECT l_orderkey, l_returnflag, 'tax', CAST(l_tax AS DOUBLE) FROM lineitem)"""
REFERENCE = f"""{CELLS},
    enough AS (SELECT region FROM cells GROUP BY region HAVING count(DISTINCT photo) >= 20),
    mid AS (SELECT region, feature, quantile_cont(value, 0.5) AS median, count(value) AS n FROM cells SEMI JOIN enough USING (region) GROUP BY 1, 2),
    reference AS (SELECT m.region, m.feature, any_value(median) AS median, greatest(quantile_cont(abs(value - median), 0.5) * 1.4826, 0.001) AS scale, any_value(n) AS n FROM cells c JOIN mid m ON c.region = m.region AND c.feature = m.feature GROUP BY 1, 2),
    dev AS (SELECT photo, c.region, c.feature, max(abs(value - median) / scale) AS deviation FROM cells c JOIN reference r ON c.region = r.region AND c.feature = r.feature GROUP BY 1, 2, 3),
    limits AS (SELECT region, feature, round(quantile_cont(deviation, 1 - 0.02 / 3), 3) AS "limit" FROM dev GROUP BY 1, 2 HAVING round(quantile_cont(deviation, 1 - 0.02 / 3), 3) > 0)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a label: score from their length, genuine where the quality is 1."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.select("doc_id", "lang", "source", "n_chars").join(lab, "doc_id").withColumn("score", (F.col("n_chars") % 1000) / 1000.0)


LABELLED = "labelled AS (SELECT d.doc_id, lang, source, n_chars, quality, toxic, (n_chars % 1000) / 1000.0 AS score FROM documents d JOIN labels USING (doc_id))"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct words of documents, with A-Z in lower case, and those of part names as they are, misread and cut short, as names to resolve."""
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[ \x09-\x0D]+")).alias("name")).distinct().select(low("name").alias("name"))
    p = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w")).distinct()
    p = p.select(F.explode(F.array("w", F.translate("w", "kc", "ck"), F.substring("w", 2, 20))).alias("name"))
    w = w.union(p).where("name <> ''").distinct()
    return w.withColumn("key", F.col("name")).withColumn("fold", F.translate("name", "cksz", "kkss"))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names as a closed vocabulary, in order of their first part."""
    p = table(spark, sf_dir, "part")
    w = p.select("p_partkey", F.posexplode(F.split(F.lower("p_name"), " ")).alias("i", "word"))
    w = w.groupBy("word").agg(F.min(F.struct("p_partkey", "i")).alias("at"))
    return w.select((F.col("at.p_partkey") * 10 + F.col("at.i")).alias("ord"), "word", F.col("word").alias("key"), F.translate("word", "cksz", "kkss").alias("fold"))


NAMES = """
    names AS (SELECT DISTINCT name, translate(name, 'cksz', 'kkss') AS fold, regexp_replace(name, '[^\\x00-\\x7F]', '?', 'g') AS plain FROM (SELECT unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\x09-\\x0D]+')) AS name FROM documents UNION ALL SELECT unnest([w, translate(w, 'kc', 'ck'), substr(w, 2)]) FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part)) WHERE name <> ''),
    lexicon AS (SELECT min(p_partkey * 10 + i) AS ord, word, translate(word, 'cksz', 'kkss') AS fold FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS word, unnest(range(0, len(string_split(p_name, ' ')))) AS i FROM part) GROUP BY word)"""
