"""Queries of boxes: order lines as the detected fields of an image."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import pose
from attesta.operators import layout as L
from attesta.plans.tables import table

RULES = [("f1", "left_of", "f2"), ("f2", "above", "f3"), ("f1", "above", "f4")]
WIDE = ["f2", "f3"]
FACE = [(30, 30), (70, 32), (50, 55), (35, 75), (66, 76)]
MEASURES = ["yaw", "pitch", "roll", "left_eye", "right_eye", "mouth"]
MATRIX = [[0.9, 0.1, -5.0], [0.05, 1.1, -10.0], [0.001, 0.0005, 1.0]]


def _fields(s, d):
    x, y = F.col("l_quantity").cast("double"), (F.col("l_partkey") % 50).cast("double")
    x2, y2 = x + 1 + F.col("l_suppkey") % 20, y + 1 + 3 * F.col("l_linenumber")
    name = F.concat(F.lit("f"), F.col("l_linenumber").cast("string"))
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("image"), name.alias("class"), F.col("l_discount").alias("score"), x.alias("x1"), y.alias("y1"), x2.alias("x2"), y2.alias("y2"))


FIELDS = """
    d AS (SELECT l_orderkey AS image, 'f' || l_linenumber AS class, l_discount AS score, CAST(l_quantity AS DOUBLE) AS x1, CAST(l_partkey % 50 AS DOUBLE) AS y1,
        l_quantity + 1 + l_suppkey % 20 AS x2, CAST(l_partkey % 50 AS DOUBLE) + 1 + 3 * l_linenumber AS y2 FROM lineitem)"""


def fn17(s, d):
    r = L.layout_fit(_fields(s, d), RULES, WIDE)
    return r.select("image", F.round("layout_score", 6).alias("layout_score"), F.round("wide_fraction", 6).alias("wide_fraction"))


def fn18(s, d):
    box = L.project_box(F.struct(*L.SIDES), MATRIX, 60, 60)
    return _fields(s, d).withColumn("box", box).select("image", "class", *(F.round(F.col("box")[k], 6).alias(k) for k in L.SIDES))


def fn16(s, d):
    """Vectors as faces: five key points from a vector's numbers about a face's own, landmarks from all of them."""
    at = lambda i: F.get("embedding", F.pmod(i, F.size("embedding"))).cast("double")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    kps = F.array(*(point(x + 9 * at(F.lit(2 * i)), y + 9 * at(F.lit(2 * i + 1))) for i, (x, y) in enumerate(FACE)))
    points = F.transform(F.sequence(F.lit(0), F.lit(105)), lambda i: point(at(i), at(7 * i + 3)))
    got = pose.measure_frames(table(s, d, "embeddings").select("vec_id", kps.alias("kps"), points.alias("points")))
    return got.select("vec_id", *(F.round(c, 6).alias(c) for c in MEASURES))


def _open(name, part):
    far = lambda i, j: f"sqrt((v[1 + {i} % n] - v[1 + {j} % n]) ** 2 + (v[1 + {7 * i + 3} % n] - v[1 + {7 * j + 3} % n]) ** 2)"
    (i, j), pairs = part
    return f"round(CASE WHEN {far(i, j)} <= 1e-6 THEN 0 ELSE ({' + '.join(far(*p) for p in pairs)}) / {len(pairs)} / {far(i, j)} END, 6) AS {name}"


QUERIES = {"fn16_measure_frames": fn16, "fn17_layout_fit": fn17, "fn18_project_box": fn18}

_P = "[{'x': x1, 'y': y1}, {'x': x2, 'y': y1}, {'x': x2, 'y': y2}, {'x': x1, 'y': y2}]"
_X = f"list_transform({_P}, lambda p: (0.9 * p.x + 0.1 * p.y - 5.0) / (0.001 * p.x + 0.0005 * p.y + 1.0))"
_Y = f"list_transform({_P}, lambda p: (0.05 * p.x + 1.1 * p.y - 10.0) / (0.001 * p.x + 0.0005 * p.y + 1.0))"

SQL = {
    "fn16_measure_frames": f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, len(embedding) AS n FROM embeddings),
        k AS (SELECT vec_id, v, n, {", ".join(f"{x} + 9 * v[1 + {2 * i} % n] AS x{i}, {y} + 9 * v[1 + {2 * i + 1} % n] AS y{i}" for i, (x, y) in enumerate(FACE))} FROM e),
        t AS (SELECT *, atan2(y1 - y0, x1 - x0) AS a, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) / 2 AS half, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my FROM k),
        u AS (SELECT *, CASE WHEN 2 * half > 1e-6 THEN ((x2 - mx) * cos(a) + (y2 - my) * sin(a)) / half ELSE 0 END AS side, ((y3 + y4) / 2 - my) * cos(a) - ((x3 + x4) / 2 - mx) * sin(a) AS low, (y2 - my) * cos(a) - (x2 - mx) * sin(a) AS nose FROM t),
        s AS (SELECT *, CASE WHEN abs(low) > 1e-6 THEN nose / low ELSE 32 / 62.0::DOUBLE END AS share FROM u)
        SELECT vec_id, round(degrees(atan(side * 30 / 24)), 6) AS yaw, round(-degrees(atan((62 * share - 32) / (24 - 2 * share))), 6) AS pitch, round(degrees(a), 6) AS roll, {_open("left_eye", pose.LEFT_EYE)}, {_open("right_eye", pose.RIGHT_EYE)}, {_open("mouth", pose.MOUTH)} FROM s""",
    "fn17_layout_fit": f"""WITH {FIELDS},
    best AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY image, class ORDER BY score DESC, x1 DESC, y1 DESC, x2 DESC, y2 DESC) = 1),
    r AS (SELECT * FROM (VALUES ('f1', 'left_of', 'f2'), ('f2', 'above', 'f3'), ('f1', 'above', 'f4')) t(a, relation, b)),
    k AS (SELECT p.image, avg(CASE WHEN CASE relation WHEN 'left_of' THEN p.x1 + p.x2 < q.x1 + q.x2 ELSE p.y1 + p.y2 < q.y1 + q.y2 END THEN 1.0 ELSE 0.0 END) AS s
        FROM r JOIN best p ON p.class = r.a JOIN best q ON q.class = r.b AND q.image = p.image GROUP BY 1),
    w AS (SELECT image, avg(CASE WHEN x2 - x1 > y2 - y1 THEN 1.0 ELSE 0.0 END) AS f FROM best WHERE class IN ('f2', 'f3') GROUP BY 1)
    SELECT image, round(coalesce(s, 0.0), 6) AS layout_score, round(coalesce(f, 0.0), 6) AS wide_fraction
    FROM (SELECT DISTINCT image FROM d) LEFT JOIN k USING (image) LEFT JOIN w USING (image)""",
    "fn18_project_box": f"""WITH {FIELDS},
    m AS (SELECT image, class, greatest(0.0, list_min({_X})) AS x1, greatest(0.0, list_min({_Y})) AS y1, least(60.0, list_max({_X})) AS x2, least(60.0, list_max({_Y})) AS y2 FROM d),
    b AS (SELECT *, x2 - x1 >= 1 AND y2 - y1 >= 1 AS big FROM m)
    SELECT image, class, {", ".join(f"CASE WHEN big THEN round({k}, 6) END AS {k}" for k in L.SIDES)} FROM b""",
}
