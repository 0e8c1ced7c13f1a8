"""Queries over the derived inputs and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import boxes as B
from ..operators import colour as C
from ..operators import recognise as R
from ..sources import derived as D

D1 = """boxes AS (SELECT image_id, box_id, x0, y0, x0 + CASE WHEN tall THEN sh ELSE lg END AS x1, y0 + CASE WHEN tall THEN lg ELSE sh END AS y1, score, text FROM (
 SELECT l_orderkey AS image_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS box_id,
 (l_partkey % 16) * 12 AS x0, (l_suppkey % 12) * 10 AS y0, 30 + trunc(l_quantity)::BIGINT AS lg, 6 + (l_partkey % 5) * 4 AS sh, l_linenumber = 7 AS tall, l_discount * 10 AS score, 'w' || l_partkey AS text FROM lineitem))"""
D2 = """layout AS (SELECT *, xmin + 90 AS xmax, ymin + 60 AS ymax FROM (SELECT o_orderkey AS image_id, k, (o_custkey + k) % 11 AS label, ((o_orderkey * 7 + k * 13) % 100) / 100.0::DOUBLE AS score,
 (o_custkey * 3 + k * 40) % 160 - 10 AS xmin, (o_custkey * 5 + k * 30) % 100 - 10 AS ymin, (o_orderkey + k * 5) % 3 AS read_order FROM orders, (SELECT unnest([0, 1, 2])::BIGINT AS k)))"""
D5 = """pixels AS (SELECT image_id, s, s % 16 AS x, s // 16 AS y, r, g, b, inside, (299 * r + 587 * g + 114 * b) // 1000 AS gray FROM (SELECT user_id AS image_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS s,
 event_id * 37 % 256 AS r, trunc(value)::BIGINT % 256 AS g, (event_id * 91 + user_id) % 256 AS b, event_type <> 'error' AS inside FROM events))"""
EDGES = """d AS (SELECT *, y1 - y0 > x1 - x0 AS tall, least(x1 - x0, y1 - y0) AS size FROM boxes),
edges AS (SELECT p.image_id, p.box_id AS a, q.box_id AS b FROM d p JOIN d q ON p.image_id = q.image_id AND p.tall = q.tall AND p.box_id < q.box_id AND greatest(p.size, q.size) <= 1.5 * least(p.size, q.size)
 AND greatest(0, greatest(p.x0, q.x0) - least(p.x1, q.x1)) ** 2 + greatest(0, greatest(p.y0, q.y0) - least(p.y1, q.y1)) ** 2 <= 100)"""
CLUSTERS = """sym AS (SELECT image_id, a, b FROM edges UNION ALL SELECT image_id, b, a FROM edges),
reach AS (SELECT image_id, a, b FROM sym UNION SELECT r.image_id, r.a, s.b FROM reach r JOIN sym s ON r.image_id = s.image_id AND r.b = s.a),
lab AS (SELECT image_id, a AS box_id, min(b) AS m FROM reach GROUP BY ALL),
clustered AS (SELECT d.*, least(d.box_id, coalesce(lab.m, d.box_id)) AS cluster FROM d LEFT JOIN lab ON d.image_id = lab.image_id AND d.box_id = lab.box_id)"""
PARENTS = "parents AS (SELECT image_id, k AS parent_id, xmin AS x0, ymin AS y0, xmax AS x1, ymax AS y1 FROM layout)"
ASSIGN = """ov AS (SELECT c.image_id, c.box_id, p.parent_id, greatest(0, least(c.x1, p.x1) - greatest(c.x0, p.x0)) * greatest(0, least(c.y1, p.y1) - greatest(c.y0, p.y0)) AS o, (c.x1 - c.x0) * (c.y1 - c.y0) AS ar
 FROM boxes c JOIN parents p ON c.image_id = p.image_id AND (c.y1 - c.y0 > c.x1 - c.x0) = (p.y1 - p.y0 > p.x1 - p.x0)),
assigned AS (SELECT image_id, box_id, parent_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id, box_id ORDER BY o DESC, parent_id) AS rn FROM ov WHERE o >= 0.8 * ar AND ar > 0) WHERE rn = 1)"""


def _clustered(spark, d):
    return B.box_clusters(D.boxes(spark, d))


def _parents(spark, d):
    return D.layout_rows(spark, d).select("image_id", F.col("k").alias("parent_id"), F.col("xmin").alias("x0"), F.col("ymin").alias("y0"), F.col("xmax").alias("x1"), F.col("ymax").alias("y1"))


def _metrics(spark, d):
    return D.boxes(spark, d).select("image_id", "box_id", g.width().alias("w"), g.height().alias("h"), g.area().alias("area"), g.center_x().alias("cx"), g.center_y().alias("cy"), g.vertical().alias("tall"))


def _layout(spark, d):
    r = D.layout_rows(spark, d).where("score >= 0.3")
    c = lambda v, hi: g.clamp(F.col(v), F.lit(0), F.lit(hi)).cast("long").alias(v)
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy("read_order", "k")).cast("long").alias("pos")
    return r.select("image_id", "k", "label", c("xmin", 199), c("ymin", 149), c("xmax", 199), c("ymax", 149), rank)


def _runs(spark, d):
    p = D.pixels(spark, d).where("r < 96").select("image_id", F.expr("s div 4").alias("pos")).distinct()
    return C.runs(p, "image_id", "pos")


def _ctc(spark, d):
    e = D.table(spark, d, "embeddings")
    out = R.ctc(e, F.col("embedding"), 8, ["", "a", "b", "c", "d", "e", "f", " "])
    return out.select("vec_id", "text", F.round("score", 6).alias("score"))


def _full_text(spark, d):
    c = D.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    return c.select("conv_id", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))


def _base64(spark, d):
    t = D.table(spark, d, "documents").select("doc_id", "text", F.base64(F.encode("text", "UTF-8")).alias("p"))
    sent = t.withColumn("p", F.concat(F.lit("  "), F.when(F.col("doc_id") % 2 == 0, F.col("p")).otherwise(F.translate("p", "+/", "-_")), F.lit(" ")))
    back = F.decode(F.unbase64(F.translate(F.trim("p"), "-_", "+/")), "UTF-8")
    return sent.select("doc_id", (back == F.col("text")).alias("same"), F.sha2(back, 256).alias("sha"))


QUERIES = {
    "aabb_metrics": _metrics,
    "proximity_edges": lambda s, d: B.proximity_edges(D.boxes(s, d)),
    "box_clusters": lambda s, d: _clustered(s, d).select("image_id", "box_id", "cluster"),
    "merge_lines": lambda s, d: B.merged_lines(_clustered(s, d)).drop("size"),
    "assign_children": lambda s, d: B.assign_children(D.boxes(s, d), _parents(s, d)),
    "orphan_children": lambda s, d: B.orphans(D.boxes(s, d), B.assign_children(D.boxes(s, d), _parents(s, d))).select("image_id", "box_id"),
    "layout_postprocess": _layout,
    "gray_histogram": lambda s, d: C.gray_histogram(D.pixels(s, d)),
    "otsu_threshold": lambda s, d: C.otsu(D.pixels(s, d)),
    "upper_median_rgb": lambda s, d: C.upper_medians(D.pixels(s, d)),
    "cluster_variance": lambda s, d: C.cluster_variance(D.pixels(s, d)),
    "foreground_runs": _runs,
    "ctc_decode": _ctc,
    "full_text": _full_text,
    "base64_ingest": _base64,
}

SQL = {
    "aabb_metrics": f"WITH {D1} SELECT image_id, box_id, x1 - x0 AS w, y1 - y0 AS h, (x1 - x0) * (y1 - y0) AS area, (x0 + x1) // 2 AS cx, (y0 + y1) // 2 AS cy, y1 - y0 > x1 - x0 AS tall FROM boxes",
    "proximity_edges": f"WITH {D1}, {EDGES} SELECT image_id, a, b FROM edges",
    "box_clusters": f"WITH RECURSIVE {D1}, {EDGES}, {CLUSTERS} SELECT image_id, box_id, cluster FROM clustered",
    "merge_lines": f"""WITH RECURSIVE {D1}, {EDGES}, {CLUSTERS},
o AS (SELECT *, (x0 + x1) // 2 AS cx, (y0 + y1) // 2 AS cy, first_value(tall) OVER (PARTITION BY image_id, cluster ORDER BY box_id) AS down FROM clustered),
k AS (SELECT *, CASE WHEN down THEN -cx ELSE cy END AS k1, CASE WHEN down THEN cy ELSE cx END AS k2 FROM o),
m AS (SELECT image_id, cluster, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n, string_agg(text, ' ' ORDER BY k1, k2, box_id) AS text, first(score ORDER BY k1, k2, box_id) AS score FROM k GROUP BY image_id, cluster)
SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY (y0 + y1) // 2, (x0 + x1) // 2, cluster) AS line FROM m""",
    "assign_children": f"WITH {D1}, {D2}, {PARENTS}, {ASSIGN} SELECT * FROM assigned",
    "orphan_children": f"WITH {D1}, {D2}, {PARENTS}, {ASSIGN} SELECT image_id, box_id FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM assigned a WHERE a.image_id = b.image_id AND a.box_id = b.box_id)",
    "layout_postprocess": f"WITH {D2} SELECT image_id, k, label, least(199, greatest(0, xmin))::BIGINT AS xmin, least(149, greatest(0, ymin))::BIGINT AS ymin, least(199, greatest(0, xmax))::BIGINT AS xmax, least(149, greatest(0, ymax))::BIGINT AS ymax, row_number() OVER (PARTITION BY image_id ORDER BY read_order, k) AS pos FROM layout WHERE score >= 0.3",
    "gray_histogram": f"WITH {D5} SELECT image_id, gray, count(*) AS n FROM pixels WHERE inside GROUP BY ALL",
    "otsu_threshold": f"""WITH {D5}, h AS (SELECT image_id, gray, count(*) AS n FROM pixels WHERE inside GROUP BY ALL),
c AS (SELECT image_id, gray, sum(n) OVER u AS wb, sum(n * gray) OVER u AS sb, sum(n) OVER e AS w, sum(n * gray) OVER e AS s FROM h WINDOW u AS (PARTITION BY image_id ORDER BY gray), e AS (PARTITION BY image_id)),
v AS (SELECT image_id, gray, CASE WHEN w > wb THEN wb::DOUBLE * (w - wb)::DOUBLE * pow(sb::DOUBLE / wb::DOUBLE - (s - sb)::DOUBLE / (w - wb)::DOUBLE, 2.0) END AS v FROM c)
SELECT image_id, coalesce(first(gray ORDER BY v DESC NULLS LAST, gray) FILTER (v IS NOT NULL), 0)::BIGINT AS threshold FROM v GROUP BY image_id""",
    "upper_median_rgb": f"WITH {D5} SELECT image_id, percentile_disc(0.5) WITHIN GROUP (ORDER BY r DESC)::BIGINT AS r, percentile_disc(0.5) WITHIN GROUP (ORDER BY g DESC)::BIGINT AS g, percentile_disc(0.5) WITHIN GROUP (ORDER BY b DESC)::BIGINT AS b FROM pixels WHERE inside GROUP BY image_id",
    "cluster_variance": f"WITH {D5} SELECT image_id, round(coalesce(var_pop(r) + var_pop(g) + var_pop(b), 0), 4) AS variance FROM pixels WHERE inside GROUP BY image_id",
    "foreground_runs": f"""WITH {D5}, p AS (SELECT DISTINCT image_id, s // 4 AS pos FROM pixels WHERE r < 96), i AS (SELECT image_id, pos, pos - row_number() OVER (PARTITION BY image_id ORDER BY pos) AS i FROM p)
SELECT image_id, min(pos) AS start, max(pos) + 1 AS "end" FROM i GROUP BY image_id, i""",
    "ctc_decode": """WITH l AS (SELECT vec_id, i // 8 AS t, i % 8 AS c, embedding[i + 1]::DOUBLE AS p FROM embeddings, (SELECT unnest(range(64)) AS i)),
a AS (SELECT vec_id, t, first(c ORDER BY p DESC, c) AS c, max(p) AS p FROM l GROUP BY vec_id, t),
e AS (SELECT * FROM (SELECT *, lag(c) OVER (PARTITION BY vec_id ORDER BY t) AS q FROM a) WHERE c <> 0 AND (q IS NULL OR q <> c)),
g AS (SELECT vec_id, string_agg((['', 'a', 'b', 'c', 'd', 'e', 'f', ' '])[c + 1], '' ORDER BY t) AS text, exp(sum(CASE WHEN p > 0 THEN ln(p) ELSE 0 END) / count(*)) AS score FROM e GROUP BY vec_id)
SELECT m.vec_id, coalesce(g.text, '') AS text, round(coalesce(g.score, 0), 6) AS score FROM embeddings m LEFT JOIN g ON m.vec_id = g.vec_id""",
    "full_text": "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
    "base64_ingest": """WITH p AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN to_base64(encode(text)) ELSE translate(to_base64(encode(text)), '+/', '-_') END AS p FROM documents),
b AS (SELECT doc_id, text, decode(from_base64(translate(trim('  ' || p || ' '), '-_', '+/'))) AS back FROM p) SELECT doc_id, back = text AS same, sha256(back) AS sha FROM b""",
}
