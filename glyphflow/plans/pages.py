"""Further queries over the derived inputs: quads, hierarchies, colours, grids, crops, sessions; with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import boxes as B
from ..operators import colour as C
from ..operators import grid as G
from ..operators import raster as R
from ..operators import recognise
from ..sources import derived as D
from ..streaming import sessions
from . import catalogue as Q

QUAD = [(1, 0), (14, 1), (12, 5), (2, 4)]
CHARSET = ["", "a", "b", "c", "d", "e", "f", " "]

IMAGE = "1000 + (image_id % 7) * 300 AS width, 700 + (image_id % 5) * 400 AS height"


def _clamp_scale(spark, d):
    b = D.boxes(spark, d).withColumn("width", 1000 + (F.col("image_id") % 7) * 300).withColumn("height", 700 + (F.col("image_id") % 5) * 400)
    size = g.resized(F.col("width"), F.col("height"))
    b = b.select("image_id", "box_id", "x0", "y0", "x1", "y1", "width", "height", *[v.alias(k) for k, v in size.items()])
    to = lambda v, full, now: g.clamp(g.rounded(F.col(v) * (F.col(full) / F.col(now)) * 20), F.lit(0), F.col(full) - 1).cast("long").alias(v)
    return b.select("image_id", "box_id", "w", "h", "pad_w", "pad_h", to("x0", "width", "w"), to("y0", "height", "h"), to("x1", "width", "w"), to("y1", "height", "h"))


def _quads(spark, d):
    """D1 boxes as skewed quads: the corners start at any of the four."""
    b = D.boxes(spark, d)
    q = F.array(*[F.struct((F.col(x) + dx).alias("x"), (F.col(y) + dy).alias("y")) for x, dx, y, dy in (("x0", 2, "y0", 0), ("x1", 0, "y0", 3), ("x1", -1, "y1", 0), ("x0", 0, "y1", -2))])
    k = ((F.col("image_id") + F.col("box_id")) % 4).cast("int")
    return b.withColumn("quad", F.concat(F.slice(q, k + 1, 4 - k), F.slice(q, F.lit(1), k)))


def _points(quad):
    return [F.element_at(quad, k + 1)[c].cast("long").alias(f"{c}{k}") for k in range(4) for c in "xy"]


def _order_corners(spark, d):
    q = _quads(spark, d).withColumn("q", g.ordered_corners(F.col("quad")))
    return q.select("image_id", "box_id", *_points(F.col("q")))


def _half_turn(spark, d):
    b = D.boxes(spark, d)
    logits = F.when(F.col("box_id") % 5 != 0, F.array((F.col("box_id") * 37 % 100) / F.lit(100.0), (F.col("image_id") * 13 % 100) / F.lit(100.0)))
    b = b.withColumn("q", g.corners()).withColumn("flip", g.flipped(logits))
    return b.select("image_id", "box_id", "flip", *_points(F.when(F.col("flip"), g.half_turn(F.col("q"))).otherwise(F.col("q"))))


def _iou(spark, d):
    p = B.meeting(B.prefixed(D.boxes(spark, d), "a_"), B.prefixed(Q._parents(spark, d), "b_"), g.intersection("a_", "b_") > 0)
    both = g.intersection("a_", "b_")
    return p.select(F.col("a_image_id").alias("image_id"), F.col("a_box_id").alias("box_id"), F.col("b_parent_id").alias("parent_id"), both.alias("overlap"), F.round(both / (g.area("a_") + g.area("b_") - both), 6).alias("iou"))


def _gaps(spark, d):
    p = B.near_pairs(D.boxes(spark, d), 40)
    return p.select(F.col("a_image_id").alias("image_id"), F.col("a_box_id").alias("a"), F.col("b_box_id").alias("b"), F.round(F.sqrt(g.gap_squared("a_", "b_").cast("double")), 6).alias("gap"))


def _lines(spark, d):
    return B.merged_lines(B.box_clusters(D.boxes(spark, d)))


def _reading(spark, d):
    kids = F.array_sort(F.collect_list(F.struct("line", "text")))
    return _lines(spark, d).groupBy("image_id").agg(F.count("*").alias("n"), F.array_join(F.transform(kids, lambda k: k["text"]), "\n").alias("text"))


def _cjk(spark, d):
    w = Window.partitionBy("image_id").orderBy(g.center_x().desc(), g.center_y(), "box_id")
    return D.boxes(spark, d).where(g.vertical()).select("image_id", "box_id", F.row_number().over(w).cast("long").alias("pos"))


def _with_children(spark, d):
    p = Q._parents(spark, d)
    out = B.with_children(p, B.assign_children(D.boxes(spark, d), p))
    return out.select("image_id", "parent_id", "n", F.array_join(F.transform("kids", lambda k: k.cast("string")), ",").alias("kids"))


def _parent_score_text(spark, d):
    e = recognise.ctc(D.table(spark, d, "embeddings"), F.col("embedding"), 8, CHARSET)
    p = B.parent_text(e.select(F.expr("vec_id div 4").alias("parent_id"), "vec_id", "text", "score"), ["parent_id"], ["vec_id"])
    return p.select("parent_id", "text", F.round("score", 6).alias("score"), "n")


def _ctc_argmax(spark, d):
    return recognise.steps(D.table(spark, d, "embeddings").select("vec_id", "embedding"), F.col("embedding"), 8).select("vec_id", "t", "c", F.round("p", 6).alias("p"))


def _text_colour(spark, d):
    return C.text_colour(D.pixels(spark, d))


def _char_spans(spark, d):
    runs = Q._runs(spark, d)
    s = runs.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("segments"))
    spans = s.select("image_id", F.posexplode(C.char_spans(F.col("segments"), 12, 25)).alias("k", "s"))
    return spans.select("image_id", F.col("k").cast("long").alias("k"), "s.*")


def _spans_out(df):
    return df.select("image_id", F.posexplode("spans").alias("k", "s")).select("image_id", F.col("k").cast("long").alias("k"), "s.*")


def _cells(spark, d):
    return G.labelled(D.grids(spark, d), F.col("cells"), 8, 0.5)


def _grid_threshold(spark, d):
    c = D.grids(spark, d).select("vec_id", F.posexplode("cells").alias("k", "p")).where("p > 0.5")
    return c.select("vec_id", F.expr("cast(k div 8 as bigint)").alias("y"), F.expr("cast(k % 8 as bigint)").alias("x"))


def _grid_components(spark, d):
    return _cells(spark, d).groupBy("vec_id", "component").agg(F.count("*").alias("n")).where("n >= 3")


def _outlines(spark, d):
    return G.outlines(_cells(spark, d), ["vec_id", "component"]).where("n >= 3")


def _hull_edges(spark, d):
    return G.hull_edges(_outlines(spark, d), ["vec_id", "component"])


def _min_area_rect(spark, d):
    return _outlines(spark, d).select("vec_id", "component", "n", F.round("area", 6).alias("area"))


def _box_score(spark, d):
    c = _cells(spark, d)
    box = c.groupBy("vec_id", "component").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("n")).where("n >= 3")
    every = D.grids(spark, d).select("vec_id", F.posexplode("cells").alias("k", "p")).select("vec_id", "p", F.expr("k div 8").alias("y"), F.expr("k % 8").alias("x"))
    # Borders at the least coordinates are inside, those at the largest are not.
    j = box.join(every, "vec_id", "left").withColumn("v", F.when((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")), F.col("p")))
    return j.groupBy("vec_id", "component").agg(F.round(F.coalesce(F.avg("v"), F.lit(0.0)), 6).alias("score"))


def _unclip(spark, d):
    w, h = g.width().cast("double"), g.height().cast("double")
    far = w * h * G.UNCLIP / (2 * (w + h))
    return D.boxes(spark, d).select("image_id", "box_id", *[F.round(v, 6).alias(n) for n, v in (("x0", F.col("x0") - far), ("y0", F.col("y0") - far), ("x1", F.col("x1") + far), ("y1", F.col("y1") + far))])


def _in_polygon(spark, d):
    p = D.pixels(spark, d)
    return p.select("image_id", "s", g.in_polygon(F.col("x"), F.col("y"), QUAD).alias("within"))


def _rotate(spark, d):
    c = D.grids(spark, d).select("vec_id", F.posexplode("cells").alias("k", "p"))
    return c.select("vec_id", F.expr("cast(k div 8 as bigint)").alias("x"), F.expr("cast(7 - k % 8 as bigint)").alias("y"), F.round("p", 6).alias("p"))


def _nchw(spark, d):
    p = D.pixels(spark, d)
    v = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("channel"), ((F.col(c) / F.lit(255.0) - m) / s).alias("v")) for k, (c, m, s) in enumerate(zip("rgb", R.MEAN, R.STD))])).alias("e")
    return p.select("image_id", "s", v).select("image_id", "s", "e.channel", F.round("e.v", 6).alias("v"))


def _crop_size(spark, d):
    size = g.crop_size(F.col("quad"))
    return _quads(spark, d).select("image_id", "box_id", *[v.alias(k) for k, v in size.items()])


def _translate(spark, d):
    """Boxes found in the padded crop of a parent, back in the image and clamped to the parent."""
    p = Q._parents(spark, d)
    j = D.boxes(spark, d).join(B.prefixed(p, "p_").hint("merge"), F.col("image_id") == F.col("p_image_id"))
    back = lambda v, a: g.clamp(F.col(v) - 10 + F.col(f"p_{a}0"), F.col(f"p_{a}0"), F.col(f"p_{a}1")).cast("long").alias(v)
    return j.select("image_id", "box_id", F.col("p_parent_id").alias("parent_id"), back("x0", "x"), back("y0", "y"), back("x1", "x"), back("y1", "y"))


def _json(spark, d):
    from . import workflow

    return workflow.responses(_lines(spark, d))


WARPED = ((1, 1), (6, 0), (7, 7), (0, 6))


def _pictures(spark, d):
    """The maps of D4 as grey pictures of 8 x 8."""
    grey = F.transform("cells", lambda c: F.least(F.greatest(c * 255, F.lit(0.0)), F.lit(255.0)).cast("long"))
    return D.grids(spark, d).select("vec_id", grey.alias("cells"))


def _sampled(pictures, width: int, height: int, at):
    """Pictures of width x height, row by row, each place sampled ``at`` (x, y) of its source: size, sum, and a sum that knows places."""
    places = F.sequence(F.lit(0), F.lit(width * height - 1))
    out = pictures.withColumn("out", F.transform(places, lambda k: at(k % width, F.floor(k / width))))
    total = lambda f: F.aggregate(F.transform("out", f), F.lit(0).cast("long"), lambda a, v: a + v)
    return out.select("vec_id", F.lit(height).cast("long").alias("height"), F.lit(width).cast("long").alias("width"), total(lambda v, k: v).alias("total"), total(lambda v, k: v * (k + 1)).alias("placed"))


def _resized(spark, d):
    """Maps as grey pictures resized to 12 x 5."""
    return _sampled(_pictures(spark, d), 12, 5, lambda x, y: g.bilinear(F.col("cells"), 8, 8, x * F.lit(8.0) / 12, y * F.lit(8.0) / 5))


def _warped(spark, d):
    """The quad WARPED of every picture laid straight on 10 x 6, white where it leaves the picture."""
    m = g.from_square([(F.lit(float(x)), F.lit(float(y))) for x, y in WARPED])

    def at(x, y):
        u, v = x / F.lit(9.0), y / F.lit(5.0)
        w = m["g"] * u + m["h"] * v + 1
        sx, sy = F.round((m["a"] * u + m["b"] * v + m["c"]) / w, 9), F.round((m["d"] * u + m["e"] * v + m["f"]) / w, 9)
        within = (sx >= 0) & (sy >= 0) & (sx <= 7) & (sy <= 7)
        return F.when(within, g.bilinear(F.col("cells"), 8, 8, sx, sy)).otherwise(F.lit(255).cast("long"))

    return _sampled(_pictures(spark, d), 10, 6, at)


def _homography(spark, d):
    """Where the centre of each skewed quad lies when it is laid straight on 100 x 50."""
    q = _quads(spark, d).select("image_id", "box_id", *_points(g.ordered_corners(F.col("quad"))))
    p = [(F.col(f"x{k}").cast("double"), F.col(f"y{k}").cast("double")) for k in range(4)]
    mean = [sum((c[k] for c in p[1:]), p[0][k]) / 4 for k in (0, 1)]
    u, v = g.to_square(g.from_square(p), *mean)
    return q.select("image_id", "box_id", F.round(u * 100, 4).alias("x"), F.round(v * 50, 4).alias("y"))


def _session_state(spark, d):
    return sessions.replay(D.session_log(spark, d)).select("session_id", "event_id", "op", "found", "value")


def _layout_quads(spark, d):
    """Layout rows given as real numbers, cut to integers, clamped to the page, as quads."""
    r = D.layout_rows(spark, d).where("score >= 0.3")
    c = lambda v, hi: g.clamp((F.col(v) + F.lit(0.75)).cast("long"), F.lit(0), F.lit(hi)).cast("long")
    r = r.select("image_id", "k", c("xmin", 199).alias("x0"), c("ymin", 149).alias("y0"), c("xmax", 199).alias("x1"), c("ymax", 149).alias("y1"))
    return r.select("image_id", "k", *_points(g.corners()))


QUERIES = {
    "clamp_scale_boxes": _clamp_scale,
    "order_corners": _order_corners,
    "quad_half_turn": _half_turn,
    "iou_intersection_pairs": _iou,
    "gap_pairs": _gaps,
    "proximity_clusters": lambda s, d: _lines(s, d).select("image_id", "cluster", "x0", "y0", "x1", "y1", "n", "score", "line"),
    "reading_order_text": _reading,
    "cjk_reading_order": _cjk,
    "parents_with_children": _with_children,
    "hierarchical_merge": lambda s, d: B.hierarchical(D.boxes(s, d), Q._parents(s, d)),
    "text_size_mean": lambda s, d: _lines(s, d).select("image_id", "cluster", F.round("size", 6).alias("size")),
    "ctc_argmax": _ctc_argmax,
    "parent_score_text": _parent_score_text,
    "text_color": _text_colour,
    "word_char_spans": _char_spans,
    "suppress_outliers": lambda s, d: _spans_out(C.suppress_outliers(D.word_spans(s, d), "spans")),
    "merge_similar_spans": lambda s, d: _spans_out(D.word_spans(s, d).withColumn("spans", C.merge_similar(F.col("spans")))),
    "grid_threshold": _grid_threshold,
    "grid_components": _grid_components,
    "convex_hull_edges": _hull_edges,
    "min_area_rect": _min_area_rect,
    "unclip_rect": _unclip,
    "box_score": _box_score,
    "point_in_polygon": _in_polygon,
    "rotate90ccw": _rotate,
    "nchw_normalise": _nchw,
    "crop_target_size": _crop_size,
    "translate_boxes": _translate,
    "layout_quads": _layout_quads,
    "ocr_json": _json,
    "session_state": _session_state,
    "bilinear_resize": _resized,
    "perspective_warp": _warped,
    "homography": _homography,
}

_LINES = Q.SQL["merge_lines"].split("SELECT *, row_number()")[0]
_LINED = f"{_LINES}, l AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY (y0 + y1) // 2, (x0 + x1) // 2, cluster) AS line FROM m)"
_QUAD_SQL = """q AS (SELECT image_id, box_id, list_concat(p[k + 1:], p[:k]) AS p FROM (SELECT image_id, box_id, (image_id + box_id) % 4 AS k,
 [{'x': x0 + 2, 'y': y0}, {'x': x1, 'y': y0 + 3}, {'x': x1 - 1, 'y': y1}, {'x': x0, 'y': y1 - 2}] AS p FROM boxes)),
s AS (SELECT *, [a.x + a.y for a in p] AS u, [a.x - a.y for a in p] AS v FROM q),
o AS (SELECT image_id, box_id, p[list_position(u, list_min(u))] AS a, p[list_position(v, list_max(v))] AS b, p[list_position(u, list_max(u))] AS c, p[list_position(v, list_min(v))] AS d FROM s)"""
_GRID = "g AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, i, embedding[i + 1]::DOUBLE + 0.5 AS p FROM embeddings, (SELECT unnest(range(64)) AS i)), c AS (SELECT * FROM g WHERE p > 0.5)"
_COMPONENTS = f"""{_GRID}, e AS (SELECT a.vec_id, a.i, b.i AS j FROM c a JOIN c b ON a.vec_id = b.vec_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
reach AS (SELECT vec_id, i, i AS j FROM c UNION SELECT r.vec_id, r.i, e.j FROM reach r JOIN e ON r.vec_id = e.vec_id AND r.j = e.i),
lab AS (SELECT vec_id, i, min(j) AS component FROM reach GROUP BY ALL),
cell AS (SELECT c.vec_id, c.x, c.y, c.p, lab.component FROM c JOIN lab ON c.vec_id = lab.vec_id AND c.i = lab.i),
n AS (SELECT vec_id, component, count(*) AS n FROM cell GROUP BY ALL HAVING count(*) >= 3)"""
_HULL = """k AS (SELECT cell.* FROM cell JOIN n ON cell.vec_id = n.vec_id AND cell.component = n.component),
edge AS (SELECT p.vec_id, p.component, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy FROM k p JOIN k q ON p.vec_id = q.vec_id AND p.component = q.component AND (p.x <> q.x OR p.y <> q.y)
 WHERE NOT EXISTS (SELECT 1 FROM k r WHERE r.vec_id = p.vec_id AND r.component = p.component AND ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) < 0
 OR ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) = 0 AND (r.x - p.x) * (q.x - p.x) + (r.y - p.y) * (q.y - p.y) NOT BETWEEN 0 AND (q.x - p.x) ** 2 + (q.y - p.y) ** 2))))"""


def _crosses(x: str, y: str) -> str:
    out = []
    for (xi, yi), (xj, yj) in zip(QUAD, [QUAD[-1], *QUAD[:-1]]):
        if yi != yj:
            out.append(f"(CASE WHEN ({yi} > {y}) <> ({yj} > {y}) AND {x} < ({xj - xi}) * ({y} - {yi}) / ({yj - yi}.0)::DOUBLE + {xi} THEN 1 ELSE 0 END)")
    return f"({' + '.join(out)}) % 2 = 1"


_SIZED = "z AS (SELECT *, least(1.0::DOUBLE, 1280.0::DOUBLE / greatest(width, height)) AS f FROM (SELECT *, " + IMAGE + " FROM boxes)), r AS (SELECT *, greatest(1, floor(width * f + 0.5)::BIGINT) AS w, greatest(1, floor(height * f + 0.5)::BIGINT) AS h FROM z)"
_SCALED = ", ".join(f"least({full} - 1, greatest(0, floor({v} * (width_{full}) * 20 + 0.5)::BIGINT)) AS {v}".replace(f"(width_{full})", f"({full}::DOUBLE / {now})") for v, full, now in (("x0", "width", "w"), ("y0", "height", "h"), ("x1", "width", "w"), ("y1", "height", "h")))
_CORNERS = "x0, y0, x1, y0 AS y1, x1 AS x2, y1 AS y2, x0 AS x3, y1 AS y3"

SQL = {
    "clamp_scale_boxes": f"WITH {Q.D1}, {_SIZED} SELECT image_id, box_id, w, h, (w + 31) // 32 * 32 AS pad_w, (h + 31) // 32 * 32 AS pad_h, {_SCALED} FROM r",
    "order_corners": f"WITH {Q.D1}, {_QUAD_SQL} SELECT image_id, box_id, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, c.x AS x2, c.y AS y2, d.x AS x3, d.y AS y3 FROM o",
    "quad_half_turn": f"""WITH {Q.D1}, f AS (SELECT *, coalesce(l1 > l0 AND l1 > 0.9::DOUBLE, false) AS flip FROM (SELECT *, CASE WHEN box_id % 5 <> 0 THEN (box_id * 37 % 100) / 100.0::DOUBLE END AS l0, CASE WHEN box_id % 5 <> 0 THEN (image_id * 13 % 100) / 100.0::DOUBLE END AS l1 FROM boxes))
SELECT image_id, box_id, flip, CASE WHEN flip THEN x1 ELSE x0 END AS x0, CASE WHEN flip THEN y1 ELSE y0 END AS y0, CASE WHEN flip THEN x0 ELSE x1 END AS x1, CASE WHEN flip THEN y1 ELSE y0 END AS y1,
 CASE WHEN flip THEN x0 ELSE x1 END AS x2, CASE WHEN flip THEN y0 ELSE y1 END AS y2, CASE WHEN flip THEN x1 ELSE x0 END AS x3, CASE WHEN flip THEN y0 ELSE y1 END AS y3 FROM f""",
    "iou_intersection_pairs": f"""WITH {Q.D1}, {Q.D2}, {Q.PARENTS}, i AS (SELECT c.image_id, c.box_id, p.parent_id, greatest(0, least(c.x1, p.x1) - greatest(c.x0, p.x0)) * greatest(0, least(c.y1, p.y1) - greatest(c.y0, p.y0)) AS overlap,
 (c.x1 - c.x0) * (c.y1 - c.y0) + (p.x1 - p.x0) * (p.y1 - p.y0) AS both_areas FROM boxes c JOIN parents p ON c.image_id = p.image_id)
SELECT image_id, box_id, parent_id, overlap, round(overlap::DOUBLE / (both_areas - overlap), 6) AS iou FROM i WHERE overlap > 0""",
    "gap_pairs": f"""WITH {Q.D1}, p AS (SELECT a.image_id, a.box_id AS a, b.box_id AS b, greatest(0, greatest(a.x0, b.x0) - least(a.x1, b.x1)) ** 2 + greatest(0, greatest(a.y0, b.y0) - least(a.y1, b.y1)) ** 2 AS g
 FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.box_id < b.box_id) SELECT image_id, a, b, round(sqrt(g::DOUBLE), 6) AS gap FROM p WHERE g <= 1600""",
    "proximity_clusters": f"{_LINED} SELECT image_id, cluster, x0, y0, x1, y1, n, score, line FROM l",
    "reading_order_text": f"{_LINED} SELECT image_id, count(*) AS n, string_agg(text, chr(10) ORDER BY line) AS text FROM l GROUP BY image_id",
    "cjk_reading_order": f"WITH {Q.D1} SELECT image_id, box_id, row_number() OVER (PARTITION BY image_id ORDER BY (x0 + x1) // 2 DESC, (y0 + y1) // 2, box_id) AS pos FROM boxes WHERE y1 - y0 > x1 - x0",
    "parents_with_children": f"WITH {Q.D1}, {Q.D2}, {Q.PARENTS}, {Q.ASSIGN} SELECT image_id, parent_id, count(*) AS n, string_agg(box_id::VARCHAR, ',' ORDER BY box_id) AS kids FROM assigned GROUP BY image_id, parent_id",
    "hierarchical_merge": f"""WITH {Q.D1}, {Q.D2}, {Q.PARENTS}, {Q.ASSIGN}, kids AS (SELECT image_id, parent_id, count(*) AS n FROM assigned GROUP BY ALL),
u AS (SELECT p.image_id, 0 AS tail, p.parent_id, NULL::BIGINT AS box_id, p.x0, p.y0, p.x1, p.y1, kids.n FROM parents p JOIN kids ON p.image_id = kids.image_id AND p.parent_id = kids.parent_id
 UNION ALL SELECT image_id, 1, NULL, box_id, x0, y0, x1, y1, 0 FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM assigned a WHERE a.image_id = b.image_id AND a.box_id = b.box_id))
SELECT image_id, parent_id, box_id, x0, y0, x1, y1, n, row_number() OVER (PARTITION BY image_id ORDER BY tail, parent_id, box_id) AS seq FROM u""",
    "text_size_mean": f"WITH RECURSIVE {Q.D1}, {Q.EDGES}, {Q.CLUSTERS} SELECT image_id, cluster, round(avg(size), 6) AS size FROM clustered GROUP BY ALL",
    "ctc_argmax": "WITH l AS (SELECT vec_id, i // 8 AS t, i % 8 AS c, embedding[i + 1]::DOUBLE AS p FROM embeddings, (SELECT unnest(range(64)) AS i)) SELECT vec_id, t, first(c ORDER BY p DESC, c) AS c, round(max(p), 6) AS p FROM l GROUP BY vec_id, t",
    "parent_score_text": """WITH l AS (SELECT vec_id, i // 8 AS t, i % 8 AS c, embedding[i + 1]::DOUBLE AS p FROM embeddings, (SELECT unnest(range(64)) AS i)),
a AS (SELECT vec_id, t, first(c ORDER BY p DESC, c) AS c, max(p) AS p FROM l GROUP BY vec_id, t),
e AS (SELECT * FROM (SELECT *, lag(c) OVER (PARTITION BY vec_id ORDER BY t) AS q FROM a) WHERE c <> 0 AND (q IS NULL OR q <> c)),
g AS (SELECT vec_id, string_agg((['', 'a', 'b', 'c', 'd', 'e', 'f', ' '])[c + 1], '' ORDER BY t) AS text, exp(sum(CASE WHEN p > 0 THEN ln(p) ELSE 0 END) / count(*)) AS score FROM e GROUP BY vec_id)
SELECT vec_id // 4 AS parent_id, string_agg(text, ' ' ORDER BY vec_id) AS text, round(avg(score), 6) AS score, count(*) AS n FROM g WHERE text <> '' GROUP BY vec_id // 4""",
    "text_color": f"""WITH {Q.D5}, otsu AS ({Q.SQL["otsu_threshold"].replace("WITH " + Q.D5 + ", h AS", "WITH h AS")}),
m AS (SELECT p.*, CASE WHEN NOT inside THEN 0 WHEN gray <= threshold THEN 1 ELSE 2 END AS part FROM pixels p JOIN otsu ON p.image_id = otsu.image_id),
s AS (SELECT image_id, {", ".join(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c} DESC) FILTER (WHERE {w})::BIGINT AS {c}{k}" for k, w in (("o", "part = 0"), ("d", "part = 1"), ("l", "part = 2"), ("a", "part > 0")) for c in "rgb")},
 count(*) FILTER (WHERE part = 0) AS n_o, count(*) FILTER (WHERE part = 1) AS n_d, count(*) FILTER (WHERE part = 2) AS n_l,
 {" + ".join(f"var_pop({c}) FILTER (WHERE part = 1)" for c in "rgb")} AS vd, {" + ".join(f"var_pop({c}) FILTER (WHERE part = 2)" for c in "rgb")} AS vl FROM m GROUP BY image_id),
t AS (SELECT *, CASE WHEN n_d = 0 OR n_l = 0 THEN NULL WHEN n_o >= 20 THEN (rd - ro) ** 2 + (gd - go) ** 2 + (bd - bo) ** 2 >= (rl - ro) ** 2 + (gl - go) ** 2 + (bl - bo) ** 2 ELSE round(vl, 6) <= round(vd, 6) END AS dark FROM s WHERE n_d + n_l >= 4)
SELECT image_id, {", ".join(f"CASE WHEN dark IS NULL THEN {c}a WHEN dark THEN {c}d ELSE {c}l END AS {c}" for c in "rgb")}, dark FROM t""",
    "grid_threshold": f"WITH {_GRID} SELECT vec_id, y, x FROM c",
    "grid_components": f"WITH RECURSIVE {_COMPONENTS} SELECT vec_id, component, n FROM n",
    "convex_hull_edges": f"WITH RECURSIVE {_COMPONENTS}, {_HULL} SELECT vec_id, component, px::DOUBLE AS px, py::DOUBLE AS py, qx::DOUBLE AS qx, qy::DOUBLE AS qy FROM edge",
    "min_area_rect": f"""WITH RECURSIVE {_COMPONENTS}, {_HULL}, pr AS (SELECT e.vec_id, e.component, e.px, e.py, e.qx, e.qy, ((e.qx - e.px) * k.x + (e.qy - e.py) * k.y)::DOUBLE AS u, ((e.qx - e.px) * k.y - (e.qy - e.py) * k.x)::DOUBLE AS v, ((e.qx - e.px) ** 2 + (e.qy - e.py) ** 2)::DOUBLE AS z
 FROM edge e JOIN k ON e.vec_id = k.vec_id AND e.component = k.component),
ar AS (SELECT vec_id, component, (max(u) - min(u)) * (max(v) - min(v)) / any_value(z) AS area FROM pr GROUP BY vec_id, component, px, py, qx, qy)
SELECT ar.vec_id, ar.component, any_value(n.n) AS n, round(min(area), 6) AS area FROM ar JOIN n ON ar.vec_id = n.vec_id AND ar.component = n.component GROUP BY ar.vec_id, ar.component""",
    "unclip_rect": f"WITH {Q.D1}, f AS (SELECT *, (x1 - x0)::DOUBLE * (y1 - y0) * 2.0::DOUBLE / (2 * ((x1 - x0) + (y1 - y0))::DOUBLE) AS far FROM boxes) SELECT image_id, box_id, round(x0 - far, 6) AS x0, round(y0 - far, 6) AS y0, round(x1 + far, 6) AS x1, round(y1 + far, 6) AS y1 FROM f",
    "box_score": f"""WITH RECURSIVE {_COMPONENTS}, b AS (SELECT vec_id, component, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM cell GROUP BY ALL HAVING count(*) >= 3)
SELECT b.vec_id, b.component, round(coalesce(avg(g.p), 0), 6) AS score FROM b LEFT JOIN g ON b.vec_id = g.vec_id AND g.x >= b.x0 AND g.x < b.x1 AND g.y >= b.y0 AND g.y < b.y1 GROUP BY b.vec_id, b.component""",
    "point_in_polygon": f"WITH {Q.D5} SELECT image_id, s, {_crosses('x', 'y')} AS within FROM pixels",
    "rotate90ccw": f"WITH {_GRID} SELECT vec_id, y AS x, 7 - x AS y, round(p, 6) AS p FROM g",
    "nchw_normalise": f"WITH {Q.D5} " + " UNION ALL ".join(f"SELECT image_id, s, {k}::BIGINT AS channel, round(({c} / 255.0::DOUBLE - {m}::DOUBLE) / {s}::DOUBLE, 6) AS v FROM pixels" for k, (c, m, s) in enumerate(zip("rgb", R.MEAN, R.STD))),
    "crop_target_size": f"""WITH {Q.D1}, {_QUAD_SQL}, z AS (SELECT image_id, box_id, greatest(sqrt(((a.x - b.x) ** 2 + (a.y - b.y) ** 2)::DOUBLE), sqrt(((d.x - c.x) ** 2 + (d.y - c.y) ** 2)::DOUBLE)) AS w,
 greatest(1.0::DOUBLE, sqrt(((a.x - d.x) ** 2 + (a.y - d.y) ** 2)::DOUBLE), sqrt(((b.x - c.x) ** 2 + (b.y - c.y) ** 2)::DOUBLE)) AS h FROM o)
SELECT image_id, box_id, h > w AS upright, greatest(1, floor((CASE WHEN h > w THEN 48 * h / greatest(w, 1e-9) ELSE 48 * w / h END) + 0.5)::BIGINT) AS length, greatest(1, trunc(w)::BIGINT) AS w, trunc(h)::BIGINT AS h FROM z""",
    "translate_boxes": f"""WITH {Q.D1}, {Q.D2}, {Q.PARENTS} SELECT c.image_id, c.box_id, p.parent_id, {", ".join(f"least(p.{a}1, greatest(p.{a}0, c.{a}{k} - 10 + p.{a}0)) AS {a}{k}" for k in (0, 1) for a in "xy")} FROM boxes c JOIN parents p ON c.image_id = p.image_id""",
    "layout_quads": f"WITH {Q.D2}, z AS (SELECT image_id, k, least(199, greatest(0, trunc(xmin + 0.75)::BIGINT)) AS x0, least(149, greatest(0, trunc(ymin + 0.75)::BIGINT)) AS y0, least(199, greatest(0, trunc(xmax + 0.75)::BIGINT)) AS x1, least(149, greatest(0, trunc(ymax + 0.75)::BIGINT)) AS y1 FROM layout WHERE score >= 0.3) SELECT image_id, k, x0, y0, x1, y0 AS \"y1\", x1 AS x2, y1 AS y2, x0 AS x3, y1 AS y3 FROM (SELECT image_id, k, x0, y0, x1, y1 FROM z)",
    "session_state": """WITH s AS (SELECT user_id AS session_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'get' END AS op FROM events),
c AS (SELECT *, last_value(CASE WHEN op <> 'get' THEN op || ':' || event_id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM s)
SELECT session_id, event_id, op, op <> 'get' OR coalesce(l LIKE 'create:%', false) AS found, CASE WHEN l LIKE 'create:%' THEN substr(l, 8) END AS value FROM c""",
}
