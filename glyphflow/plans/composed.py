"""Queries that put several operators together: word colours, session requests, nested text; with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import colour as C
from ..operators import grid as G
from ..operators import recognise, trees
from ..operators import requests as R
from ..sources import derived as D
from . import catalogue as Q
from . import pages as P


def _box_colours(spark, d):
    return C.text_colours(D.pixels(spark, d), D.colour_boxes(spark, d))


def _word_colours(spark, d):
    w = C.word_colours(D.pixels(spark, d), D.colour_boxes(spark, d))
    return w.select("image_id", "box_id", F.posexplode("spans").alias("k", "s")).select("image_id", "box_id", F.col("k").cast("long").alias("k"), "s.*")


def _session_ocr(spark, d):
    """Requests of D11 on sessions of D9, whose payloads name images of D1: the boxes of the image stand for what is read, those of
    even and odd number in the first and second region."""
    r = R.session_requests(D.session_requests(spark, d), D.session_log(spark, d))
    regions = R.asked_regions(r.where("alive").select("request_id", F.col("value").cast("long").alias("image_id"), "quads"))
    read = D.boxes(spark, d).select("image_id", F.col("box_id").alias("line"), "text", "score", g.corners().alias("found"))
    lines = regions.join(read, "image_id").where(F.col("seq").isNull() | (F.col("line") % 2 == F.col("seq")))
    out = R.answered(r, lines.select("request_id", "seq", "line", "text", "score", R.placed(F.col("found"), F.col("quad")).alias("box")))
    flat = lambda k: F.array_join(F.flatten(F.transform(k["box"], lambda p: F.array(p["x"].cast("string"), p["y"].cast("string")))), ",")
    return out.select("request_id", "status", "detail", F.size("results").cast("long").alias("n"), "full_text", F.array_join(F.transform("results", flat), ";").alias("boxes"))


def _nested(spark, d):
    return trees.nested(D.box_tree(spark, d)).withColumnRenamed("tree_id", "image_id")


def _ctc_dict(spark, d):
    out = recognise.ctc_by_table(D.table(spark, d, "embeddings"), ["vec_id"], F.col("embedding"), 8, D.small_dictionary(spark, d))
    return out.select("vec_id", "text", F.round("score", 6).alias("score"))


def _unclip(spark, d):
    """Hulls of the components of D4 with their edges moved outward: each corner and where it goes."""
    o = P._outlines(spark, d).where("size(hull) > 2").withColumn("to", g.unclipped(F.col("hull"), G.UNCLIP))
    both = o.select("vec_id", "component", F.explode(F.arrays_zip("hull", "to")).alias("e"))
    return both.select("vec_id", "component", F.col("e.hull.x").alias("px"), F.col("e.hull.y").alias("py"), *[(F.round(f"e.to.{c}", 6) + F.lit(0.0)).alias(c) for c in "xy"])  # no minus zero


def _polygon_score(spark, d):
    """Mean of the cells of a map inside the hull of each component, of those with at least G.BOX_SCORE."""
    o = P._outlines(spark, d).where("size(hull) > 2").select("vec_id", "component", "hull")
    every = D.grids(spark, d).select("vec_id", F.posexplode("cells").alias("k", "p")).select("vec_id", "p", F.expr("cast(k div 8 as double)").alias("y"), F.expr("cast(k % 8 as double)").alias("x"))
    met = o.join(every, "vec_id").where(g.in_polygon_of(F.col("x"), F.col("y"), F.col("hull")))
    score = met.groupBy("vec_id", "component").agg(F.count("*").alias("cells"), F.round(F.avg("p"), 6).alias("score"))
    return score.where(F.col("score") >= G.BOX_SCORE)


QUERIES = {
    "box_text_color": _box_colours,
    "word_colors": _word_colours,
    "session_ocr": _session_ocr,
    "request_status": lambda s, d: R.routed(D.routed_requests(s, d), D.session_log(s, d)),
    "nested_text": lambda s, d: _nested(s, d).select("image_id", "text", "leaves"),
    "nested_size": lambda s, d: _nested(s, d).select("image_id", F.round("size", 6).alias("size")),
    "ctc_decode_dict": _ctc_dict,
    "unclip_polygon": _unclip,
    "polygon_score": _polygon_score,
}


def _crossings(corners: int = 4) -> str:
    """How often the ray from (px, py) crosses the edges of the polygon qx, qy (lists)."""
    edges = []
    for k in range(corners):
        xi, yi, xj, yj = (f"(q{c}[{i + 1}] - {c}0)::DOUBLE" for i in (k, (k - 1) % corners) for c in "xy")
        edges.append(f"(CASE WHEN ({yi} > py) <> ({yj} > py) AND px < ({xj} - {xi}) * (py - {yi}) / nullif({yj} - {yi}, 0) + {xi} THEN 1 ELSE 0 END)")
    return " + ".join(edges)


_KINDS = ", ".join(f"({b}, {[x for x, _ in q]}::BIGINT[], {[y for _, y in q]}::BIGINT[], '{t}')" for b, q, t in D.COLOUR_BOXES)
_MEDIAN = "percentile_disc(0.5) WITHIN GROUP (ORDER BY {c} DESC)"
_PARTS = {"o": "part = 0 OR (part = 3 AND few)", "d": "part = 1", "l": "part = 2", "a": "part IN (1, 2)"}
_JUDGED = f"""{Q.D5},
cb AS (SELECT image_id, box_id, qx, qy, length(text) AS chars, list_max(qy) - list_min(qy) > 2 * (list_max(qx) - list_min(qx)) AS tall,
 least(15, greatest(0, list_min(qx))) AS x0, least(height - 1, greatest(0, list_min(qy))) AS y0, least(16, greatest(1, list_max(qx))) AS x1, least(height, greatest(1, list_max(qy))) AS y1
 FROM (SELECT image_id, max(y) + 1 AS height FROM pixels GROUP BY image_id), (VALUES {_KINDS}) v(box_id, qx, qy, text)),
near AS (SELECT cb.*, x1 - x0 AS w, y1 - y0 AS h, p.x - x0 AS px, p.y - y0 AS py, r, g, b, gray FROM cb JOIN pixels p ON p.image_id = cb.image_id AND p.x BETWEEN x0 - {C.RING} AND x1 + {C.RING - 1} AND p.y BETWEEN y0 - {C.RING} AND y1 + {C.RING - 1} WHERE x1 > x0 AND y1 > y0),
placed AS (SELECT *, CASE WHEN px < 0 OR px >= w OR py < 0 OR py >= h THEN 3 WHEN ({_crossings()}) % 2 = 0 THEN 0 ELSE 1 END AS place FROM near),
levels AS (SELECT image_id, box_id, gray, count(*) AS n FROM placed WHERE place = 1 GROUP BY ALL),
upto AS (SELECT image_id, box_id, gray, sum(n) OVER u AS wb, sum(n * gray) OVER u AS sb, sum(n) OVER e AS w, sum(n * gray) OVER e AS s FROM levels WINDOW u AS (PARTITION BY image_id, box_id ORDER BY gray), e AS (PARTITION BY image_id, box_id)),
otsu AS (SELECT image_id, box_id, coalesce(first(gray ORDER BY v DESC, gray) FILTER (v IS NOT NULL), 0) AS threshold FROM (
 SELECT *, CASE WHEN w > wb THEN wb::DOUBLE * (w - wb)::DOUBLE * pow(sb::DOUBLE / wb::DOUBLE - (s - sb)::DOUBLE / (w - wb)::DOUBLE, 2.0) END AS v FROM upto) GROUP BY ALL),
parted AS (SELECT p.*, CASE WHEN place <> 1 THEN place WHEN gray <= threshold THEN 1 ELSE 2 END AS part, count(*) FILTER (place = 0) OVER (PARTITION BY p.image_id, p.box_id) < {C.LEAST_OUTSIDE} AS few
 FROM placed p JOIN otsu ON p.image_id = otsu.image_id AND p.box_id = otsu.box_id),
stats AS (SELECT image_id, box_id, {", ".join(f"{_MEDIAN.format(c=c)} FILTER (WHERE {cond})::BIGINT AS {c}{k}" for k, cond in _PARTS.items() for c in "rgb")},
 {", ".join(f"count(*) FILTER (WHERE {cond}) AS n{k}" for k, cond in _PARTS.items())},
 {", ".join(" + ".join(f"var_pop({c}) FILTER (WHERE {_PARTS[k]})" for c in "rgb") + f" AS v{k}" for k in "dl")} FROM parted GROUP BY ALL),
told AS (SELECT *, CASE WHEN nd = 0 OR nl = 0 THEN NULL WHEN "no" >= {C.LEAST_OUTSIDE} THEN (rd - ro) ** 2 + (gd - go) ** 2 + (bd - bo) ** 2 >= (rl - ro) ** 2 + (gl - go) ** 2 + (bl - bo) ** 2 ELSE round(vl, 6) <= round(vd, 6) END AS dark FROM stats WHERE na >= {C.LEAST_INSIDE})"""
_BOX = "image_id, box_id"
_ON = "{a}.image_id = {b}.image_id AND {a}.box_id = {b}.box_id"
_APART = "({a}r - {b}r) ** 2 + ({a}g - {b}g) ** 2 + ({a}b - {b}b) ** 2"
# Character spans of ``segs``; of ``spans``, outlying colours given to a neighbour; of ``steady``, like neighbours joined.
_LAID = f"""scaled AS (SELECT *, least(chars, greatest(0, floor(chars::DOUBLE * a / axis + 0.5)::BIGINT)) AS sa, least(chars, greatest(0, floor(chars::DOUBLE * z / axis + 0.5)::BIGINT)) AS sz FROM segs),
laid AS (SELECT image_id, box_id, 0::BIGINT AS k, 0::BIGINT AS last, 0::BIGINT AS s, 0::BIGINT AS e, false AS kept FROM (SELECT DISTINCT image_id, box_id FROM scaled)
 UNION ALL SELECT c.image_id, c.box_id, c.k, CASE WHEN greatest(sa, last) < chars THEN least(chars, greatest(sz, greatest(sa, last) + 1)) ELSE last END, greatest(sa, last), least(chars, greatest(sz, greatest(sa, last) + 1)), greatest(sa, last) < chars
 FROM laid l JOIN scaled c ON {_ON.format(a="c", b="l")} AND c.k = l.k + 1),
spans AS (SELECT * FROM (SELECT l.image_id, l.box_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY l.image_id, l.box_id) AS n, l.s, l.e, c.r, c.g, c.b FROM laid l JOIN scaled c ON {_ON.format(a="c", b="l")} AND c.k = l.k WHERE kept WINDOW w AS (PARTITION BY l.image_id, l.box_id ORDER BY l.k)) WHERE n > 1)"""
_CALM = f"""mid AS (SELECT image_id, box_id, {", ".join(f"list_sort(list({c}))[count(*) // 2 + 1] AS m{c}" for c in "rgb")} FROM spans GROUP BY ALL),
dist AS (SELECT s.*, (r - mr) ** 2 + (g - mg) ** 2 + (b - mb) ** 2 AS d FROM spans s JOIN mid ON {_ON.format(a="s", b="mid")}),
flagged AS (SELECT d.*, n >= 3 AND d > greatest(6000, 3 * md) AS odd, lead(r) OVER o AS nr, lead(g) OVER o AS ng, lead(b) OVER o AS nb FROM dist d JOIN (SELECT image_id, box_id, list_sort(list(d))[count(*) // 2 + 1] AS md FROM dist GROUP BY ALL) m ON {_ON.format(a="d", b="m")} WINDOW o AS (PARTITION BY d.image_id, d.box_id ORDER BY k)),
calm AS (SELECT image_id, box_id, 0::BIGINT AS k, 0::BIGINT AS grp, 0::BIGINT AS s, 0::BIGINT AS e, 0::BIGINT AS r, 0::BIGINT AS g, 0::BIGINT AS b, NULL::BIGINT AS carry FROM (SELECT DISTINCT image_id, box_id FROM spans)
 UNION ALL SELECT image_id, box_id, k, CASE WHEN act = 0 THEN grp + 1 ELSE grp END, CASE WHEN act = 0 THEN fs ELSE s END, CASE WHEN act = 2 THEN e ELSE fe END,
 CASE WHEN act = 0 THEN fr ELSE r END, CASE WHEN act = 0 THEN fg ELSE g END, CASE WHEN act = 0 THEN fb ELSE b END, CASE WHEN act = 2 THEN fs END
 FROM (SELECT c.image_id, c.box_id, f.k, grp, c.s, c.e, c.r, c.g, c.b, coalesce(carry, f.s) AS fs, f.e AS fe, f.r AS fr, f.g AS fg, f.b AS fb,
  CASE WHEN NOT odd OR (grp = 0 AND nr IS NULL) OR (grp > 0 AND nr IS NOT NULL AND {_APART.format(a="c.", b="f.n")} > 4000) THEN 0
   WHEN grp > 0 AND (nr IS NULL OR {_APART.format(a="f.", b="c.")} <= {_APART.format(a="f.", b="f.n")}) THEN 1 ELSE 2 END AS act
  FROM calm c JOIN flagged f ON {_ON.format(a="c", b="f")} AND f.k = c.k + 1)),
steady AS (SELECT image_id, box_id, grp AS k, arg_max(s, k) AS s, arg_max(e, k) AS e, arg_max(r, k) AS r, arg_max(g, k) AS g, arg_max(b, k) AS b FROM calm WHERE grp > 0 GROUP BY image_id, box_id, grp)"""
_MERGED = f"""merged AS (SELECT image_id, box_id, k, 1::BIGINT AS grp, s, e, r, g, b FROM steady WHERE k = 1
 UNION ALL SELECT m.image_id, m.box_id, t.k, CASE WHEN near THEN grp ELSE grp + 1 END, CASE WHEN near THEN m.s ELSE t.s END, CASE WHEN near AND total = 0 THEN m.e ELSE t.e END,
 {", ".join(f"CASE WHEN NOT near THEN t.{c} WHEN total = 0 THEN m.{c} ELSE floor((m.{c} * (m.e - m.s) + t.{c} * (t.e - t.s))::DOUBLE / total + 0.5)::BIGINT END" for c in "rgb")}
 FROM merged m JOIN steady t ON {_ON.format(a="m", b="t")} AND t.k = m.k + 1, LATERAL (SELECT {_APART.format(a="m.", b="t.")} <= 2000 AS near, (m.e - m.s) + (t.e - t.s) AS total)),
done AS (SELECT image_id, box_id, grp, arg_max(s, k) AS s, arg_max(e, k) AS e, arg_max(r, k) AS r, arg_max(g, k) AS g, arg_max(b, k) AS b FROM merged GROUP BY image_id, box_id, grp)"""
_WORDS = f"""WITH RECURSIVE {_JUDGED},
fg AS (SELECT p.image_id, p.box_id, chars, CASE WHEN tall THEN h ELSE w END AS axis, CASE WHEN tall THEN py ELSE px END AS pos, r, g, b
 FROM parted p JOIN told t ON {_ON.format(a="p", b="t")} WHERE part IN (1, 2) AND chars > 0 AND (dark IS NULL OR dark = (part = 1))),
isles AS (SELECT *, pos - dense_rank() OVER (PARTITION BY image_id, box_id ORDER BY pos) AS isle FROM fg),
runs AS (SELECT image_id, box_id, isle, min(pos) AS a, max(pos) + 1 AS z, {", ".join(f"{_MEDIAN.format(c=c)}::BIGINT AS {c}" for c in "rgb")}, any_value(chars) AS chars, any_value(axis) AS axis FROM isles GROUP BY image_id, box_id, isle),
segs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, box_id ORDER BY a) AS k, count(*) OVER (PARTITION BY image_id, box_id) AS many FROM runs) WHERE many > 1),
{_LAID},
{_CALM},
{_MERGED}
SELECT image_id, box_id, grp - 1 AS k, s AS start, e AS "end", r, g, b FROM (SELECT *, count(*) OVER (PARTITION BY image_id, box_id) AS many FROM done) WHERE many > 1"""
_SPANS = f"""{Q.D5},
marked AS (SELECT image_id, 0::BIGINT AS box_id, s + 1 AS k, count(*) OVER (PARTITION BY image_id) AS n, 3 * s AS s, 3 * s + 3 AS e, r // 64 * 64 AS r, g // 64 * 64 AS g, b // 64 * 64 AS b FROM pixels)"""
_SHOWN = 'SELECT image_id, {k} - 1 AS k, s AS start, e AS "end", r, g, b'
_RUNS = Q.SQL["foreground_runs"]
_CHAR_SPANS = f"""WITH RECURSIVE runs AS ({_RUNS}),
segs AS (SELECT image_id, 0::BIGINT AS box_id, row_number() OVER (PARTITION BY image_id ORDER BY start) AS k, start AS a, "end" AS z, 12::BIGINT AS chars, 25::BIGINT AS axis, 0 AS r, 0 AS g, 0 AS b FROM runs),
{_LAID} SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY k) - 1 AS k, s AS start, e AS "end" FROM laid WHERE kept"""
_PICTURE = f"{P._GRID}, pic AS (SELECT vec_id, list(trunc(least(greatest(p * 255, 0), 255))::BIGINT ORDER BY i) AS cells FROM g GROUP BY vec_id)"
_AT = "cells[least(greatest({row}, 0), 7) * 8 + least(greatest({col}, 0), 7) + 1]::DOUBLE * 257"
_EDGE = lambda k: f"({_AT.format(row=f'y0 + {k}', col='x0')} * (1 - fx) + {_AT.format(row=f'y0 + {k}', col='x0 + 1')} * fx)"
_BLENDED = f"""near AS (SELECT *, floor(sx)::BIGINT AS x0, floor(sy)::BIGINT AS y0, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM places),
blended AS (SELECT vec_id, k, CASE WHEN within THEN least(255, greatest(0, floor(({_EDGE(0)} * (1 - fy) + {_EDGE(1)} * fy) / 257 + 1e-9)))::BIGINT ELSE 255 END AS v FROM near JOIN pic USING (vec_id))"""
_TOTALS = "SELECT vec_id, {h}::BIGINT AS height, {w}::BIGINT AS width, sum(v)::BIGINT AS total, sum(v * (k + 1))::BIGINT AS placed FROM blended GROUP BY vec_id"
_RESIZED = f"""WITH {_PICTURE}, places AS (SELECT vec_id, k, true AS within, (k % 12) * 8.0::DOUBLE / 12 AS sx, (k // 12) * 8.0::DOUBLE / 5 AS sy FROM pic, (SELECT unnest(range(60)) AS k)), {_BLENDED} {_TOTALS.format(h=5, w=12)}"""
# The map of the unit square to a quad of corners (x0, y0) to (x3, y3), as columns g, h and the others written out.
_SQUARE = """(SELECT *, ((x0 - x1 + x2 - x3) * (y3 - y2) - (x3 - x2) * (y0 - y1 + y2 - y3)) / den AS g, ((x1 - x2) * (y0 - y1 + y2 - y3) - (x0 - x1 + x2 - x3) * (y1 - y2)) / den AS h
 FROM (SELECT *, nullif((x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2), 0) AS den FROM {quads}))"""
_WARP_QUAD = "(SELECT " + ", ".join(f"{v}::DOUBLE AS {c}{k}" for k, q in enumerate(P.WARPED) for c, v in zip("xy", q)) + ")"
_WARPED = f"""WITH {_PICTURE}, m AS (SELECT *, x1 - x0 + g * x1 AS a, x3 - x0 + h * x3 AS b, y1 - y0 + g * y1 AS d, y3 - y0 + h * y3 AS e FROM {_SQUARE.format(quads=_WARP_QUAD)}),
uv AS (SELECT k, (k % 10) / 9.0::DOUBLE AS u, (k // 10) / 5.0::DOUBLE AS v FROM (SELECT unnest(range(60)) AS k)),
src AS (SELECT k, round((a * u + b * v + x0) / (g * u + h * v + 1), 9) AS sx, round((d * u + e * v + y0) / (g * u + h * v + 1), 9) AS sy FROM uv, m),
places AS (SELECT vec_id, k, sx >= 0 AND sy >= 0 AND sx <= 7 AND sy <= 7 AS within, sx, sy FROM pic, src), {_BLENDED} {_TOTALS.format(h=6, w=10)}"""
_LAID_STRAIGHT = f"""WITH {Q.D1}, {P._QUAD_SQL}, f AS (SELECT image_id, box_id, {", ".join(f"{p}.{c}::DOUBLE AS {c}{k}" for k, p in enumerate("abcd") for c in "xy")} FROM o),
m AS (SELECT *, x1 - x0 + g * x1 AS a, x3 - x0 + h * x3 AS b, x0 AS c, y1 - y0 + g * y1 AS d, y3 - y0 + h * y3 AS e, y0 AS f, (x0 + x1 + x2 + x3) / 4 AS x, (y0 + y1 + y2 + y3) / 4 AS y FROM {_SQUARE.format(quads="f")})
SELECT image_id, box_id, round(((e - f * h) * x + (c * h - b) * y + (b * f - c * e)) / w * 100, 4) AS x, round(((f * g - d) * x + (a - c * g) * y + (c * d - a * f)) / w * 50, 4) AS y FROM (SELECT *, (d * h - e * g) * x + (b * g - a * h) * y + (a * e - b * d) AS w FROM m)"""
_JSON = f"""{P._LINED} SELECT image_id, '{{"text":"' || string_agg(text, '\\n' ORDER BY line) || '","lines":[' || string_agg('{{"text":"' || text || '","score":' || round(score, 6)::VARCHAR || ',"box":[[' || x0 || ',' || y0 || '],[' || x1 || ',' || y0 || '],[' || x1 || ',' || y1 || '],[' || x0 || ',' || y1 || ']]}}', ',' ORDER BY line) || ']}}' AS body FROM l GROUP BY image_id"""

_CLAMP = {"x": ("x0", "x1"), "y": ("y0", "y1")}
_PLACED = ", ".join(f"CASE WHEN seq IS NULL THEN {v} ELSE least({hi}, greatest({lo}, {v} - 10 + {lo})) END AS p{k}{c}" for k, corner in enumerate((("b.x0", "b.y0"), ("b.x1", "b.y0"), ("b.x1", "b.y1"), ("b.x0", "b.y1"))) for c, v in zip("xy", corner) for lo, hi in [(f"m{c}", f"n{c}")])
_SESSION_OCR = f"""WITH {Q.D1},
log AS (SELECT user_id, ts, event_id, event_type = 'signup' AS alive FROM events WHERE event_type IN ('signup', 'error')),
asked AS (SELECT event_id AS request_id, ts, user_id, event_id % 3 AS boxes, event_id % 17 = 0 OR event_id % 19 = 0 AS bad FROM events WHERE event_type NOT IN ('signup', 'error')),
latest AS (SELECT a.*, (SELECT max(struct_pack(ts := l.ts, event_id := l.event_id, alive := l.alive)) FROM log l WHERE l.user_id = a.user_id AND l.ts <= a.ts) AS last FROM asked a),
told AS (SELECT *, coalesce(last.alive, false) AS alive, last.event_id AS image_id FROM latest),
wanted AS (SELECT *, (request_id * 3 + seq * 40) % 150 - 6 AS mx, (request_id * 5 + seq * 30) % 90 - 5 AS my FROM (SELECT request_id, image_id, unnest(CASE WHEN boxes = 0 THEN [NULL] ELSE range(boxes) END)::BIGINT AS seq FROM told WHERE alive AND NOT bad)),
sized AS (SELECT *, mx + 71 AS nx, my + 40 AS ny FROM wanted),
lines AS (SELECT request_id, seq, box_id, text, {_PLACED} FROM sized w JOIN boxes b ON b.image_id = w.image_id AND (seq IS NULL OR box_id % 2 = seq)),
put AS (SELECT request_id, count(*) AS n, string_agg(text, chr(10) ORDER BY seq, box_id) AS full_text, string_agg(concat_ws(',', {", ".join(f"p{k}{c}" for k in range(4) for c in "xy")}), ';' ORDER BY seq, box_id) AS boxes FROM lines GROUP BY request_id)
SELECT t.request_id, CASE WHEN bad THEN 400 WHEN NOT alive THEN 404 ELSE 200 END::BIGINT AS status, CASE WHEN bad THEN 'missing session_id' WHEN NOT alive THEN 'session ' || user_id || ' not found' END AS detail,
 CASE WHEN NOT bad AND alive THEN coalesce(p.n, 0) END AS n, CASE WHEN NOT bad AND alive THEN coalesce(p.full_text, '') END AS full_text, CASE WHEN NOT bad AND alive THEN coalesce(p.boxes, '') END AS boxes
FROM told t LEFT JOIN put p ON p.request_id = t.request_id"""

_REQUEST_STATUS = f"""WITH up AS (SELECT 'd' || doc_id AS request_id, doc_id % 7 AS form, octet_length(encode(coalesce(text, ''))) AS size FROM documents),
why AS (SELECT *, CASE WHEN form = 2 THEN 'bad json' WHEN form = 3 THEN 'bad base64' WHEN form = 4 THEN 'unsupported content type' WHEN form = 6 THEN 'no image part' WHEN size = 0 THEN 'empty image' END AS reason FROM up),
log AS (SELECT user_id, ts, event_id, event_type = 'signup' AS alive FROM events WHERE event_type IN ('signup', 'error')),
asked AS (SELECT event_id, ts, user_id, event_id % 17 = 0 OR event_id % 19 = 0 AS bad FROM events WHERE event_type NOT IN ('signup', 'error')),
told AS (SELECT *, coalesce((SELECT max(struct_pack(ts := l.ts, event_id := l.event_id, alive := l.alive)) FROM log l WHERE l.user_id = a.user_id AND l.ts <= a.ts).alive, false) AS alive FROM asked a)
SELECT request_id, CASE WHEN reason IS NULL THEN 200 ELSE 400 END::BIGINT AS status, CASE WHEN reason IS NOT NULL THEN 'invalid or missing image' END AS detail, reason, CASE WHEN reason IS NULL THEN size END::BIGINT AS n_bytes FROM why
UNION ALL SELECT 's' || event_id, CASE WHEN bad THEN 400 WHEN alive THEN 200 ELSE 404 END, CASE WHEN bad THEN 'missing session_id' WHEN NOT alive THEN 'session ' || user_id || ' not found' END, CASE WHEN bad THEN 'missing session_id' END, NULL FROM told
UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_nationkey % 3 = 2 THEN 404 ELSE 200 END, CASE WHEN n_nationkey % 3 = 2 THEN 'not found' END, NULL, NULL FROM nation"""
_TREE = f"""{Q.D1}, {Q.D2}, {Q.PARENTS}, {Q.ASSIGN},
leaf AS (SELECT b.image_id, a.parent_id, b.box_id + 10 AS ord, b.x0, b.y0, b.x1, b.y1, CASE WHEN b.box_id % 6 <> 5 THEN b.text ELSE '' END AS text FROM boxes b LEFT JOIN assigned a ON a.image_id = b.image_id AND a.box_id = b.box_id WHERE b.x1 > b.x0 AND b.y1 > b.y0),
dir AS (SELECT *, first_value(y1 - y0 > x1 - x0) OVER (PARTITION BY image_id, parent_id ORDER BY ord) AS down FROM leaf WHERE parent_id IS NOT NULL),
region AS (SELECT d.image_id, d.parent_id AS ord, any_value(p.x0) AS x0, any_value(p.y0) AS y0, any_value(p.x1) AS x1, any_value(p.y1) AS y1, count(*) AS n, avg(least(d.x1 - d.x0, d.y1 - d.y0)) AS size,
 CASE WHEN (d.image_id + d.parent_id) % 7 = 0 THEN 'r' || d.parent_id ELSE coalesce(string_agg(d.text, ' ' ORDER BY CASE WHEN down THEN -((d.x0 + d.x1) // 2) ELSE (d.y0 + d.y1) // 2 END, CASE WHEN down THEN (d.y0 + d.y1) // 2 ELSE (d.x0 + d.x1) // 2 END, d.ord) FILTER (d.text <> ''), '') END AS text
 FROM dir d JOIN parents p ON p.image_id = d.image_id AND p.parent_id = d.parent_id GROUP BY d.image_id, d.parent_id),
top AS (SELECT image_id, ord, x0, y0, x1, y1, n, size, text FROM region UNION ALL SELECT image_id, ord, x0, y0, x1, y1, 1, least(x1 - x0, y1 - y0), text FROM leaf WHERE parent_id IS NULL),
way AS (SELECT *, first_value(y1 - y0 > x1 - x0) OVER (PARTITION BY image_id ORDER BY ord) AS down FROM top)"""
_CTC_DICT = """WITH dict AS (SELECT n_nationkey + 1 AS class, lower(substr(n_name, 1, 1)) AS entry FROM nation WHERE n_nationkey < 4),
l AS (SELECT vec_id, i // 8 AS t, i % 8 AS c, embedding[i + 1]::DOUBLE AS p FROM embeddings, (SELECT unnest(range(64)) AS i)),
a AS (SELECT vec_id, t, first(c ORDER BY p DESC, c) AS c, max(p) AS p FROM l GROUP BY vec_id, t),
e AS (SELECT * FROM (SELECT *, lag(c) OVER (PARTITION BY vec_id ORDER BY t) AS q FROM a) WHERE c <> 0 AND (q IS NULL OR q <> c)),
g AS (SELECT vec_id, string_agg(entry, '' ORDER BY t) AS text, exp(sum(CASE WHEN p > 0 THEN ln(p) ELSE 0 END) / count(*)) AS score FROM e JOIN dict ON dict.class = e.c GROUP BY vec_id)
SELECT m.vec_id, coalesce(g.text, '') AS text, round(coalesce(g.score, 0), 6) AS score FROM embeddings m LEFT JOIN g ON m.vec_id = g.vec_id"""
_OUTER = f"""WITH RECURSIVE {P._COMPONENTS}, {P._HULL},
many AS (SELECT vec_id, component FROM edge GROUP BY ALL HAVING count(*) > 2),
side AS (SELECT edge.vec_id, edge.component, px::DOUBLE AS px, py::DOUBLE AS py, qx::DOUBLE AS qx, qy::DOUBLE AS qy, sqrt(((qx - px) ** 2 + (qy - py) ** 2)::DOUBLE) AS len FROM edge JOIN many ON many.vec_id = edge.vec_id AND many.component = edge.component)"""
_UNCLIP = f"""{_OUTER},
far AS (SELECT vec_id, component, sum(px * qy - qx * py) / 2 AS signed, sum(len) AS around FROM side GROUP BY ALL),
m AS (SELECT e.vec_id, e.component, px, py, qx, qy, (qy - py) / len * d AS ox, -(qx - px) / len * d AS oy, qx - px AS dx, qy - py AS dy FROM side e JOIN (SELECT vec_id, component, abs(signed) * {G.UNCLIP} / around * sign(signed) AS d FROM far) f ON f.vec_id = e.vec_id AND f.component = e.component),
met AS (SELECT b.vec_id, b.component, b.px, b.py, a.px + a.ox AS ax, a.py + a.oy AS ay, a.dx AS ex, a.dy AS ey, b.px + b.ox AS vx, b.py + b.oy AS vy, b.dx AS fx, b.dy AS fy FROM m a JOIN m b ON a.vec_id = b.vec_id AND a.component = b.component AND a.qx = b.px AND a.qy = b.py)
SELECT vec_id, component, px, py, round(ax + ((vx - ax) * fy - (vy - ay) * fx) / (ex * fy - ey * fx) * ex, 6) + 0.0::DOUBLE AS x, round(ay + ((vx - ax) * fy - (vy - ay) * fx) / (ex * fy - ey * fx) * ey, 6) + 0.0::DOUBLE AS y FROM met"""
_POLYGON_SCORE = f"""{_OUTER},
hit AS (SELECT e.vec_id, e.component, g.i, any_value(g.p) AS p FROM side e JOIN g ON g.vec_id = e.vec_id GROUP BY e.vec_id, e.component, g.i
 HAVING count(*) FILTER ((qy > y) <> (py > y) AND x < (px - qx) * (y - qy) / nullif(py - qy, 0) + qx) % 2 = 1)
SELECT * FROM (SELECT vec_id, component, count(*) AS cells, round(avg(p), 6) AS score FROM hit GROUP BY vec_id, component) WHERE score >= {G.BOX_SCORE}"""

SQL = {
    "box_text_color": f"WITH {_JUDGED} SELECT image_id, box_id, {', '.join(f'CASE WHEN dark IS NULL THEN {c}a WHEN dark THEN {c}d ELSE {c}l END AS {c}' for c in 'rgb')} FROM told",
    "word_colors": _WORDS,
    "word_char_spans": _CHAR_SPANS,
    "suppress_outliers": f"WITH RECURSIVE {_SPANS}, spans AS (SELECT * FROM marked), {_CALM} {_SHOWN.format(k='k')} FROM steady",
    "merge_similar_spans": f"WITH RECURSIVE {_SPANS}, steady AS (SELECT * FROM marked), {_MERGED} {_SHOWN.format(k='grp')} FROM done",
    "bilinear_resize": _RESIZED,
    "perspective_warp": _WARPED,
    "homography": _LAID_STRAIGHT,
    "ocr_json": _JSON,
    "session_ocr": _SESSION_OCR,
    "request_status": _REQUEST_STATUS,
    "nested_text": f"WITH {_TREE} SELECT image_id, coalesce(string_agg(text, ' ' ORDER BY CASE WHEN down THEN -((x0 + x1) // 2) ELSE (y0 + y1) // 2 END, CASE WHEN down THEN (y0 + y1) // 2 ELSE (x0 + x1) // 2 END, ord) FILTER (text <> ''), '') AS text, sum(n)::BIGINT AS leaves FROM way GROUP BY image_id",
    "nested_size": f"WITH {_TREE} SELECT image_id, round(avg(size), 6) AS size FROM way GROUP BY image_id",
    "ctc_decode_dict": _CTC_DICT,
    "unclip_polygon": _UNCLIP,
    "polygon_score": _POLYGON_SCORE,
}
