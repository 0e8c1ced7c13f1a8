"""Word colours, session requests, nested boxes, polygons and dictionaries against plain Python."""

import json
import random
import sys
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from glyphflow.functions import geometry as g
from glyphflow.operators import colour, grid, raster, recognise, requests, trees
from glyphflow.plans import composed
from glyphflow.plans import workflow as W
from glyphflow.sources import charset, images

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests

PIXEL = "image_id long, x long, y long, r long, g long, b long"
BOX = "image_id long, box_id long, quad array<struct<x:bigint,y:bigint>>, text string, width long, height long"
WHITE, RED, BLUE, BLACK, GREEN = (255, 255, 255), (250, 0, 0), (0, 0, 250), (0, 0, 0), (0, 250, 0)


def page(k, w, h, *patches, ground=WHITE):
    a = np.zeros((h, w, 3), int) + ground
    for x0, y0, x1, y1, c in patches:
        a[y0:y1, x0:x1] = c
    return [(k, x, y, *map(int, a[y, x])) for y in range(h) for x in range(w)]


def rect(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def test_word_colours(spark):
    two = [(2, 2, 10, 8, RED), (20, 2, 30, 8, BLUE)]
    tall = [(2, 0, 8, 20, RED), (2, 25, 8, 50, BLUE)]
    pages = [page(1, 40, 10, *two), page(2, 10, 50, *tall), page(3, 40, 10, (2, 2, 10, 8, RED)), page(4, 40, 10, *two), page(5, 40, 10, (0, 0, 9, 10, BLACK), (12, 0, 40, 10, BLACK)), page(6, 90, 60, (30, 20, 38, 28, BLACK), (40, 20, 60, 28, BLACK), ground=GREEN)]
    boxes = [
        (1, 1, rect(0, 0, 40, 10), "ab cd", 40, 10), (2, 1, rect(0, 0, 10, 50), "abcde", 10, 50), (3, 1, rect(0, 0, 40, 10), "ab cd", 40, 10), (4, 1, rect(0, 0, 40, 10), "", 40, 10),
        (4, 2, rect(0, 0, 40, 10), None, 40, 10), (4, 3, rect(-30, -5, 80, 30), "ab cd", 40, 10), (5, 1, rect(0, 0, 40, 10), "ab", 40, 10), (6, 1, rect(30, 20, 60, 28), "ab", 90, 60), (6, 2, rect(200, 200, 300, 220), "far", 90, 60), (6, 3, rect(3, 3, 4, 4), "dot", 90, 60),
    ]
    p, b = spark.createDataFrame([x for ps in pages for x in ps], PIXEL), spark.createDataFrame(boxes, BOX)
    got = {(r.image_id, r.box_id): [tuple(s) for s in r.spans] for r in colour.word_colours(p, b).collect()}
    assert got == {(1, 1): [(0, 1, *RED), (3, 4, *BLUE)], (2, 1): [(0, 2, *RED), (3, 5, *BLUE)], (4, 3): [(0, 1, *RED), (3, 4, *BLUE)]}
    found = {(r.image_id, r.box_id): (r.r, r.g, r.b) for r in colour.text_colours(p, b).collect()}
    # (5, 1): no margin at all, both parts uniform, so the dark one; (6, 1): the gap is of the colour around it; (6, 3): too few pixels.
    assert found == {(1, 1): BLUE, (2, 1): BLUE, (3, 1): RED, (4, 1): BLUE, (4, 2): BLUE, (4, 3): BLUE, (5, 1): BLACK, (6, 1): BLACK}


def test_ring_decides_only_where_the_box_leaves_no_ground(spark):
    # The box is mostly dark: without the ring its light strokes, fewer, would have the smaller variance and be the ground.
    dark, light = (40, 40, 40), (200, 200, 200)
    p = spark.createDataFrame(page(1, 80, 50, (20, 20, 50, 30, light), (22, 22, 24, 28, dark), ground=dark), PIXEL)
    b = spark.createDataFrame([(1, 1, rect(20, 20, 50, 30), "x", 80, 50)], BOX)
    near, far = colour.seen(p, b), colour.seen(p, b, ring=0)
    assert near.where("place = 'ring'").count() == 60 * 40 - 300 and far.where("place = 'ring'").count() == 0
    assert [tuple(r)[2:] for r in colour.text_colours(p, b).collect()] == [light]
    assert {(r.cr, r.cg, r.cb) for r in colour.judged(far).collect()} == {dark}


def random_pages(n=16, seed=8):
    """Pages of a few coarse colours, some channels unknown, with straight and slanted boxes at odd places."""
    r, out, boxes = np.random.default_rng(seed), [], []
    for k in range(n):
        w, h = (int(v) for v in r.integers(8, 90, 2))
        a = r.integers(0, 5, (-(-h // 3), -(-w // 4), 3)).repeat(3, 0).repeat(4, 1)[:h, :w] * 60
        a[r.random((h, w)) < 0.4] = r.integers(0, 2) * 250
        gaps = r.random((h, w, 3)) < (0.05 if k % 3 == 0 else 0)
        out += [(k, x, y, *(None if gaps[y, x, c] else int(a[y, x, c]) for c in range(3))) for y in range(h) for x in range(w)]
        for b in range(5):
            x0, y0, x1, y1 = (int(v) for v in r.integers(-10, 95, 4))
            quad = rect(min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)) if b % 2 else [(int(x), int(y)) for x, y in r.integers(-5, 70, (4, 2))]
            boxes.append((k, b, quad, ["some words here", "", None, "ab", "x" * 40][int(r.integers(5))], w, h))
    return out, boxes


def test_colours_by_vectors_and_by_windows_are_the_same(spark):
    rows, boxes = random_pages()
    p, b = spark.createDataFrame(rows, PIXEL).cache(), spark.createDataFrame(boxes, BOX)
    told = lambda f, most: sorted(map(repr, f(p, b, most).collect()))
    for f, least in ((colour.word_colours, 5), (colour.text_colours, 30)):
        want = told(f, 0)
        assert len(want) >= least and told(f, 3000) == want == told(f, colour.MOST)
    p.unpersist()


def test_colours_shuffle_a_box_and_not_its_pixels(spark):
    p, b = (spark.createDataFrame(x, y) for x, y in ((page(1, 40, 10, (2, 2, 10, 8, RED)), PIXEL), ([(1, 1, rect(0, 0, 40, 10), "ab cd", 40, 10)], BOX)))
    for f in (colour.word_colours, colour.text_colours):
        plan = f(p, b)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Window" not in plan


def test_colours_of_events_without_value_equal_sql(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("value", F.when(F.col("event_id") % 4 != 0, F.col("value")))
    e.write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = composed.QUERIES["box_text_color"](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({composed.SQL['box_text_color']})").fetchall()
    assert len(want) == 75 and sorted(map(tuple, got.collect())) == sorted(want)


T0 = datetime(2024, 1, 1)


def log_and_requests(n=400, seed=6):
    r = random.Random(seed)
    at = lambda: T0 + timedelta(seconds=r.randrange(20_000))
    log = [(r.randrange(6), at(), k, r.choice(["create", "delete", "get"]), f"p{k}") for k in range(n)]
    asked = [(k, str(r.randrange(7)), at()) for k in range(n)]
    return log, asked


@pytest.mark.parametrize("bucket", [1, 700, 10**9])
def test_as_of(spark, bucket):
    log, asked = log_and_requests()
    want = {}
    for k, session, ts in asked:
        past = [x for x in log if str(x[0]) == session and x[3] != "get" and x[1] <= ts]
        last = max(past, key=lambda x: (x[1], x[2]), default=None)
        want[k] = (bool(last and last[3] == "create"), last[4] if last and last[3] == "create" else None)
    lines = spark.createDataFrame(log, "session_id long, ts timestamp, event_id long, op string, payload string")
    rows = spark.createDataFrame([*asked, (999, None, T0)], "request_id long, session_id string, ts timestamp")
    assert {r.request_id: (r.alive, r.value) for r in requests.as_of(rows, lines, bucket).collect()} == want


class Reader:
    """Reads the size and the mean grey of what it is given."""

    def recognise(self, image, quad):
        return f"{image.shape[1]}x{image.shape[0]}:{int(image.mean())}", 0.5


def test_session_ocr(spark):
    W.STAGES["reader"] = Reader
    W.workflow("reader", detect="whole", recognise="reader")
    gray = np.full((30, 40, 3), 100, np.uint8)
    flat = lambda *v: dict(zip(requests.FLAT, v))
    body = lambda s, *boxes: json.dumps({"session_id": s, "bounding_boxes": [flat(*b) for b in boxes]})
    at = lambda s: T0 + timedelta(seconds=s)
    log = spark.createDataFrame([("a", at(0), 1, "create", "page"), ("b", at(0), 2, "create", "junk"), ("a", at(50), 3, "delete", None)], "session_id string, ts timestamp, event_id long, op string, payload string")
    two = [(30, 0, 39, 0, 39, 9, 30, 9), (-500, -5, 900, -5, 900, 20, -500, 20)]
    asked = [(1, at(10), body("a")), (2, at(10), body("a", *two)), (3, at(60), body("a")), (4, at(1), body("b")), (5, at(1), "{"), (6, at(1), '{"session_id": ""}'), (7, at(1), None), (8, at(1), body("zz")), (9, at(10), '{"session_id": "a", "bounding_boxes": [], "language": "en"}')]
    rows = spark.createDataFrame(asked, "request_id long, ts timestamp, body string")
    pictures = spark.createDataFrame([("page", bytearray(images.encode_png(gray))), ("junk", bytearray(b"junk"))], "value string, content binary")
    got = {r.request_id: r for r in requests.session_ocr(W.Engine(W.with_workflow("reader")), rows, log, pictures).collect()}
    assert {k: r.status for k, r in got.items()} == {1: 200, 2: 200, 3: 404, 4: 200, 5: 400, 6: 400, 7: 400, 8: 404, 9: 200}
    assert got[1].full_text == got[9].full_text == "40x30:100" and got[4].results == [] and got[4].full_text == ""
    assert got[3].detail == "session a not found" and got[5].detail == "missing session_id" and got[3].results is None
    # The second region is clamped to the page, 40 x 20; results stand in the order asked, their boxes inside their regions.
    assert [r.text.split(":")[0] for r in got[2].results] == ["29x29", "60x40"]
    assert [tuple(p) for p in got[2].results[0].box] == [(30, 0), (39, 0), (39, 9), (30, 9)]
    assert [tuple(p) for p in got[2].results[1].box] == [(-500, -5), (-451, -5), (-451, 20), (-500, 20)]


def test_cropped_quad_stays_in_the_image():
    a = np.full((20, 400, 3), 9, np.uint8)
    out = raster.cropped_quad(a, rect(-500, -3, 900, 60))
    assert out.shape == (40, 420, 3) and (out[10:30, 10:410] == 9).all() and (out[:10] == 255).all()
    assert raster.cropped_quad(a, rect(500, 50, 600, 90)).shape == (21, 21, 3)


def tree_rows(seed):
    r, rows = random.Random(seed), []

    def grow(node, parent, depth, order):
        x, y = r.randrange(60), r.randrange(60)
        kids = r.randrange(1, 4) if depth < 5 and r.random() < 0.8 - depth * 0.12 else 0
        rows.append((seed, node, parent, order, x, y, x + r.randrange(1, 30), y + r.randrange(1, 30), r.choice(["", "w%d" % node, None]) if not kids or r.random() < 0.15 else ""))
        for k in range(kids):
            grow(node * 5 + k + 1, node, depth + 1, k)

    grow(1, None, 0, 0)
    return rows


def nested_by_hand(rows):
    kids = {}
    for row in rows:
        kids.setdefault(row[2], []).append(row)
    for k in kids.values():
        k.sort(key=lambda x: x[3])

    def text(row):
        own = kids.get(row[1], [])
        if row[8] or not own:
            return row[8] or ""
        down = own[0][7] - own[0][5] > own[0][6] - own[0][4]
        cx, cy = (lambda q: (q[4] + q[6]) // 2), (lambda q: (q[5] + q[7]) // 2)
        own = sorted(own, key=(lambda q: (-cx(q), cy(q), q[3])) if down else (lambda q: (cy(q), cx(q), q[3])))
        return " ".join(t for t in map(text, own) if t)

    def size(row):
        own = kids.get(row[1], [])
        return sum(map(size, own)) / len(own) if own else min(row[6] - row[4], row[7] - row[5])

    root = kids[None][0]
    return text(root), size(root)


def test_nested(spark):
    rows = {k: tree_rows(k) for k in range(60)}
    assert max(len(x) for x in rows.values()) > 20
    d = spark.createDataFrame([x for v in rows.values() for x in v], "tree_id long, node_id long, parent_id long, ord long, x0 long, y0 long, x1 long, y1 long, text string")
    got = {r.tree_id: (r.text, r.size) for r in trees.nested(d).collect()}
    want = {k: nested_by_hand(v) for k, v in rows.items()}
    assert {k: t for k, (t, _) in got.items()} == {k: t for k, (t, _) in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1]) for k in want)
    assert trees.nested(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        trees.nested(spark.createDataFrame([(1, 1, None, 0), (1, 2, 1, 0), *[(1, k, k - 1, 0) for k in range(3, 30)]], "tree_id long, node_id long, parent_id long, ord long").selectExpr("*", "0L x0", "0L y0", "1L x1", "1L y1", "'' text"))


def test_polygons(spark):
    r, rows = random.Random(4), []
    for k in range(80):
        points = grid.hull([(float(r.randrange(12)), float(r.randrange(12))) for _ in range(r.randrange(1, 12))])
        rows.append((k, points if k % 2 else points[::-1]))
    rows += [(900, rect(0.0, 0.0, 10.0, 4.0)), (901, [(0.0, 0.0), (4.0, 0.0), (8.0, 0.0), (8.0, 3.0), (0.0, 3.0)]), (902, [(1.0, 1.0)] * 4), (903, [])]
    d = spark.createDataFrame(rows, "id long, p array<struct<x:double,y:double>>")
    for x in d.select("id", "p", g.unclipped(F.col("p"), 1.5).alias("q")).collect():
        want = grid.unclip([tuple(v) for v in x.p], 1.5)
        assert np.allclose(np.array([tuple(v) for v in x.q]).reshape(-1, 2), np.array(want).reshape(-1, 2)), x.id
    at = spark.createDataFrame([(float(a), float(b)) for a in range(-1, 13) for b in range(-1, 13)], "x double, y double")
    shapes = dict(rows)
    got = d.where("size(p) > 2").crossJoin(at).select("id", "x", "y", g.in_polygon_of(F.col("x"), F.col("y"), F.col("p")).alias("w")).collect()
    assert len(got) > 5000 and all(v.w == bool(grid.inside(np.array(v.x), np.array(v.y), shapes[v.id])) for v in got)
    quads = spark.createDataFrame([(1, rect(2, 1, 9, 7)), (2, [(1, 0), (11, 3), (9, 8), (0, 6)])], "id long, p array<struct<x:bigint,y:bigint>>")
    both = quads.crossJoin(at).select(g.in_corners(F.col("x"), F.col("y"), F.col("p")).alias("a"), g.in_polygon_of(F.col("x"), F.col("y"), F.col("p")).alias("b")).collect()
    assert all(v.a == v.b for v in both)


def test_dictionary_table(spark, tmp_path):
    for name, text, want in (("a.txt", "A\nB\nC\n", ["", "A", "B", "C", " "]), ("b.txt", "A\r\n\r\nC", ["", "A", "", "C", " "]), ("c.txt", "", ["", " "])):
        (tmp_path / name).write_bytes(text.encode())
        got = charset.dictionary(spark, str(tmp_path / name)).orderBy("class").collect()
        assert [(r["class"], r.entry) for r in got] == list(enumerate(want)) and want == charset.load(str(tmp_path / name))[: len(want)]
    words = charset.dictionary(spark, str(tmp_path / "a.txt"))
    step = lambda c, p: [p if k == c else 0.01 for k in range(8)]
    lists = [[(1, 0.9), (2, 0.8), (3, 0.7)], [(1, 0.9), (1, 0.5), (0, 0.9), (1, 0.4)], [(0, 0.9)], [(1, 0.9), (7, 0.9), (1, 0.3)], [(7, 0.9)], []]
    d = spark.createDataFrame([(k, [v for c, p in s for v in step(c, p)]) for k, s in enumerate(lists)], "id long, l array<double>")
    want = {0: ("ABC", (0.9 * 0.8 * 0.7) ** (1 / 3)), 1: ("AA", (0.9 * 0.4) ** 0.5), 2: ("", 0), 3: ("AA", (0.9 * 0.3) ** 0.5), 4: ("", 0), 5: ("", 0)}
    for small in (recognise.SMALL, 2):
        got = {r.id: (r.text, r.score) for r in recognise.ctc_by_table(d.where("size(l) > 0"), ["id"], F.col("l"), 8, words, small).collect()}
        assert {k: t for k, (t, _) in got.items()} == {k: want[k][0] for k in got} and all(got[k][1] == pytest.approx(want[k][1]) for k in got)


@pytest.mark.parametrize("most", [0, 3, 40])
def test_clusters_by_joins_equal_those_of_one_task(spark, most):
    from glyphflow.operators import boxes as B
    from glyphflow.sources import derived

    d = derived.boxes(spark, "/root/testdata/sf0.001").where("image_id < 300")
    r = random.Random(9)
    chain = [(10_000 + k % 3, k // 3, 40 * (k // 3), r.choice([0, 4]), 40 * (k // 3) + 35, 12, 0.5, "t") for k in range(150)]  # long chains
    d = d.unionByName(spark.createDataFrame(chain, d.schema))
    row = lambda x: (x.image_id, x.box_id, x.x0, x.text, x.cluster)
    want = sorted(row(x) for x in B.box_clusters(d).collect())
    got = B.box_clusters(d, most=most)
    assert got.columns == [*d.columns, "cluster"] and sorted(row(x) for x in got.collect()) == want
    assert max(sum(1 for x in want if x[0] == 10_000 and x[4] == c) for c in {x[4] for x in want}) > 10


def test_routes(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    log = spark.createDataFrame([("a", at(0), 1, "create", "x")], "session_id string, ts timestamp, event_id long, op string, payload string")
    rows = [
        (1, "health", None, None), (2, "ocr", "application/json", b'{"image": "aGk="}'), (3, "detect", "application/json", b'{"image": ""}'), (4, "ocr", None, None), (5, "session_create", "multipart/form-data; boundary=q", b"--q--"),
        (6, "session_detect", "application/json", b'{"session_id": "a"}'), (7, "session_ocr", None, None), (8, "session_delete", None, None), (9, "nowhere", None, None), (10, None, None, None), (11, "ocr", "application/json", b"[]"), (12, "session_ocr", None, b'{"session_id": "b"}'),
        (13, "detect", "Application/JSON; charset=utf-8", b'{"image": "data:image/png;base64,aGk="}'),
    ]
    d = spark.createDataFrame([(i, at(5), r, c, b) for i, r, c, b in rows], "request_id long, ts timestamp, route string, content_type string, body binary")
    got = {r.request_id: (r.status, r.reason, r.n_bytes) for r in requests.routed(d, log).collect()}
    assert got == {
        1: (200, None, None), 2: (200, None, 2), 3: (400, "empty image", None), 4: (400, "unsupported content type", None), 5: (400, "no image part", None), 6: (200, None, None), 7: (400, "missing session_id", None),
        8: (200, None, None), 9: (404, None, None), 10: (404, None, None), 11: (400, "bad json", None), 12: (404, None, None), 13: (200, None, 2),
    }
    assert {r.status for r in requests.routed(d.where("route = 'health'"), log, ready=False).collect()} == {503}
    ids = [r.s for r in spark.createDataFrame([("x",), ("",), (None,)], "g string").select(requests.session_ids(F.col("g")).alias("s")).collect()]
    assert ids[0] == "x" and all(len(i) == 36 for i in ids[1:]) and ids[1] != ids[2]


@pytest.mark.parametrize("most", [0, 12, 4096])
def test_trees_of_one_task_equal_those_by_levels(spark, most):
    """Equal places, repeated and missing ids, null coordinates, texts at any level; small and large trees at once."""
    r, rows = random.Random(11), []
    for k in range(80):
        rows.append((k, 0, None, 0, 0, 0, 9, 9, r.choice(["", "top", None])))
        for n in range(1, r.randrange(1, 30)):
            x, y = r.randrange(-9, 9), r.randrange(-9, 9)
            box = [v if r.random() < 0.95 else None for v in (x, y, x + r.randrange(1, 9), y + r.randrange(1, 9))]
            rows.append((k, n if r.random() < 0.97 else None, None if r.random() < 0.05 else r.randrange(max(0, n - 5), n), n, *box, r.choice(["", None, "a", "b", "é"])))
    d = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, ord long, x0 long, y0 long, x1 long, y1 long, text string")
    key = lambda x: (x.tree_id, x.root_id is None, x.root_id or 0)
    want, got = (sorted(f.collect(), key=key) for f in (trees._by_levels(d), trees.nested(d, most)))
    assert [(*key(x), x.text, x.leaves) for x in got] == [(*key(x), x.text, x.leaves) for x in want] and len(got) > 80
    assert all(g_.size == pytest.approx(w.size) if w.size is not None else g_.size is None for g_, w in zip(got, want))


def test_clusters_of_many_images_at_once():
    """Images of none to many boxes, some with turned corners, in one call; as by a union-find of each image."""
    from glyphflow.operators import boxes as B

    r, parts = random.Random(12), []
    for n in [0, 1, 2, 5, 31, 32, 33, 80, *[r.randrange(1, 12) for _ in range(200)]]:
        x, y = [r.randrange(200) for _ in range(n)], [r.randrange(200) for _ in range(n)]
        low = -3 if n == 5 else 1
        parts.append((x, y, [v + r.randrange(low, 40) for v in x], [v + r.randrange(low, 40) for v in y], sorted(r.sample(range(999), n))))
    of = np.repeat(np.arange(len(parts)), [len(p[4]) for p in parts])
    box = {c: np.array([v for p in parts for v in p[k]]) for k, c in enumerate(("x0", "y0", "x1", "y1", "box_id"))}
    want = [v for p in parts for v in B._labels(*p, 10, 1.5)]
    assert B._labels_of(of, box, 10, 1.5).tolist() == want and want != box["box_id"].tolist()
    assert len(B._labels_of(of[:0], {c: v[:0] for c, v in box.items()}, 10, 1.5)) == 0
