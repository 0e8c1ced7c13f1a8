"""Kernels, folds, stages, sources and sessions against plain Python."""

import json
import random
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from glyphflow.operators import colour, grid, raster
from glyphflow.plans import workflow as W
from glyphflow.sources import charset, derived, images
from glyphflow.streaming import sessions

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests

SF = "/root/testdata/sf0.001"
KIND = "array<struct<start:bigint,end:bigint,r:bigint,g:bigint,b:bigint>>"


def far(a, b):
    return sum((p - q) ** 2 for p, q in zip(a[2:], b[2:]))


def suppressed(spans):
    if len(spans) < 3:
        return spans
    mid = lambda v: sorted(v)[len(v) // 2]
    m = (0, 0, *(mid([s[k] for s in spans]) for k in (2, 3, 4)))
    d = [far(s, m) for s in spans]
    bad = [x > 6000 and (mid(d) == 0 or x > 3 * mid(d)) for x in d]
    out, i = list(spans), 0
    while i < len(out):
        left, right = i > 0, i + 1 < len(out)
        if not bad[i] or not (left or right) or (left and right and far(out[i - 1], out[i + 1]) > 4000):
            i += 1
        else:
            if left and (not right or far(out[i], out[i - 1]) <= far(out[i], out[i + 1])):
                out[i - 1] = (out[i - 1][0], out[i][1], *out[i - 1][2:])
            else:
                out[i + 1] = (out[i][0], *out[i + 1][1:])
            del out[i], bad[i]
    return out


def merged(spans):
    out = []
    for s in spans:
        if out and far(out[-1], s) <= 2000:
            p = out[-1]
            a, b = p[1] - p[0], s[1] - s[0]
            if a + b:
                out[-1] = (p[0], s[1], *(int((x * a + y * b) / (a + b) + 0.5) for x, y in zip(p[2:], s[2:])))
        else:
            out.append(s)
    return out


def char_spans(segments, chars, axis):
    out = []
    for s, e in segments:
        a, b = (min(chars, int(chars * v / axis + 0.5)) for v in (s, e))
        a = max(a, out[-1][1] if out else 0)
        if a < chars:
            out.append((a, min(chars, max(b, a + 1))))
    return out


def test_spans(spark):
    r = random.Random(2)
    rows = [(i, [(3 * k, 3 * k + r.choice([0, 3, 3]), *(r.choice([0, 40, 60, 128, 250]) for _ in range(3))) for k in range(r.randrange(1, 9))]) for i in range(200)]
    rows += [(900, [(0, 5, 100, 100, 100), (5, 10, 105, 100, 100)]), (901, [(0, 2, 250, 0, 0), (2, 4, 0, 0, 0), (4, 6, 250, 0, 0)])]
    d = spark.createDataFrame(rows, f"id long, spans {KIND}")
    got = {x.id: [tuple(s) for s in x.spans] for x in colour.suppress_outliers(d, "spans").collect()}
    assert got == {i: suppressed(s) for i, s in rows}
    got = {x.id: [tuple(s) for s in x.m] for x in d.select("id", colour.merge_similar(F.col("spans")).alias("m")).collect()}
    assert got == {i: merged(s) for i, s in rows}
    assert got[900] == [(0, 10, 103, 100, 100)]
    segs = [(i, sorted((a := r.randrange(25), a + r.randrange(1, 4)) for _ in range(5))) for i in range(100)]
    s = spark.createDataFrame(segs, "id long, s array<struct<start:bigint,end:bigint>>")
    assert {x.id: [tuple(v) for v in x.c] for x in s.select("id", colour.char_spans(F.col("s"), 12, 25).alias("c")).collect()} == {i: char_spans(v, 12, 25) for i, v in segs}


def test_components():
    r = np.random.default_rng(3)
    for _ in range(30):
        m = r.random((r.integers(1, 12), r.integers(1, 12))) > 0.45
        want, w = np.full(m.shape, -1), m.shape[1]
        for y, x in np.argwhere(m):
            if want[y, x] < 0:
                todo = [(y, x)]
                while todo:
                    a, b = todo.pop()
                    if 0 <= a < m.shape[0] and 0 <= b < w and m[a, b] and want[a, b] < 0:
                        want[a, b] = y * w + x
                        todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
        assert (grid.components(m) == want).all()


def test_detection():
    p = np.zeros((64, 64), np.float32)
    p[20:30, 5:55] = 0.8
    (quad, score), = grid.detected(p)
    assert score == pytest.approx(0.8) and quad[0][0] < 5 and quad[0][1] < 20 and quad[2][0] > 54 and quad[2][1] > 29
    small = np.zeros((64, 64), np.float32)
    small[1:4, 1:4] = 0.9
    assert grid.detected(small) == [] and grid.detected(p * 0.4) == []
    two = np.zeros((128, 128), np.float32)
    two[10:20, 10:100], two[60:75, 10:100] = 0.9, 0.9
    assert len(grid.detected(two)) == 2
    grown = grid.unclip([(0, 0), (10, 0), (10, 4), (0, 4)], 1.5)
    d = 60 / 28
    assert np.allclose(grown, [(-d, -d), (10 + d, -d), (10 + d, 4 + d), (-d, 4 + d)])
    rect, area = grid.min_area_rect([(0, 0), (2, 2), (4, 0), (2, -2), (2, 0)])
    assert area == pytest.approx(8) and len(rect) == 4
    assert grid.hull([(0, 0), (1, 0), (2, 0), (2, 2), (0, 2), (1, 1)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    assert grid.hull([(0.01, 0.01), (0.0, 0.0), (2, 0), (2, 2), (2.05, 2.05)]) == [(0.01, 0.01), (2, 0), (2, 2)]  # the first of a tenth counts


def test_rasters():
    a = np.arange(10, 70, 10, dtype=np.uint8).reshape(3, 2, 1).repeat(3, axis=2)
    assert raster.rotate_ccw(a)[..., 0].tolist() == [[20, 40, 60], [10, 30, 50]]
    solid = np.full((4, 4, 3), 77, np.uint8)
    assert (raster.resize(solid, 9, 3) == 77).all()
    ramp = (np.arange(10)[None, :, None] * 25 * np.ones((4, 1, 3))).astype(np.uint8)
    assert raster.resize(ramp, 5, 4)[0, :, 0].tolist() == [0, 50, 100, 150, 200]
    assert (raster.warp(ramp, np.array([(0, 0), (9, 0), (9, 3), (0, 3)]), 10, 4) == ramp).all()
    assert (raster.warp(ramp, np.array([(20, 20), (30, 20), (30, 30), (20, 30)]), 3, 3) == 255).all()
    h = raster.homography([(0, 0), (2, 0), (2, 1), (0, 1)], [(1, 1), (5, 2), (6, 7), (0, 5)])
    assert np.allclose([(v := h @ (x, y, 1))[:2] / v[2] for x, y in ((0, 0), (2, 0), (2, 1), (0, 1))], [(1, 1), (5, 2), (6, 7), (0, 5)])
    t, w, hh = raster.detector_input(np.zeros((100, 2560, 3), np.uint8))
    assert t.shape == (1, 3, 64, 1280) and (w, hh) == (1280, 50)
    assert raster.layout_input(solid)["image"].shape == (1, 3, 800, 800)
    part = raster.cropped_quad(ramp, [(1, 0), (5, 0), (5, 3), (1, 3)])
    assert part.shape == (23, 24, 3) and part[0, 0, 0] == 255 and part[10, 10, 0] == 25


def test_images(spark, tmp_path):
    r = np.random.default_rng(4)
    a = r.integers(0, 256, (7, 5, 3)).astype(np.uint8)
    raw = images.encode_png(a)
    assert (images.decode(raw) == a).all()
    for bad in (b"", b"nothing", raw[:40], raw[:8]):
        with pytest.raises(ValueError):
            images.decode(bad)
    body = b"--q\r\nContent-Disposition: form-data; name=\"image\"\r\n\r\n" + raw + b"\r\n--q--\r\n"
    url = images.data_url(raw)
    rows = [(1, "application/json", json.dumps({"image": url}).encode()), (2, 'multipart/form-data; boundary="q"', body), (3, "application/json", b'{"image": "?"}'), (4, None, b""), (5, "multipart/form-data; boundary=q", b"--q--")]
    got = {x.id: (bytes(x.content) if x.content else None, x.error) for x in images.requests(spark.createDataFrame(rows, "id long, content_type string, body binary")).collect()}
    assert got[1] == (raw, None) and got[2] == (raw, None) and all(got[k] == (None, "invalid image") for k in (3, 4, 5))
    (tmp_path / "a.png").write_bytes(raw)
    assert [bytes(x.content) for x in images.folder(spark, str(tmp_path)).collect()] == [raw]


def test_charset(tmp_path):
    assert charset.varint(b"\x01", 0) == (1, 1) and charset.varint(b"\xac\x02", 0) == (300, 2)
    for bad in (b"\xff", b"\xff" * 11):
        with pytest.raises(ValueError):
            charset.varint(bad, 0)
    entry = b"\x0a\x09character\x12\x05A\nB\nC"
    model = b"\x08\x07\x72" + bytes([len(entry)]) + entry
    assert charset.metadata(model) == {"character": "A\nB\nC"}
    (tmp_path / "m.onnx").write_bytes(model)
    assert charset.ensure(str(tmp_path / "d.txt"), str(tmp_path / "m.onnx")) == ["", "A", "B", "C", " "] == charset.load(str(tmp_path / "d.txt"))


class Fake:
    """A session that answers every input alike."""

    def __init__(self, answer):
        self.answer = answer

    def get_inputs(self):
        return []

    def run(self, names, tensors):
        return [self.answer]


class Map(Fake):
    def __init__(self):
        p = np.zeros((32, 64), np.float32)
        p[4:12, 4:40], p[20:28, 4:40] = 0.9, 0.9
        self.answer = p


def test_workflow(spark):
    scores = np.full((1, 3, 4), 0.05)
    scores[0, 0, 1], scores[0, 1, 0], scores[0, 2, 2] = 0.9, 0.9, 0.4
    options = [W.with_workflow("lines"), W.with_model("text", session=Map()), W.with_model("turned", session=Fake(np.array([0.05, 0.95]))), W.with_model("ctc", session=Fake(scores), charset=["", "a", "b"]), W.with_merge(max_distance=1)]
    e = W.Engine(*options)
    lines = e.run(np.zeros((32, 64, 3), np.uint8))
    assert [t for _, t, *_ in lines] == ["ab ab"]  # two bands, grown until they meet
    assert lines[0][2] == pytest.approx((0.9 * 0.4) ** 0.5)
    png = images.encode_png(np.zeros((32, 64, 3), np.uint8))
    d = spark.createDataFrame([("a", png), ("b", b"junk"), ("c", png)], "name string, content binary")
    got = e.transform(d, "name").collect()
    assert {x.key for x in got if x.error} == {"b"} and {x.text for x in got if x.key == "a"} == {"ab ab"}
    with pytest.raises(ValueError):
        W.Engine(W.with_workflow("none"))
    whole = W.Engine(W.with_workflow("whole")).run(np.zeros((4, 6, 3), np.uint8))
    assert whole[0][0].quad == [(0, 0), (5, 0), (5, 3), (0, 3)] and W.Engine(W.with_workflow("whole")).detect(np.zeros((0, 0, 3), np.uint8)) == []


def test_failures_of_stages():
    class Broken:
        def classify(self, *_):
            raise RuntimeError

        def recognise(self, image, quad):
            if quad[0] != (0, 0):
                raise RuntimeError
            return "kept", 0.5

    W.STAGES["broken"] = Broken
    W.workflow("broken", detect="whole", classify="broken", recognise="broken")
    assert W.Engine(W.with_workflow("broken")).run(np.zeros((3, 3, 3), np.uint8))[0][1] == "kept"
    send = lambda body: (200, {"choices": [{"message": {"content": " hi "}}]}) if body["messages"][1]["content"][0]["image_url"]["url"].startswith("data:image/png;base64,") else (400, {})
    quad, page = [(0, 0), (9, 0), (9, 4), (0, 4)], np.zeros((5, 10, 3), np.uint8)
    assert W.Remote(send).recognise(page, quad) == (" hi ", 1.0)
    for bad in ((500, {}), (200, {"choices": []})):
        with pytest.raises(ValueError):
            W.Remote(lambda body, bad=bad: bad).recognise(page, quad)


def test_merges():
    box = lambda x, y, w, h, s=1.0: W.Box([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], s)
    out = W.Proximity().merge([box(0, 0, 100, 10, 0.7), box(0, 12, 100, 10), box(0, 90, 100, 10)])
    assert [len(b.children) for b in out] == [2, 1] and out[0].quad[2] == (100, 22) and out[0].score == 0.7
    h = W.Hierarchical(lambda image: [box(0, 0, 100, 100), box(300, 0, 100, 100)])
    got = h.merge([box(15, 0, 100, 100), box(50, 0, 100, 100), box(5, 5, 0, 9)])
    assert [(b.quad[0], len(b.children)) for b in got] == [((0, 0), 1), ((50, 0), 1)]


def test_layout_rows():
    rows = np.array([(1, 0.8, 10, 10, 50, 50, 5), (2, 0.9, 60, 10, 90, 50, 2), (0, 0.3, 1, 1, 2, 2, 9), (1, 0.2, 0, 0, 1, 1, 1), (0, 0.9, -20, -10, 150, 130, 0)], np.float32)
    got = W.LayoutDetector(session=Fake(rows)).detect(np.zeros((100, 100, 3), np.uint8))
    assert [(b.class_id, b.read_order) for b in got] == [(0, 0), (2, 2), (1, 5), (0, 9)] and got[0].quad == [(0, 0), (99, 0), (99, 99), (0, 99)]


def test_responses(spark):
    d = spark.createDataFrame([(1, 2, "b", 0.5, 0, 0, 2, 1), (1, 1, "a", 0.25, 0, 0, 2, 1)], "image_id long, line long, text string, score double, x0 long, y0 long, x1 long, y1 long")
    body = json.loads(W.responses(d).first().body)
    assert body["text"] == "a\nb" and body["lines"][0] == {"text": "a", "score": 0.25, "box": [[0, 0], [2, 0], [2, 1], [0, 1]]}


def test_sessions(spark, tmp_path):
    log = derived.session_log(spark, SF)
    want = {(x.session_id, x.event_id): (x.found, x.value) for x in sessions.replay(log).collect()}
    live, seen = {}, {}
    for r in log.orderBy("ts", "event_id").collect():
        if r.op == "create":
            live[r.session_id] = r.payload
        elif r.op == "delete":
            live.pop(r.session_id, None)
        seen[r.session_id, r.event_id] = (r.op != "get" or r.session_id in live, live.get(r.session_id))
    assert want == seen
    assert {x.session_id: x.payload for x in sessions.current(log).collect()} == live
    log.repartition(1).write.parquet(str(tmp_path / "log"))
    s = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    q = sessions.stream(s).writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(x.session_id, x.event_id): (x.found, x.value) for x in spark.table("seen").collect()}
    assert got == seen
    assert spark.readStream and sessions.arriving(spark, str(tmp_path)).isStreaming


def test_boxes_of_many_images_are_not_broadcast(spark):
    """A plan takes three boxes exploded from a literal for the size of one row; the larger the table, the more the driver held."""
    from glyphflow.operators import boxes as B

    one = spark.range(400).select(F.col("id").alias("image_id"), F.lit(0).cast("long").alias("x0"), F.lit(0).cast("long").alias("y0"))
    box = lambda k, w, h: one.select("image_id", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias(k), "x0", "y0", F.lit(w).cast("long").alias("x1"), F.lit(h).cast("long").alias("y1"))
    out = B.hierarchical(box("box_id", 30, 10), box("parent_id", 90, 60))
    assert "Broadcast" not in out._jdf.queryExecution().optimizedPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["image_id"], r["parent_id"], r["box_id"], r["n"], r["seq"]) for r in out.collect()) == [(i, 1, None, 2, 1) for i in range(400)]
