"""What the stages send to their models, with sessions that keep their tensors."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from glyphflow.operators import raster
from glyphflow.plans import workflow as W

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests


class Kept:
    """A session that remembers what it was asked."""

    def __init__(self, answer):
        self.answer, self.asked = answer, []

    def get_inputs(self):
        return [type("Input", (), {"name": n}) for n in ("a", "b", "c")]

    def run(self, names, tensors):
        self.asked.append(list(tensors.values()))
        return [self.answer(*tensors.values()) if callable(self.answer) else self.answer]


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


RAMP = (np.arange(60)[None, :, None] * 4 + np.zeros((40, 1, 3))).astype(np.uint8)


def test_line_recogniser_input():
    s = Kept(np.zeros((1, 4, 3)))
    stage = W.Ctc(session=s, charset=["", "a", "b"])
    stage.recognise(RAMP, box(0, 0, 40, 10))
    x = s.asked[0][0]
    assert x.shape == (1, 3, 48, 192) and x.dtype == np.float32
    # Scaled to -1 .. 1, dark at the left; a quad given from its lower right corner on is read the same way round.
    assert x[0, 0, 0, 0] == pytest.approx(-1) and x[0, 0, 0, -1] == pytest.approx(160 / 255 * 2 - 1, abs=0.02)
    stage.recognise(RAMP, box(0, 0, 40, 10)[2:] + box(0, 0, 40, 10)[:2])
    assert (s.asked[1][0] == x).all()
    stage.recognise(RAMP, box(0, 0, 10, 39))  # upright: 48 * 39 / 10 = 187.2, turned to the left
    assert s.asked[2][0].shape == (1, 3, 48, 187) and s.asked[2][0][0, 0, -1, 0] == pytest.approx(-1, abs=0.03)
    stage.recognise(RAMP, box(0, 0, 32, 33))  # 48 * 33 / 32 = 49.5, halves go up
    assert s.asked[3][0].shape == (1, 3, 48, 50)
    for flat in ([(5, 0), (5, 0), (5, 9), (5, 9)], [(0, 0), (4, 4), (8, 8), (0, 8)], [(3, 3)] * 4):
        with pytest.raises(ValueError):
            raster.line_crop(RAMP, flat)


def test_a_quad_without_area_costs_its_own_line_only():
    class Mixed:
        def detect(self, image):
            return [W.Box(box(0, 0, 40, 10)), W.Box([(5, 0), (5, 0), (5, 9), (5, 9)]), W.Box(box(0, 20, 40, 30))]

    scores = np.full((1, 4, 3), 0.1)
    scores[0, :, 1] = 0.9
    W.STAGES["mixed"] = Mixed
    W.workflow("mixed", detect="mixed", classify="turned", recognise="ctc")
    lines = W.Engine(W.with_workflow("mixed"), W.with_model("turned", session=Kept(np.array([[0.9, 0.05]]))), W.with_model("ctc", session=Kept(scores), charset=["", "a", "b"])).run(RAMP)
    assert [(b.quad[0], t) for b, t, *_ in lines] == [((0, 0), "a"), ((0, 20), "a")]


def test_classifier_input_and_threshold():
    s = Kept(np.array([[0.05, 0.85]]))
    assert W.Turned(session=s).classify(RAMP, box(0, 0, 20, 10)) is False and s.asked[0][0].shape == (1, 3, 80, 160)
    assert W.Turned(session=s, threshold=0.8).classify(RAMP, box(0, 0, 20, 10)) is True
    assert s.asked[0][0][0, 1, 0, 0] == pytest.approx(-0.456 / 0.224, abs=1e-4)


def test_layout_input_is_normalised():
    x = raster.layout_input(np.full((10, 20, 3), 255, np.uint8))
    assert x["image"].shape == (1, 3, 800, 800) and x["scale_factor"].tolist() == [[80.0, 40.0]]
    assert [float(v) for v in x["image"][0, :, 5, 5]] == pytest.approx([(1 - m) / d for m, d in zip(raster.MEAN, raster.STD)], abs=1e-5)


def test_remote_request():
    sent = []
    send = lambda body: (sent.append(body), (200, {"choices": [{"message": {"content": " two\nlines "}}]}))[1]
    assert W.Remote(send, model="m").recognise(RAMP, box(2, 3, 22, 10)) == (" two\nlines ", 1.0)
    system, user = sent[0]["messages"]
    assert system == {"role": "system", "content": ""} and user["content"][1] == {"type": "text", "text": "Text Recognition:"}
    from glyphflow.sources import images

    import base64

    crop = images.decode(base64.b64decode(user["content"][0]["image_url"]["url"].split(",")[1]))
    assert crop.shape == (7, 20, 3)
    assert raster.region_crop(RAMP, box(0, 0, 5, 30)).shape == (30, 5, 3)  # not turned


class Two:
    def detect(self, image):
        return [W.Box(box(0, 0, 20, 10), 0.9), W.Box(box(0, 12, 20, 22), 0.7, 4), W.Box(box(0, 35, 30, 39), 0.8, 5)]


class Sizes:
    def __init__(self):
        self.calls = 0

    def recognise(self, image, quad):
        self.calls += 1
        return f"{quad[2][0] - quad[0][0]}x{quad[2][1] - quad[0][1]}", 0.5


class Regions(Sizes):
    lines_only = False


def test_parents_are_read_once_by_a_region_recogniser():
    W.STAGES.update(two=Two, sizes=Sizes, regions=Regions)
    W.workflow("by_line", detect="two", merge="proximity", recognise="sizes")
    W.workflow("by_region", detect="two", merge="proximity", recognise="regions")
    lines = W.Engine(W.with_workflow("by_line"), W.with_merge(max_distance=5)).run(RAMP)
    assert [(t, len(k)) for _, t, _, k in lines] == [("20x10 20x10", 2), ("30x4", 1)]
    # A cluster of one is the bounds of its child, of no class.
    assert [(b.class_id, b.score, len(b.children)) for b, *_ in lines] == [(-1, 0.9, 2), (-1, 0.8, 1)]
    whole = W.Engine(W.with_workflow("by_region"), W.with_merge(max_distance=5))
    assert [(t, k) for _, t, _, k in whole.run(RAMP)] == [("20x22", []), ("30x4", [])] and whole.parts["recognise"].calls == 2


def test_turned_quad_is_in_the_result(spark):
    from glyphflow.sources import images

    class Always:
        def classify(self, image, quad):
            return True

    W.STAGES.update(two=Two, sizes=Sizes, always=Always)
    W.workflow("turning", detect="two", classify="always", recognise="sizes")
    first = W.Engine(W.with_workflow("turning")).run(RAMP)[0]
    assert first[0].quad == [(20, 10), (0, 10), (0, 0), (20, 0)] and first[1] == "-20x-10"
    W.workflow("turning_lines", detect="two", merge="proximity", classify="always", recognise="sizes")
    d = spark.createDataFrame([("p", bytearray(images.encode_png(RAMP)))], "name string, content binary")
    rows = W.Engine(W.with_workflow("turning_lines"), W.with_merge(max_distance=5)).transform(d, "name").orderBy("parent").collect()
    assert [len(r.children) for r in rows] == [2, 1] and rows[0].children[0].box == [[20, 10], [0, 10], [0, 0], [20, 0]] and rows[0].x0 == 0


def test_batched_lines_equal_single_ones():
    def model(x):
        """Two steps to every eight columns: a class by their mean."""
        v = x[:, 0, :, :].mean(axis=1)
        v = v[:, : v.shape[1] // 4 * 4].reshape(len(x), -1, 4).mean(axis=2)
        return np.stack([np.full(v.shape, 0.3), v + 1, 1 - v], axis=-1) / 3

    quads = [box(0, 0, 40, 10), box(5, 5, 45, 15), box(0, 0, 30, 10), box(3, 0, 43, 10), box(0, 0, 28, 30), box(50, 1, 59, 30)]
    one, many, padded = (Kept(model) for _ in range(3))
    want = [W.Ctc(session=one, charset=["", "a", "b"]).recognise(RAMP, q) for q in quads]
    assert W.Ctc(session=many, charset=["", "a", "b"]).recognise_all(RAMP, quads) == want
    assert len(one.asked) == 6 and len(many.asked) == len({x[0].shape[3] for x in one.asked}) == 4
    got = W.Ctc(session=padded, charset=["", "a", "b"]).recognise_all(RAMP, quads, pad=256)
    assert len(padded.asked) == 1 and padded.asked[0][0].shape == (6, 3, 48, 256) and [t for t, _ in got] == [t for t, _ in want]


def test_colours_in_the_answer(spark):
    import json

    from pyspark.sql import functions as F

    from glyphflow.sources import images

    class Words:
        def detect(self, image):
            return [W.Box(box(5, 5, 45, 15)), W.Box(box(5, 25, 45, 35)), W.Box(box(90, 90, 95, 95))]

    class Read:
        def recognise(self, image, quad):
            return ("ab cd" if quad[0][1] < 20 else "plain"), 0.5

    page = np.full((40, 60, 3), 255, np.uint8)
    page[7:13, 7:15], page[7:13, 25:35], page[27:33, 8:40] = (250, 0, 0), (0, 0, 250), (0, 0, 0)
    W.STAGES.update(words=Words, read=Read)
    W.workflow("words", detect="words", recognise="read")
    frames = spark.createDataFrame([("p", bytearray(images.encode_png(page))), ("q", bytearray(b"junk"))], "name string, content binary")
    lines = W.Engine(W.with_workflow("words")).transform(frames, "name")
    assert all(r.elapsed_ms >= 0 for r in lines.collect())
    got = {(r.key, r.parent): r for r in W.coloured(lines, frames, "name").collect()}
    assert got["p", 0].text_color == [0, 0, 250] and [tuple(w) for w in got["p", 0].word_colors] == [(0, 1, [250, 0, 0]), (3, 4, [0, 0, 250])]
    assert got["p", 1].text_color == [0, 0, 0] and got["p", 1].word_colors is None and got["p", 2].text_color is None and got["q", None].status == 400
    shown = W.coloured(lines, frames, "name").where("parent is not null").select(F.col("key").alias("image_id"), F.col("parent").alias("line"), "text", "score", "x0", "y0", F.col("x2").alias("x1"), F.col("y2").alias("y1"), "text_color", "word_colors")
    body = json.loads(W.responses(shown).first().body)["lines"]
    assert body[0]["word_colors"][1] == {"start": 3, "end": 4, "color": [0, 0, 250]} and "word_colors" not in body[1] and "text_color" not in body[2]
