"""The page pipeline: stages by name, workflows made of them, an engine that runs one over a frame of images, and its results as JSON.

A stage is any object with the method of its kind (``detect``, ``classify``, ``recognise``, ``merge``) on one image in numpy;
it is built once in every Python worker from its factory and settings. Images are rows, so a workflow is one Arrow-batched
pass over them without a shuffle.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import colour, raster
from ..sources import images

LINE = "parent long, x0 long, y0 long, x1 long, y1 long, x2 long, y2 long, x3 long, y3 long, text string, score double, class_id long, read_order long"
CHILDREN = "array<struct<box:array<array<bigint>>,text:string,score:double>>"
Quad = list[tuple[int, int]]


@dataclass(frozen=True)
class Box:
    """A found region: corners from the top left on, score, class and place in reading order (-1: none), and boxes inside."""

    quad: Quad
    score: float = 1.0
    class_id: int = -1
    read_order: int = -1
    children: tuple["Box", ...] = ()


@dataclass(frozen=True)
class Config:
    """Settings of an engine; ``models`` holds the settings of single stages by name."""

    workflow: str = "lines"
    models: dict[str, dict[str, Any]] = field(default_factory=dict)
    merge: dict[str, Any] = field(default_factory=lambda: {"strategy": "proximity", "min_overlap": 0.8, "max_distance": 10, "max_size_ratio": 1.5})


Option = Callable[[Config], Config]


def with_model(name: str, **settings: Any) -> Option:
    return lambda c: replace(c, models={**c.models, name: {**c.models.get(name, {}), **settings}})


def with_workflow(name: str) -> Option:
    return lambda c: replace(c, workflow=name)


def with_merge(**settings: Any) -> Option:
    return lambda c: replace(c, merge={**c.merge, **settings})


STAGES: dict[str, Callable[..., Any]] = {}
WORKFLOWS: dict[str, dict[str, str]] = {}


def stage(name: str):
    """Registers the factory of a stage."""

    def put(factory):
        STAGES[name] = factory
        return factory

    return put


def workflow(name: str, **parts: str) -> None:
    """Registers a workflow: names of its stages by kind (detect, merge, classify, recognise)."""
    WORKFLOWS[name] = parts


def setting(name: str, default: str = "") -> str:
    """A variable of the environment; empty counts as unset."""
    return os.environ.get(name) or default


def model_file(name: str, folder: str | None = None) -> str:
    """Where a model lies: MODELS_DIR, ``models`` here, ``models`` in a folder above that has one; else the bare name."""
    here = os.getcwd()
    above = []
    while True:
        above.append(os.path.join(here, "models"))
        if os.path.dirname(here) == here:
            break
        here = os.path.dirname(here)
    for root in [folder or setting("MODELS_DIR"), *above]:
        if root and os.path.isfile(os.path.join(root, name)):
            return os.path.join(root, name)
    return name


@stage("whole")
class Whole:
    """Detector that takes the image as one box."""

    def detect(self, image: np.ndarray) -> list[Box]:
        h, w = image.shape[:2]
        return [Box([(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)])] if h and w else []


class Onnx:
    """An ONNX model, its session opened at first use and once in every worker."""

    def __init__(self, model: str, session: Any = None):
        self.model, self._session = model, session

    @property
    def session(self):
        if self._session is None:
            import onnxruntime

            self._session = onnxruntime.InferenceSession(model_file(self.model), providers=["CPUExecutionProvider"])
        return self._session

    def run(self, *tensors: np.ndarray) -> list[np.ndarray]:
        names = [i.name for i in self.session.get_inputs()]
        return self.session.run(None, dict(zip(names, tensors)))


@stage("text")
class TextDetector(Onnx):
    """Probability map of text, made to quads."""

    def __init__(self, model: str = "det.onnx", session: Any = None, longest: int = 1280, **post: Any):
        super().__init__(model, session)
        self.longest, self.post = longest, post

    def detect(self, image: np.ndarray) -> list[Box]:
        from ..operators.grid import detected

        h, w = image.shape[:2]
        if not h or not w:
            return []
        tensor, rw, rh = raster.detector_input(image, self.longest)
        p = np.asarray(self.run(tensor)[0], np.float32).reshape(tensor.shape[2:])[:rh, :rw]
        return [Box(q, s) for q, s in detected(p, w / rw, h / rh, w, h, **self.post)]


@stage("layout")
class LayoutDetector(Onnx):
    """Regions of a page: rows of label, score, x0, y0, x1, y1, place in reading order."""

    def __init__(self, model: str = "layout.onnx", session: Any = None, least: float = 0.3, size: int = 800, mean=raster.MEAN, std=raster.STD):
        super().__init__(model, session)
        self.least, self.input = least, (size, mean, std)

    def detect(self, image: np.ndarray) -> list[Box]:
        h, w = image.shape[:2]
        if not h or not w:
            return []
        t = raster.layout_input(image, *self.input)
        rows = np.asarray(self.run(t["im_shape"], t["image"], t["scale_factor"])[0], np.float32).reshape(-1, 7)
        out = []
        for k in np.argsort(rows[:, 6], kind="stable"):
            label, score, *box, order = rows[k].tolist()
            if np.float32(score) < np.float32(self.least):
                continue
            x0, y0, x1, y1 = (min(max(int(v), 0), max(top - 1, 0)) for v, top in zip(box, (w, h, w, h)))
            out.append(Box([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], score, int(label), int(order)))
        return out


@stage("turned")
class Turned(Onnx):
    """Whether a line stands on its head."""

    def __init__(self, model: str = "cls.onnx", session: Any = None, height: int = 80, width: int = 160, threshold: float = 0.9):
        super().__init__(model, session)
        self.size, self.least = (width, height), threshold

    def classify(self, image: np.ndarray, quad: Quad) -> bool:
        logits = np.asarray(self.run(raster.nchw(raster.warp(image, np.array(quad), *self.size)))[0]).ravel()
        return len(logits) > 1 and bool(logits[1] > logits[0] and logits[1] > self.least)


@stage("ctc")
class Ctc(Onnx):
    """Text of a line from class scores by time step."""

    lines_only = True

    def __init__(self, model: str = "rec.onnx", session: Any = None, charset: list[str] | None = None, height: int = 48, mean=(0.5, 0.5, 0.5), std=(0.5, 0.5, 0.5)):
        super().__init__(model, session)
        self.charset, self.height, self.scale = charset or [""], height, (mean, std)

    def tensor(self, image: np.ndarray, quad: Quad) -> np.ndarray:
        return raster.nchw(raster.line_crop(image, quad, self.height), *self.scale)

    def recognise(self, image: np.ndarray, quad: Quad) -> tuple[str, float]:
        p = np.asarray(self.run(self.tensor(image, quad))[0], float)
        return decoded(p.reshape(-1, p.shape[-1]), self.charset)

    def recognise_all(self, image: np.ndarray, quads: list[Quad], pad: int = 1) -> list[tuple[str, float]]:
        """The same for many lines, one call for those of one width, rounded up to ``pad``. The padding is grey, and what the model says
        beyond a line's own share of the time steps is cut off; without padding (the default) nothing differs from single calls."""
        tensors = [self.tensor(image, q) for q in quads]
        by: dict[int, list[int]] = {}
        for k, t in enumerate(tensors):
            by.setdefault(-(-t.shape[3] // pad) * pad, []).append(k)
        out: list[tuple[str, float]] = [("", 0.0)] * len(quads)
        for width, ks in by.items():
            batch = np.zeros((len(ks), 3, self.height, width), np.float32)
            for row, k in zip(batch, ks):
                row[:, :, : tensors[k].shape[3]] = tensors[k][0]
            p = np.asarray(self.run(batch)[0], float)
            if len(p) != len(ks):
                raise ValueError("the model takes single lines only")
            for scores, k in zip(p, ks):
                out[k] = decoded(scores[: max(1, -(-len(scores) * tensors[k].shape[3] // width))], self.charset)
        return out


def decoded(p: np.ndarray, charset: list[str]) -> tuple[str, float]:
    """Text and mean score (geometric) of T x C scores: repeats and class 0 collapse, classes without a character are skipped."""
    best, last, text, logs = p.argmax(axis=1), -1, [], []
    for t, c in enumerate(best.tolist()):
        if c and c != last and c < len(charset):
            text.append(charset[c])
            logs.append(np.log(p[t, c]) if p[t, c] > 0 else 0.0)
        last = c
    return "".join(text), float(np.exp(sum(logs) / len(logs))) if logs else 0.0


@stage("remote")
class Remote:
    """Recogniser behind a chat service: the crop goes as a data URL, ``send`` (request body to response status and body) is given."""

    lines_only = False  # it reads regions of many lines

    def __init__(self, send: Callable[[dict], tuple[int, dict]], model: str = "", system: str = "", prompt: str = "Text Recognition:"):
        self.send, self.model, self.system, self.prompt = send, model, system, prompt

    def recognise(self, image: np.ndarray, quad: Quad) -> tuple[str, float]:
        url = images.data_url(images.encode_png(raster.region_crop(image, quad)))
        asked = [{"type": "image_url", "image_url": {"url": url}}, {"type": "text", "text": self.prompt}]
        status, got = self.send({"model": self.model, "messages": [{"role": "system", "content": self.system}, {"role": "user", "content": asked}]})
        if status != 200:
            raise ValueError(f"status {status}")
        if not got.get("choices"):
            raise ValueError("no choices")
        return got["choices"][0]["message"]["content"], 1.0


@stage("proximity")
class Proximity:
    """Lines from boxes near each other: the bounds of every cluster, even of one box, which become its children in reading order."""

    def __init__(self, max_distance: float = 10, max_size_ratio: float = 1.5, **_: Any):
        self.far, self.ratio = max_distance, max_size_ratio

    def merge(self, boxes: list[Box]) -> list[Box]:
        from ..operators.boxes import _labels

        ends = [_ends(b.quad) for b in boxes]
        label = _labels(*([e[k] for e in ends] for k in range(4)), list(range(len(boxes))), self.far, self.ratio)
        groups: dict[int, list[int]] = {}
        for k, c in enumerate(label):
            groups.setdefault(c, []).append(k)
        out = []
        for ks in groups.values():
            x0, y0, x1, y1 = ends[ks[0]]
            order = sorted(ks, key=lambda k: _order(ends[k], y1 - y0 > x1 - x0))
            kids = [boxes[k] for k in order]
            x0, y0, x1, y1 = (f(ends[k][i] for k in ks) for i, f in enumerate((min, min, max, max)))
            out.append(Box([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], kids[0].score, children=tuple(kids)))
        return sorted(out, key=lambda b: _order(_ends(b.quad), False))


@stage("hierarchical")
class Hierarchical:
    """Boxes put under the regions of a layout; a box of no region stands alone after them, regions without boxes go."""

    def __init__(self, parents: Callable[[np.ndarray], list[Box]] | None = None, min_overlap: float = 0.8, **_: Any):
        self.parents, self.least = parents, min_overlap

    def merge(self, boxes: list[Box], image: np.ndarray | None = None) -> list[Box]:
        regions = self.parents(image) if self.parents else []
        kids: dict[int, list[Box]] = {}
        alone = []
        for b in boxes:
            x0, y0, x1, y1 = _ends(b.quad)
            area, best = (x1 - x0) * (y1 - y0), None
            if x1 <= x0 or y1 <= y0:
                continue
            for k, p in enumerate(regions):
                a0, b0, a1, b1 = _ends(p.quad)
                if (y1 - y0 > x1 - x0) != (b1 - b0 > a1 - a0):
                    continue
                over = max(0, min(x1, a1) - max(x0, a0)) * max(0, min(y1, b1) - max(y0, b0))
                if over >= self.least * area and (best is None or over > best[0]):
                    best = over, k
            if best:
                kids.setdefault(best[1], []).append(b)
            else:
                alone.append(b)
        return [replace(p, children=tuple(kids[k])) for k, p in enumerate(regions) if k in kids] + [replace(b, children=(b,)) for b in alone]


workflow("whole", detect="whole")
workflow("layout", detect="layout")
workflow("lines", detect="text", merge="proximity", classify="turned", recognise="ctc")
workflow("remote", detect="text", merge="proximity", recognise="remote")


def _ends(quad: Quad) -> tuple[int, int, int, int]:
    xs, ys = [x for x, _ in quad], [y for _, y in quad]
    return min(xs), min(ys), max(xs), max(ys)


def _order(ends: tuple[int, int, int, int], down: bool) -> tuple[int, int]:
    cx, cy = int((ends[0] + ends[2]) / 2), int((ends[1] + ends[3]) / 2)
    return (-cx, cy) if down else (cy, cx)


class Engine:
    """A workflow over frames of images. ``Engine(with_workflow("lines"), with_model("ctc", charset=[...]))``."""

    def __init__(self, *options: Option):
        config = Config()
        for o in options:
            config = o(config)
        if config.workflow not in WORKFLOWS:
            raise ValueError(f"unknown workflow {config.workflow}; there are {', '.join(sorted(WORKFLOWS))}")
        self.config, self._built = config, None
        names = dict(WORKFLOWS[config.workflow])
        if "merge" in names:
            names["merge"] = config.merge.get("strategy", names["merge"])
        # Factories and settings by kind go along, so stages that are registered here only are known to workers.
        own = lambda kind, name: {k: v for k, v in (config.merge if kind == "merge" else {}).items() if k != "strategy"} | config.models.get(name, {})
        self._stages = {kind: (STAGES[name], own(kind, name)) for kind, name in names.items()}

    def __getstate__(self):  # stages are built anew where the engine arrives
        return {**self.__dict__, "_built": None}

    @property
    def parts(self) -> dict[str, Any]:
        if self._built is None:
            self._built = {kind: factory(**settings) for kind, (factory, settings) in self._stages.items()}
        return self._built

    def close(self) -> None:
        self._built = None

    def detect(self, image: np.ndarray) -> list[Box]:
        """What the detector finds, merged."""
        p = self.parts
        boxes = p["detect"].detect(image)
        if not boxes or "merge" not in p:
            return boxes
        return p["merge"].merge(boxes, image) if isinstance(p["merge"], Hierarchical) else p["merge"].merge(boxes)

    def _read(self, image: np.ndarray, boxes: list[Box]) -> list[tuple[Box, str, float] | None]:
        """The boxes recognised, each with the quad that was read; nothing where recognition fails or gives no text. A classifier that
        fails leaves a box as it is. A recogniser that reads many lines at once is asked once, and line by line only if that fails."""
        p, turned = self.parts, []
        for box in boxes:
            try:
                flip = "classify" in p and p["classify"].classify(image, box.quad)
            except Exception:  # noqa: BLE001
                flip = False
            turned.append(replace(box, quad=box.quad[2:] + box.quad[:2]) if flip else box)
        try:
            got = p["recognise"].recognise_all(image, [b.quad for b in turned])
        except Exception:  # noqa: BLE001
            got = [self._one(image, b.quad) for b in turned]
        return [(b, *x) if x and x[0] else None for b, x in zip(turned, got)]

    def _one(self, image: np.ndarray, quad: Quad) -> tuple[str, float] | None:
        try:
            return self.parts["recognise"].recognise(image, quad)
        except Exception:  # noqa: BLE001
            return None

    def run(self, image: np.ndarray) -> list[tuple[Box, str, float, list[tuple[Box, str, float]]]]:
        """Lines of an image: box, text, score, and its recognised children. A box with children is read child by child, unless the
        recogniser reads regions of many lines."""
        boxes = self.detect(image)
        if "recognise" not in self.parts:
            return [(b, "", b.score, []) for b in boxes]
        parted = getattr(self.parts["recognise"], "lines_only", True)
        asked = [list(b.children) if parted and b.children else [b] for b in boxes]
        read = iter(self._read(image, [b for bs in asked for b in bs]))
        out = []
        for box, bs in zip(boxes, asked):
            kids = [x for x in (next(read) for _ in bs) if x]
            if kids and bs[0] is box:
                out.append((*kids[0], []))
            elif kids:
                out.append((box, " ".join(t for _, t, _ in kids), sum(s for *_, s in kids) / len(kids), kids))
        return out

    def _over(self, frames: DataFrame, key: str, content: str, lines: Callable[[np.ndarray], list[tuple]]) -> DataFrame:
        schema = f"key string, status long, error string, {LINE}, children {CHILDREN}, elapsed_ms double"
        names = [x.split()[0] for x in schema.split(f", children {CHILDREN}")[0].split(", ")] + ["children", "elapsed_ms"]

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            none = (None,) * (len(names) - 4)
            for b in batches:
                out = []
                for k, raw in zip(b["key"], b["content"]):
                    start = time.perf_counter()
                    took = lambda start=start: round((time.perf_counter() - start) * 1000, 3)
                    try:
                        image = images.decode(raw)
                    except ValueError as e:
                        out.append((k, 400, str(e), *none, took()))
                        continue
                    try:
                        got = lines(image)
                    except Exception as e:  # noqa: BLE001
                        out.append((k, 500, f"detection: {e}", *none, took()))
                        continue
                    spent = took()
                    kids_of = lambda kids: [{"box": [list(p) for p in c.quad], "text": t, "score": s} for c, t, s in kids] or None
                    found = [(k, 200, None, n, *(v for p in box.quad for v in p), text, score, box.class_id, box.read_order, kids_of(kids), spent) for n, (box, text, score, kids) in enumerate(got)]
                    out += found or [(k, 200, None, *none, spent)]
                yield pd.DataFrame(out, columns=names).astype({n: "Int64" for n in names if f"{n} long" in schema})

        return frames.select(F.col(key).cast("string").alias("key"), F.col(content).alias("content")).mapInPandas(rows, schema)

    def transform(self, frames: DataFrame, key: str, content: str = "content") -> DataFrame:
        """key, status, error, the lines of every image (bytes in ``content``) with their children, and elapsed_ms of the image; one row
        without a line for an image that has none (200), cannot be read (400) or at which a stage fails (500)."""
        return self._over(frames, key, content, self.run)

    def detect_frames(self, frames: DataFrame, key: str, content: str = "content") -> DataFrame:
        """The same of what the detector finds: boxes without text, neither merged nor read."""
        return self._over(frames, key, content, lambda image: [(b, None, b.score, []) for b in self.parts["detect"].detect(image)])


def coloured(lines: DataFrame, frames: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``lines`` (of ``Engine.transform``) with text_color ([r, g, b]) and word_colors (start, end, color; null where the words do not differ).
    Pixels leave their images only near lines, and the colours are told by joins and windows over them. ``lines`` is read several
    times, so it should be a written table, or the engine runs as often."""
    quad = F.array(*[F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in range(4)])
    boxes = lines.where("parent is not null").select(F.col("key").alias("image_id"), F.col("parent").alias("box_id"), quad.alias("quad"), "text")
    b = g.bounds(F.col("quad"))
    near = boxes.groupBy("image_id").agg(F.collect_list(F.struct(*[b[c].alias(c) for c in ("x0", "y0", "x1", "y1")])).alias("boxes"))
    pages = frames.select(F.col(key).cast("string").alias("image_id"), F.col(content).alias("content")).join(near, "image_id")
    sized = boxes.join(pages.select("image_id", images.sizes("content").alias("s")).where("s.width is not null").select("image_id", "s.*"), "image_id")
    pixels = images.pixels(pages, colour.RING)
    rgb = lambda c: F.array(*[c(x) for x in "rgb"])
    text = colour.text_colours(pixels, sized).select(F.col("image_id").alias("key"), F.col("box_id").alias("parent"), rgb(F.col).alias("text_color"))
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), rgb(lambda c: s[c]).alias("color")))
    words = colour.word_colours(pixels, sized).select(F.col("image_id").alias("key"), F.col("box_id").alias("parent"), spans.alias("word_colors"))
    return lines.join(text, ["key", "parent"], "left").join(words, ["key", "parent"], "left")


def responses(lines: DataFrame) -> DataFrame:
    """image_id, body: the JSON result of every image. Lines in order with text, score and box; null colours, word colours and
    children are left out. ``lines``: image_id, line, text, score, x0, y0, x1, y1."""
    box = F.array(*[F.array(F.col(x), F.col(y)) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
    extra = [F.col(c) if c in lines.columns else F.lit(None).cast("string").alias(c) for c in ("text_color", "word_colors", "children")]
    kids = F.array_sort(F.collect_list(F.struct("line", "text", F.round("score", 6).alias("score"), box.alias("box"), *extra)))
    plain = F.transform("kids", lambda k: F.struct(*[k[c].alias(c) for c in ("text", "score", "box", "text_color", "word_colors", "children")]))
    g = lines.groupBy("image_id").agg(kids.alias("kids"))
    text = F.array_join(F.transform("kids", lambda k: k["text"]), "\n")
    return g.select("image_id", F.to_json(F.struct(text.alias("text"), plain.alias("lines"))).alias("body"))
