"""Colour statistics of pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g


def gray_histogram(pixels: DataFrame) -> DataFrame:
    return pixels.where("inside").groupBy("image_id", g.gray().alias("gray")).agg(F.count("*").alias("n"))


def otsu(pixels: DataFrame) -> DataFrame:
    """image_id, threshold: first grey level of largest between-class variance; 0 where there is a single level."""
    h = gray_histogram(pixels)
    upto, every = Window.partitionBy("image_id").orderBy("gray").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("image_id")
    h = h.select("image_id", "gray", F.sum("n").over(upto).alias("wb"), F.sum(F.col("n") * F.col("gray")).over(upto).alias("sb"), F.sum("n").over(every).alias("w"), F.sum(F.col("n") * F.col("gray")).over(every).alias("s"))
    wf = F.col("w") - F.col("wb")
    spread = F.when(wf > 0, F.col("wb").cast("double") * wf * F.pow(F.col("sb") / F.col("wb") - (F.col("s") - F.col("sb")) / wf, F.lit(2.0)))
    return h.withColumn("v", spread).groupBy("image_id").agg(F.coalesce(F.min_by("gray", F.when(F.col("v").isNotNull(), F.struct((-F.col("v")).alias("v"), "gray"))), F.lit(0)).cast("long").alias("threshold"))


def upper_medians(pixels: DataFrame) -> DataFrame:
    med = lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c} DESC)").cast("long").alias(c)
    return pixels.where("inside").groupBy("image_id").agg(med("r"), med("g"), med("b"))


def cluster_variance(pixels: DataFrame) -> DataFrame:
    v = F.coalesce(F.var_pop("r") + F.var_pop("g") + F.var_pop("b"), F.lit(0.0))
    return pixels.where("inside").groupBy("image_id").agg(F.round(v, 4).alias("variance"))


def runs(marks: DataFrame, key: str, pos: str) -> DataFrame:
    """Half-open runs of consecutive positions per key. ``marks``: distinct key, pos."""
    w = Window.partitionBy(key).orderBy(pos)
    isle = marks.withColumn("i", F.col(pos) - F.row_number().over(w))
    return isle.groupBy(key, "i").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end")).drop("i")


def text_colour(pixels: DataFrame, least: int = 4, least_outside: int = 20) -> DataFrame:
    """image_id, r, g, b, dark of images with at least ``least`` pixels inside: the colour of the text cluster.

    Pixels inside are parted at Otsu's threshold. Text is the cluster whose median is farther from that of the pixels outside
    (ties: dark); with fewer than ``least_outside`` of these, the cluster of larger variance (ties: dark). With one cluster
    only, it is the median of all.
    """
    t = otsu(pixels)
    p = pixels.join(t, "image_id").withColumn("part", F.when(~F.col("inside"), 0).when(g.gray() <= F.col("threshold"), 1).otherwise(2))
    med = lambda c, k: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c} DESC) FILTER (WHERE {k})").cast("long")
    kinds = {"o": "part = 0", "d": "part = 1", "l": "part = 2", "a": "part > 0"}
    spread = lambda k: sum((F.var_pop(F.when(F.expr(kinds[k]), F.col(c))) for c in "rgb"), F.lit(0.0))
    s = p.groupBy("image_id").agg(
        *[med(c, cond).alias(c + k) for k, cond in kinds.items() for c in "rgb"], *[F.count_if(F.expr(cond)).alias("n" + k) for k, cond in kinds.items()],
        spread("d").alias("vd"), spread("l").alias("vl"),
    )
    far = lambda k: g.colour_distance([F.col(c + k) for c in "rgb"], [F.col(c + "o") for c in "rgb"])
    dark = F.when((F.col("nd") == 0) | (F.col("nl") == 0), F.lit(None)).when(F.col("no") >= least_outside, far("d") >= far("l")).otherwise(F.round("vl", 6) <= F.round("vd", 6))
    pick = [F.when(F.col("dark").isNull(), F.col(c + "a")).when(F.col("dark"), F.col(c + "d")).otherwise(F.col(c + "l")).alias(c) for c in "rgb"]
    return s.where(F.col("na") >= least).withColumn("dark", dark).select("image_id", *pick, "dark")


def char_spans(segments: Column, chars: Column | int, axis: Column | int, more: tuple[str, ...] = ()) -> Column:
    """Character spans (start, end, and the fields ``more`` of the segment) of pixel segments in order, out of ``chars`` over
    ``axis`` pixels. A span starts no earlier than the one before it ends, has one character at least, and is left out where
    no character remains."""
    chars, axis = (v.cast("long") if isinstance(v, Column) else F.lit(v).cast("long") for v in (chars, axis))
    scaled = lambda v: F.greatest(F.lit(0).cast("long"), F.least(chars, F.floor(v * chars.cast("double") / axis + 0.5)))
    kind = "array<struct<" + ",".join(f"{c}:bigint" for c in ("start", "end", *more)) + ">>"

    def step(acc, s):
        start = F.greatest(scaled(s["start"]), F.coalesce(F.get(acc, F.size(acc) - 1)["end"], F.lit(0).cast("long")))
        end = F.least(chars, F.greatest(scaled(s["end"]), start + 1))
        one = F.struct(start.alias("start"), end.alias("end"), *[s[c].alias(c) for c in more])
        return F.when(start >= chars, acc).otherwise(F.concat(acc, F.array(one).cast(kind)))

    return F.aggregate(segments, F.array().cast(kind), step)


_SPANS = "array<struct<start:bigint,end:bigint,r:bigint,g:bigint,b:bigint>>"


def _apart(x: Column, y: Column) -> Column:
    return g.colour_distance([x[c] for c in "rgb"], [y[c] for c in "rgb"])


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it (a plan may copy a column into every use)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def suppressed(spans: Column, least: int = 6000, ratio: int = 3, alike: int = 4000) -> Column:
    """``spans`` (start, end, r, g, b, in order) with outlying colours given to a neighbour.

    A span of three or more is outlying if its distance from the median colour is over ``least`` and over ``ratio`` times the
    median distance. It goes to the neighbour closer in colour (ties: left), unless its neighbours differ by over ``alike``.
    """
    middle = lambda a: F.element_at(F.array_sort(a), (F.floor(F.size(a) / 2) + 1).cast("int"))
    none, zero = F.lit(None).cast("bigint"), F.struct(F.array().cast(_SPANS).alias("out"), F.lit(None).cast("bigint").alias("carry"))

    def folded(all_, m, t):
        n = F.size(all_)

        def step(acc, i):
            e, right = F.get(all_, i), F.get(all_, i + 1)
            left, start = F.get(acc["out"], F.size(acc["out"]) - 1), F.coalesce(acc["carry"], e["start"])
            own = F.array(F.struct(start.alias("start"), e["end"].alias("end"), *[e[c].alias(c) for c in "rgb"])).cast(_SPANS)
            longer = F.concat(F.slice(acc["out"], 1, F.greatest(F.lit(0), F.size(acc["out"]) - 1)), F.array(F.struct(left["start"].alias("start"), e["end"].alias("end"), *[left[c].alias(c) for c in "rgb"])).cast(_SPANS))
            has_left, has_right = F.size(acc["out"]) > 0, i + 1 < n
            stays = (_apart(e, m) <= t) | (~has_left & ~has_right) | (has_left & has_right & (_apart(left, right) > alike))
            to_left = has_left & (~has_right | (_apart(e, left) <= _apart(e, right)))
            return F.when(stays, F.struct(F.concat(acc["out"], own).alias("out"), none.alias("carry"))).when(to_left, F.struct(longer.alias("out"), none.alias("carry"))).otherwise(F.struct(acc["out"].alias("out"), start.alias("carry")))

        return F.aggregate(F.sequence(F.lit(0), n - 1), zero, step, lambda a: a["out"])

    def whole(all_):
        channel = lambda c: (lambda s: s[c])
        median = F.struct(*[middle(F.transform(all_, channel(c))).alias(c) for c in "rgb"])
        far = lambda m: F.greatest(F.lit(least).cast("long"), middle(F.transform(all_, lambda s: _apart(s, m))) * ratio)
        return F.when(F.size(all_) < 3, all_.cast(_SPANS)).otherwise(_bound(median, lambda m: _bound(far(m), lambda t: folded(all_, m, t))))

    return _bound(spans, whole)


def suppress_outliers(df: DataFrame, spans: str, least: int = 6000, ratio: int = 3, alike: int = 4000) -> DataFrame:
    """``df`` with the column ``spans`` ``suppressed``."""
    return df.withColumn(spans, suppressed(F.col(spans), least, ratio, alike))


def merge_similar(spans: Column, most: int = 2000) -> Column:
    """Spans (start, end, r, g, b, in order) with neighbours of like colour made one, colours weighted by length."""

    def step(acc, e):
        p = F.get(acc, F.size(acc) - 1)
        a, b = p["end"] - p["start"], e["end"] - e["start"]
        mixed = [g.rounded((p[c] * a + e[c] * b) / F.greatest(a + b, F.lit(1).cast("bigint"))).alias(c) for c in "rgb"]
        one = F.array(F.struct(p["start"].alias("start"), e["end"].alias("end"), *mixed)).cast(_SPANS)
        own = F.array(F.struct(*[e[c].alias(c) for c in ("start", "end", "r", "g", "b")])).cast(_SPANS)
        near = (F.size(acc) > 0) & (_apart(p, e) <= most)
        return F.when(near & (a + b == 0), acc).when(near, F.concat(F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1)), one)).otherwise(F.concat(acc, own))

    return F.aggregate(spans, F.array().cast(_SPANS), step)


#: Pixels around a box that may serve as background, how many are needed, and pixels of text below which a box has no colour.
RING, LEAST_OUTSIDE, LEAST_INSIDE, CELL = 15, 20, 4, 64
#: Pixels that a box sees (its bounds and the ring) up to which one task judges it, and pixels that are judged at once.
MOST, BLOCK = 1 << 18, 1 << 17
_BOX = ["image_id", "box_id"]


def framed(boxes: DataFrame) -> DataFrame:
    """``boxes`` (image_id, box_id, quad, text, width, height of the image) with chars, tall and x0, y0, x1, y1, clamped to the image;
    those without area are left out."""
    b, zero, one = g.bounds(F.col("quad")), F.lit(0).cast("long"), F.lit(1).cast("long")
    low = lambda v, full: g.clamp(b[v], zero, F.col(full) - 1).alias(v)
    high = lambda v, full: g.clamp(b[v], one, F.col(full)).alias(v)
    tall = (b["y1"] - b["y0"]) > (b["x1"] - b["x0"]) * 2
    chars = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    boxes = boxes.select(*_BOX, "quad", chars.alias("chars"), tall.alias("tall"), low("x0", "width"), low("y0", "height"), high("x1", "width"), high("y1", "height"))
    return boxes.where((g.width() > 0) & (g.height() > 0))


def _in_cells(frames: DataFrame, ring: int, cell: int) -> DataFrame:
    """``frames`` once for every cell (cx, cy) that they or their rings touch."""
    boxes = frames.withColumn("cx", F.explode(F.sequence(F.floor((F.col("x0") - ring) / cell), F.floor((F.col("x1") + ring - 1) / cell))))
    return boxes.withColumn("cy", F.explode(F.sequence(F.floor((F.col("y0") - ring) / cell), F.floor((F.col("y1") + ring - 1) / cell))))


def _placed(pixels: DataFrame, cell: int) -> DataFrame:
    return pixels.select("image_id", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"), "x", "y", "r", "g", "b")


def _local(quad: Column) -> Column:
    return F.transform(quad, lambda q: F.struct((q["x"] - F.col("x0")).alias("x"), (q["y"] - F.col("y0")).alias("y")))


def seen(pixels: DataFrame, boxes: DataFrame, ring: int = RING, cell: int = CELL) -> DataFrame:
    """image_id, box_id, chars, tall, w, h, px, py (in the crop), r, g, b, place of every pixel that a box sees: 'in' its quad,
    'out' of it but within its bounds, or in the 'ring' around these. ``boxes``: image_id, box_id, quad, text, width, height (of
    the image). Boxes and pixels meet through grid cells: a pixel lies in one, a box covers a few.
    """
    return _seen(pixels, framed(boxes), ring, cell)


def _seen(pixels: DataFrame, frames: DataFrame, ring: int = RING, cell: int = CELL) -> DataFrame:
    near = lambda v: (F.col(v) >= F.col(v + "0") - ring) & (F.col(v) < F.col(v + "1") + ring)
    both = _in_cells(frames, ring, cell).join(_placed(pixels, cell), ["image_id", "cx", "cy"]).where(near("x") & near("y"))
    px, py = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    within = (px >= 0) & (px < g.width()) & (py >= 0) & (py < g.height())
    place = F.when(~within, "ring").when(g.in_corners(px, py, _local(F.col("quad"))), "in").otherwise("out")
    return both.select(*_BOX, "chars", "tall", g.width().alias("w"), g.height().alias("h"), px.alias("px"), py.alias("py"), "r", "g", "b", place.alias("place"))


def judged(seen_pixels: DataFrame, ring: int = LEAST_OUTSIDE, least: int = LEAST_INSIDE) -> DataFrame:
    """The pixels in the quads of ``seen_pixels`` with text (whether it is of the text) and the colour of the text, cr, cg, cb.

    Pixels of a quad are parted at Otsu's threshold. Text is the part whose median is farther from that of the pixels out of the
    quad (ties: dark), to which the ring belongs only where they are fewer than ``ring``; where both together are too few, the
    part of larger variance (ties: dark); all, where there is one part only. Quads of fewer than ``least`` pixels are dropped.
    All is told by windows over one box, so the pixels are shuffled once.
    """
    box, upto = Window.partitionBy(*_BOX), Window.partitionBy(*_BOX).orderBy(F.col("gray").asc_nulls_last()).rangeBetween(Window.unboundedPreceding, 0)
    inside = F.col("place") == "in"
    p = seen_pixels.withColumn("gray", F.when(inside, g.gray()))
    n, s = F.when(inside, 1).otherwise(0), F.coalesce("gray", F.lit(0))
    p = p.select("*", *[f.over(w).alias(a + b) for a, w in (("b", upto), ("all", box)) for b, f in (("n", F.sum(n)), ("s", F.sum(s)))])
    left = F.col("alln") - F.col("bn")
    spread = F.when(inside & (left > 0), F.col("bn").cast("double") * left * F.pow(F.col("bs") / F.nullif("bn", F.lit(0)) - (F.col("alls") - F.col("bs")) / F.nullif(left, F.lit(0)), F.lit(2.0)))
    p = p.withColumn("v", spread)
    p = p.withColumn("threshold", F.coalesce(F.min_by("gray", F.when(F.col("v").isNotNull(), F.struct((-F.col("v")).alias("v"), "gray"))).over(box), F.lit(0)))
    part = F.when(F.col("place") == "ring", 3).when(F.col("place") == "out", 0).when(F.col("gray") <= F.col("threshold"), 1).otherwise(2)
    p = p.withColumn("part", part).withColumn("near", F.count_if(F.col("part") == 0).over(box) < ring)
    kinds = {"o": (F.col("part") == 0) | ((F.col("part") == 3) & F.col("near")), "d": F.col("part") == 1, "l": F.col("part") == 2, "a": F.col("part").isin(1, 2)}
    p = p.select("*", *[F.when(is_, F.lit(1)).alias("is" + k) for k, is_ in kinds.items()], *[F.when(is_, F.col(c)).alias(c + k) for k, is_ in kinds.items() for c in "rgb"])
    median = lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c} DESC)").over(box).cast("long").alias("m" + c)
    p = p.select(
        *_BOX, "chars", "tall", "w", "h", "px", "py", "r", "g", "b", "part", *[median(c + k) for k in kinds for c in "rgb"], *[F.count("is" + k).over(box).alias("n" + k) for k in kinds],
        *[sum((F.var_pop(c + k).over(box) for c in "rgb"), F.lit(0.0)).alias("v" + k) for k in "dl"],
    )
    far = lambda k: g.colour_distance([F.col(f"m{c}{k}") for c in "rgb"], [F.col(f"m{c}o") for c in "rgb"])
    dark = F.when((F.col("nd") == 0) | (F.col("nl") == 0), F.lit(None)).when(F.col("no") >= ring, far("d") >= far("l")).otherwise(F.round("vl", 6) <= F.round("vd", 6))
    p = p.where(F.col("part").isin(1, 2) & (F.col("na") >= least)).withColumn("dark", dark)
    pick = [F.when(F.col("dark").isNull(), F.col(f"m{c}a")).when(F.col("dark"), F.col(f"m{c}d")).otherwise(F.col(f"m{c}l")).alias("c" + c) for c in "rgb"]
    text = F.coalesce(F.when(F.col("dark"), F.col("part") == 1).otherwise(F.col("part") == 2) | F.col("dark").isNull(), F.lit(True))
    return p.select(*_BOX, "chars", "tall", "w", "h", "px", "py", "r", "g", "b", text.alias("text"), *pick)


def _uppers(of: np.ndarray, values: dict[str, tuple[np.ndarray, np.ndarray]], many: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The upper median of each of ``many`` groups, and whether it has any value. ``values``: values and whether they are known, by name."""
    out = {}
    for c, (v, known) in values.items():
        at, v = of[known], v[known]
        n = np.bincount(at, minlength=many)
        v = np.append(v[np.lexsort((v, at))], 0)
        out[c] = v[np.where(n > 0, np.cumsum(n) - n + n // 2, len(v) - 1)], n > 0
    return out


def _variance(of: np.ndarray, v: np.ndarray, many: int) -> np.ndarray:
    """Population variance of each of ``many`` groups, nan where a group is empty; sums are exact."""
    n, s, q = (np.bincount(of, w, many).astype(np.int64) for w in (None, v, v * v))
    return np.where(n > 0, (n * q - s * s) / np.maximum(n, 1).astype(float) ** 2, np.nan)


def _thresholds(of: np.ndarray, gray: np.ndarray, known: np.ndarray, many: int) -> np.ndarray:
    """Otsu's threshold of each of ``many`` boxes, as in ``otsu``; pixels of unknown level count as the last one."""
    total = np.bincount(of, minlength=many)
    of, gray = of[known], gray[known]
    order = np.lexsort((gray, of))
    of, gray = of[order], gray[order]
    out = np.zeros(many, np.int64)
    sums, edge = np.append(0, np.cumsum(gray)), np.searchsorted(of, np.arange(many + 1))
    last = np.flatnonzero((np.diff(of, append=-1) != 0) | (np.diff(gray, append=0) != 0))
    box = of[last]
    wb, sb, s = last + 1 - edge[box], sums[last + 1] - sums[edge[box]], sums[edge[box + 1]] - sums[edge[box]]
    left = total[box] - wb
    some = left > 0
    box, wb, sb, s, left, level = (v[some] for v in (box, wb, sb, s, left, gray[last]))
    v = wb.astype(float) * left * (sb / wb - (s - sb) / left) ** 2
    best = np.lexsort((level, -v, box))
    first = best[np.flatnonzero(np.diff(box[best], prepend=-1))]
    out[box[first]] = level[first]
    return out


def _judged_block(of: np.ndarray, box: dict[str, np.ndarray], pixel: dict[str, np.ndarray], known: dict[str, np.ndarray]) -> tuple:
    """What ``judged`` tells of the boxes of a block, and the words of their text: whether a box has a colour, its r, g, b with whether
    each is known, how many words, and start, end, r, g, b of these. ``of``: the box that sees a pixel; ``known``: by channel."""
    many = len(box["x0"])
    px, py = pixel["x"] - box["x0"][of], pixel["y"] - box["y0"][of]
    w, h = box["w"][of], box["h"][of]
    near = (px >= -RING) & (px < w + RING) & (py >= -RING) & (py < h + RING)
    of, px, py, w, h = (v[near] for v in (of, px, py, w, h))
    rgb = {c: (pixel[c][near], known[c][near]) for c in "rgb"}
    inside = np.zeros(len(of), bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(4):  # as g.in_corners
            xi, yi, xj, yj = (box["q" + c][i % 4][of] for i in (k, k - 1) for c in "xy")
            inside ^= ((yi > py) != (yj > py)) & (px < (xj - xi) * (py - yi) / (yj - yi) + xi)
    within = (px >= 0) & (px < w) & (py >= 0) & (py < h)
    inside &= within
    total = 299 * rgb["r"][0] + 587 * rgb["g"][0] + 114 * rgb["b"][0]
    gray, whole = np.sign(total) * (np.abs(total) // 1000), rgb["r"][1] & rgb["g"][1] & rgb["b"][1]
    threshold = _thresholds(of[inside], gray[inside], whole[inside], many)
    part = np.where(~within, 3, np.where(~inside, 0, np.where(whole & (gray <= threshold[of]), 1, 2)))
    few = np.bincount(of[part == 0], minlength=many) < LEAST_OUTSIDE
    part[(part == 3) & few[of]] = 0
    picked = lambda some: {c: (v[some], k[some]) for c, (v, k) in rgb.items()}
    told = part < 3
    group = of * 3 + part  # 0: ground, 1: dark, 2: light
    median = {c: (v.reshape(-1, 3), k.reshape(-1, 3)) for c, (v, k) in _uppers(group[told], picked(told), 3 * many).items()}
    n = np.bincount(group[told], minlength=3 * many).reshape(-1, 3)
    far = sum((np.where(k[:, 1:] & k[:, :1], v[:, 1:] - v[:, :1], np.nan) ** 2 for v, k in median.values()), 0.0)
    spread = sum(_variance(group[inside & k], v[inside & k], 3 * many).reshape(-1, 3)[:, 1:] for v, k in rgb.values()).round(6)
    less, more = np.where((n[:, 0] >= LEAST_OUTSIDE)[:, None], far, spread)[:, ::-1].T
    one = (n[:, 1] == 0) | (n[:, 2] == 0) | np.isnan(less) | np.isnan(more)
    dark = less <= more
    text = inside & (one[of] | (dark[of] == (part == 1)))
    has = n[:, 1] + n[:, 2] >= LEAST_INSIDE
    every = inside & one[of]
    alone = _uppers(of[every], picked(every), many)
    side = np.where(dark, 1, 2)
    colour = {c: [np.where(one, alone[c][i], median[c][i][np.arange(many), side]) for i in (0, 1)] for c in "rgb"}
    text &= has[of] & (box["chars"][of] > 0)
    of, place, rgb = of[text], np.where(box["tall"][of], py, px)[text], picked(text)
    order = np.lexsort((place, of))
    of, place, rgb = of[order], place[order], {c: (v[order], k[order]) for c, (v, k) in rgb.items()}
    begins = (np.diff(of, prepend=-1) != 0) | (np.diff(place, prepend=0) > 1)
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(of))[: len(start)] - 1
    return has, colour, np.bincount(of[start], minlength=many), place[start], place[end] + 1, _uppers(np.cumsum(begins) - 1, rgb, len(start))


def _judged_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of ``_by_box`` from boxes with their pixels, so many at once that they see about BLOCK pixels."""
    plain = lambda a: a.to_numpy(zero_copy_only=False)
    for batch in batches:
        kids = batch.column("pixels")
        size = plain(pc.list_value_length(kids)).astype(np.int64)
        block = (np.cumsum(size) - size) // BLOCK
        for lo, hi in zip(e := np.flatnonzero(np.diff(block, prepend=-1)), np.append(e[1:], len(block))):
            rows = batch.slice(lo, hi - lo)
            box = {c: plain(rows.column(c)) for c in ("x0", "y0", "w", "h", "chars", "tall")}
            box |= {"q" + c: plain(rows.column("q" + c).flatten()).reshape(-1, 4).T for c in "xy"}
            flat = rows.column("pixels").flatten()
            at = {c: flat.field(c) for c in ("x", "y", "r", "g", "b")}
            pixel, known = {c: plain(v.fill_null(0)) for c, v in at.items()}, {c: plain(v.is_valid()) for c, v in at.items()}
            has, colour, words, start, end, median = _judged_block(np.repeat(np.arange(hi - lo), size[lo:hi]), box, pixel, known)
            array = lambda v, k: pa.array(v, pa.int64(), mask=~k)
            runs_ = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64()), *[array(*median[c]) for c in "rgb"]], ["start", "end", "r", "g", "b"])
            listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(words)), pa.int32()), runs_)
            axis = np.where(box["tall"], box["h"], box["w"])
            out = [*[rows.column(c) for c in _BOX], *[array(*colour[c]) for c in "rgb"], rows.column("chars"), pa.array(axis, pa.int64()), listed]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(out, schema)], schema=schema).filter(pa.array(has))


def _by_box(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """image_id, box_id, r, g, b, chars, axis, runs (start, end, r, g, b) of the boxes with pixels enough: a box is one row with the
    pixels of its cells, all boxes of a batch are judged by vector operations."""
    from pyspark.sql.pandas.types import to_arrow_schema

    pixel = F.struct("x", "y", "r", "g", "b").cast("struct<x:bigint,y:bigint,r:bigint,g:bigint,b:bigint>")
    cells = _placed(pixels, CELL).where("x is not null and y is not null").groupBy("image_id", "cx", "cy").agg(F.collect_list(pixel).alias("pixels"))
    corner = lambda c: F.array(*[F.get(_local(F.col("quad")), F.lit(k))[c].cast("double") for k in range(4)])
    slim = frames.select(*_BOX, "chars", "tall", "x0", "y0", "x1", "y1", g.width().alias("w"), g.height().alias("h"), corner("x").alias("qx"), corner("y").alias("qy"))
    met = _in_cells(slim, RING, CELL).hint("merge").join(cells, ["image_id", "cx", "cy"])
    same = ["x0", "y0", "w", "h", "chars", "tall", "qx", "qy"]
    whole = met.groupBy(*_BOX).agg(F.flatten(F.collect_list("pixels")).alias("pixels"), *[F.first(c).alias(c) for c in same])
    keys = ",".join(f"`{c}` {whole.schema[c].dataType.simpleString()}" for c in _BOX)
    shape = whole.sparkSession.createDataFrame([], f"{keys}, r long, g long, b long, chars long, axis long, runs {_SPANS}").schema
    schema = to_arrow_schema(shape)
    return whole.mapInArrow(lambda batches: _judged_batches(batches, schema), shape)


def _by_size(boxes: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The boxes (``framed``) that see at most ``most`` pixels, and the others, if there are any."""
    frames = framed(boxes)
    sees = (g.width() + 2 * RING) * (g.height() + 2 * RING)
    large = frames.where(sees > most)
    return (frames, None) if large.isEmpty() else (frames.where(sees <= most), large)


def text_colours(pixels: DataFrame, boxes: DataFrame, most: int = MOST) -> DataFrame:
    """image_id, box_id, r, g, b: the text colour of every box with pixels enough (see ``judged``). A box that sees at most ``most``
    pixels is one row of one task; those of larger boxes are judged by windows, which may leave memory. Which way is taken changes
    no result."""
    small, large = _by_size(boxes, most)
    out = _by_box(pixels, small).select(*_BOX, *"rgb")
    return out if large is None else out.unionByName(judged(_seen(pixels, large)).groupBy(*_BOX).agg(*[F.first("c" + c).alias(c) for c in "rgb"]))


def _runs(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """image_id, box_id, runs, chars, axis as of ``_by_box``, by windows and aggregations of pixels."""
    place, axis = F.when(F.col("tall"), F.col("py")).otherwise(F.col("px")), F.when(F.col("tall"), F.col("h")).otherwise(F.col("w"))
    p = judged(_seen(pixels, frames)).where(F.col("text") & (F.col("chars") > 0)).select(*_BOX, "chars", axis.alias("axis"), place.alias("at"), "r", "g", "b")
    p = p.withColumn("isle", F.col("at") - F.dense_rank().over(Window.partitionBy(*_BOX).orderBy("at")))
    median = [F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c} DESC)").cast("long").alias(c) for c in "rgb"]
    runs_ = p.groupBy(*_BOX, "isle").agg(F.min("at").alias("start"), (F.max("at") + 1).alias("end"), *median, F.first("chars").alias("chars"), F.first("axis").alias("axis"))
    return runs_.groupBy(*_BOX).agg(F.array_sort(F.collect_list(F.struct("start", "end", "r", "g", "b"))).alias("runs"), F.first("chars").alias("chars"), F.first("axis").alias("axis"))


def word_colours(pixels: DataFrame, boxes: DataFrame, most: int = MOST) -> DataFrame:
    """image_id, box_id, spans (start, end, r, g, b) of the boxes whose words differ in colour.

    Text pixels are projected on the axis of the text (down where a box is over twice as high as wide); each run of occupied
    places is a word with its median colour and the characters it covers in proportion. Outlying colours go to a neighbour,
    like neighbours are joined. A box without text, or with one run or one span, has none. ``most``: as in ``text_colours``.
    """
    small, large = _by_size(boxes.where("text != ''"), most)
    words = _by_box(pixels, small).select(*_BOX, "runs", "chars", "axis")
    words = words if large is None else words.unionByName(_runs(pixels, large))
    spans = words.where(F.size("runs") > 1).select(*_BOX, char_spans(F.col("runs"), F.col("chars"), F.col("axis"), ("r", "g", "b")).alias("spans"))
    calm = spans.where(F.size("spans") > 1).select(*_BOX, merge_similar(suppressed(F.col("spans"))).alias("spans"))
    return calm.where(F.size("spans") > 1)
