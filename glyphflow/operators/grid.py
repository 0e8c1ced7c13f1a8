"""Detection postprocessing of probability maps: components, hulls, rectangles, scores. One row holds one map; kernels take
Arrow batches of maps."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD, MIN_AREA, BOX_SCORE, UNCLIP = 0.3, 16, 0.6, 2.0


def components(mask: np.ndarray) -> np.ndarray:
    """Label of every cell of a 2-D mask: the smallest flat index of its 4-connected component, -1 outside.

    Rows become runs; runs of neighbouring rows that overlap are united, so the loop goes over runs, not cells.
    """
    h, w = mask.shape
    step = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (ys, xs), (ye, xe) = np.nonzero(step == 1), np.nonzero(step == -1)
    start, end = ys * w + xs, ye * w + xe
    low, high = np.searchsorted(end, start + w, "right"), np.searchsorted(start, end + w, "left")
    root = list(range(len(start)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k, (a, b) in enumerate(zip(low.tolist(), high.tolist())):
        for other in range(a, b):
            p, q = find(k), find(other)
            if p != q:
                root[max(p, q)] = min(p, q)
    out = np.full(h * w, -1)
    first = start[[find(k) for k in range(len(start))]] if len(start) else start
    out[mask.ravel()] = np.repeat(first, end - start)
    return out.reshape(h, w)


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Strict corners of the convex hull, from the leftmost lowest point on (monotone chain). Of points that share a tenth of a cell
    on both axes, the first counts."""
    if len(points) < 3:
        return list(points)
    first: dict[tuple[int, int], tuple[float, float]] = {}
    for p in points:
        first.setdefault((int(p[0] * 10), int(p[1] * 10)), p)
    if len(first) < 3:
        return list(first.values())
    pts = sorted(first.values())

    def half(order):
        out: list[tuple[float, float]] = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(pts[::-1])


def min_area_rect(points: list[tuple[float, float]]) -> tuple[list[tuple[float, float]], float]:
    """Corners and area of the smallest rectangle with a side along an edge of the hull; the first edge wins ties."""
    h = hull(points)
    if len(h) < 2:
        return [h[0] if h else (0.0, 0.0)] * 4, 0.0
    xy, best = np.array(h, float), None
    for a, b in zip(xy, np.roll(xy, -1, axis=0)):
        size = math.hypot(*(b - a))
        if size < 1e-10:
            continue
        u = (b - a) / size
        v = np.array([-u[1], u[0]])
        s, t = xy @ u, xy @ v
        area = float((s.max() - s.min()) * (t.max() - t.min()))
        if best is None or area < best[1] - 1e-12:
            best = ([tuple(u * p + v * q) for p, q in ((s.min(), t.min()), (s.max(), t.min()), (s.max(), t.max()), (s.min(), t.max()))], area)
    return best


def inside(x: np.ndarray, y: np.ndarray, polygon: list[tuple[float, float]]) -> np.ndarray:
    """Even-odd ray cast of points against a polygon."""
    out = np.zeros(np.shape(x), bool)
    for (xi, yi), (xj, yj) in zip(polygon, [polygon[-1], *polygon[:-1]]):
        if yi != yj:
            out ^= ((yi > y) != (yj > y)) & (x < (xj - xi) * (y - yi) / (yj - yi) + xi)
    return out


def box_score(p: np.ndarray, polygon: list[tuple[float, float]]) -> float:
    """Mean probability of the cells inside a polygon; 0 if there are none."""
    h, w = p.shape
    y, x = np.mgrid[0:h, 0:w]
    at = inside(x, y, polygon)
    return float(p[at].mean()) if at.any() else 0.0


def unclip(polygon: list[tuple[float, float]], ratio: float = UNCLIP) -> list[tuple[float, float]]:
    """A polygon with its edges moved outward by area * ratio / perimeter; corners are where moved neighbours meet, or midway
    between their ends where they are parallel."""
    n = len(polygon)
    if n < 3:
        return list(polygon)
    q = np.array(polygon, float)
    nxt = np.roll(q, -1, axis=0)
    signed = float((q[:, 0] * nxt[:, 1] - nxt[:, 0] * q[:, 1]).sum()) / 2
    edge = nxt - q
    size = np.hypot(edge[:, 0], edge[:, 1])
    if size.sum() < 1e-10:
        return list(polygon)
    far = abs(signed) * ratio / size.sum()
    safe = np.maximum(size, 1e-12)
    out = np.column_stack([edge[:, 1] / safe, -edge[:, 0] / safe]) * far * (1 if signed >= 0 else -1)
    a, b = q + out, nxt + out
    corners = []
    for k in range(n):
        (p1, p2), (p3, p4) = (a[k - 1], b[k - 1]), (a[k], b[k])
        d1, d2 = p2 - p1, p4 - p3
        den = d1[0] * d2[1] - d1[1] * d2[0]
        if abs(den) < 1e-10:
            corners.append(tuple((p2 + p3) / 2))
        else:
            t = ((p3[0] - p1[0]) * d2[1] - (p3[1] - p1[1]) * d2[0]) / den
            corners.append(tuple(p1 + t * d1))
    return corners


def detected(p: np.ndarray, sx: float = 1.0, sy: float = 1.0, width: int | None = None, height: int | None = None, threshold: float = THRESHOLD, min_area: int = MIN_AREA, min_score: float = BOX_SCORE, ratio: float = UNCLIP) -> list[tuple[list[tuple[int, int]], float]]:
    """Quads and scores found in a probability map, in the order of their components, scaled and clamped to the image."""
    label = components(p > np.float32(threshold))
    h, w = p.shape
    width, height, out = width or w, height or h, []
    for c in np.unique(label[label >= 0]).tolist():
        y, x = np.nonzero(label == c)
        if len(x) < min_area:
            continue
        points = list(zip(x.tolist(), y.tolist()))
        if len(hull(points)) < 3:
            continue
        rect, _ = min_area_rect(points)
        score = box_score(p, rect)
        if score < min_score:
            continue
        q = unclip(rect, ratio)
        pick = lambda key, most: (max if most else min)(q, key=key)
        ordered = [pick(sum, False), pick(lambda t: t[0] - t[1], True), pick(sum, True), pick(lambda t: t[0] - t[1], False)]
        scale = lambda v, s, top: min(max(0, math.floor(v * s + 0.5)), top)
        out.append(([(scale(px, sx, width - 1), scale(py, sy, height - 1)) for px, py in ordered], score))
    return out


def labelled(maps: DataFrame, cells: Column, width: int, threshold: float) -> DataFrame:
    """``maps`` once for each cell over the threshold, with y, x, p, component. ``cells``: flat array, rows of ``width``."""

    @F.pandas_udf("array<int>")
    def of(c: pd.Series) -> pd.Series:
        return pd.Series([components((np.asarray(a, float) > threshold).reshape(-1, width)).ravel() for a in c], dtype=object)

    z = maps.withColumn("__c", cells).withColumn("__l", of("__c")).select(*maps.columns, F.posexplode(F.arrays_zip("__c", "__l")).alias("__k", "__v"))
    z = z.where("__v.__l >= 0")
    return z.select(*maps.columns, F.expr(f"cast(__k div {width} as bigint)").alias("y"), F.expr(f"cast(__k % {width} as bigint)").alias("x"), F.col("__v.__c").alias("p"), F.col("__v.__l").cast("long").alias("component"))


def outlines(cells: DataFrame, key: list[str]) -> DataFrame:
    """Hull corners, smallest rectangle and its area, by component. ``cells``: key, x, y."""

    @F.pandas_udf("hull array<struct<x:double,y:double>>, rect array<struct<x:double,y:double>>, area double")
    def of(points: pd.Series) -> pd.DataFrame:
        rows = []
        for ps in points:
            pts = [(float(q["x"]), float(q["y"])) for q in ps]
            rect, area = min_area_rect(pts)
            rows.append(([{"x": a, "y": b} for a, b in hull(pts)], [{"x": float(a), "y": float(b)} for a, b in rect], area))
        return pd.DataFrame(rows, columns=["hull", "rect", "area"])

    return cells.groupBy(*key).agg(F.collect_list(F.struct("x", "y")).alias("__p"), F.count("*").alias("n")).select(*key, "n", of("__p").alias("__o")).select(*key, "n", "__o.*")


def hull_edges(outline: DataFrame, key: list[str]) -> DataFrame:
    """key, px, py, qx, qy of every edge of the hulls."""
    nxt = F.transform("hull", lambda p, i: F.struct(p.alias("p"), F.coalesce(F.get("hull", i + 1), F.get("hull", F.lit(0))).alias("q")))
    return outline.where("size(hull) > 1").select(*key, F.explode(nxt).alias("e")).select(*key, *[F.col(f"e.{a}.{b}").alias(a + b) for a in "pq" for b in "xy"])
