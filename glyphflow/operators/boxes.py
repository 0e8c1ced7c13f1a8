"""Joins and merges of boxes. Boxes meet through the grid cells that they cover, so work follows the boxes, not their pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .components import components

MAX_DISTANCE, MAX_RATIO, MIN_OVERLAP, CELL = 10, 1.5, 0.8, 256
#: Boxes of an image up to which one task unites them.
MOST = 1 << 16
#: Boxes of an image up to which all its pairs are compared, as vectors; more meet through grid cells.
PAIRED = 32


def prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select(*[F.col(c).alias(p + c) for c in df.columns])


def _cells(d: DataFrame, p: str, margin: int, cell: int) -> DataFrame:
    """``d`` once for each cell that its box, grown by ``margin``, covers."""
    low = lambda v: F.floor((F.col(p + v) - margin) / cell)
    high = lambda v: F.floor((F.col(p + v) + margin) / cell)
    x = d.where((F.col(p + "x1") >= F.col(p + "x0")) & (F.col(p + "y1") >= F.col(p + "y0")))
    return x.withColumn(p + "cx", F.explode(F.sequence(low("x0"), high("x1")))).withColumn(p + "cy", F.explode(F.sequence(low("y0"), high("y1"))))


def meeting(a: DataFrame, b: DataFrame, on: Column, margin: int = 0, cell: int = CELL) -> DataFrame:
    """Pairs of boxes of ``a`` (a_ columns) and ``b`` (b_ columns) of one image whose gap on each axis is at most ``margin``
    and for which ``on`` holds. A pair is taken in one cell only: that of the first corner that both reach. Both sides are
    shuffled: a plan takes boxes exploded from a few columns for far smaller than they are, and would send them all to the driver."""
    left, right = _cells(a, "a_", margin, cell), _cells(b, "b_", 0, cell)
    here = lambda v: F.floor(F.greatest(F.col(f"a_{v}0") - margin, F.col(f"b_{v}0")) / cell)
    near = (F.col("a_image_id") == F.col("b_image_id")) & (F.col("a_cx") == F.col("b_cx")) & (F.col("a_cy") == F.col("b_cy"))
    return left.join(right.hint("merge"), near & (F.col("a_cx") == here("x")) & (F.col("a_cy") == here("y")) & on).drop("a_cx", "a_cy", "b_cx", "b_cy")


def near_pairs(boxes: DataFrame, distance: float) -> DataFrame:
    """Pairs (a_, b_ columns, a before b) of boxes of one image with a gap of at most ``distance``."""
    on = (F.col("a_box_id") < F.col("b_box_id")) & (g.gap_squared("a_", "b_") <= distance * distance)
    return meeting(prefixed(boxes, "a_"), prefixed(boxes, "b_"), on, int(-(-distance // 1)))


def proximity_edges(boxes: DataFrame, max_distance: float = MAX_DISTANCE, max_ratio: float = MAX_RATIO) -> DataFrame:
    """image_id, a, b of boxes (a < b) of one image and orientation, near each other and of like size."""
    d = boxes.select("image_id", "box_id", "x0", "y0", "x1", "y1", g.vertical().alias("tall"), F.least(g.width(), g.height()).alias("size"))
    big, small = F.greatest("a_size", "b_size"), F.least("a_size", "b_size")
    p = near_pairs(d, max_distance).where((F.col("a_tall") == F.col("b_tall")) & (big <= small * max_ratio))
    return p.select(F.col("a_image_id").alias("image_id"), F.col("a_box_id").alias("a"), F.col("b_box_id").alias("b"))


def _labels(x0, y0, x1, y1, ids, distance: float, ratio: float, cell: int = CELL) -> list[int]:
    """The smallest id of each box's cluster; boxes meet through grid cells, clusters through a union-find."""
    n, root, seen = len(ids), list(range(len(ids))), {}
    m = int(-(-distance // 1))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n):
        w, h = x1[i] - x0[i], y1[i] - y0[i]
        tall, size, met = h > w, min(w, h), set()
        for cx in range((x0[i] - m) // cell, (x1[i] + m) // cell + 1):
            for cy in range((y0[i] - m) // cell, (y1[i] + m) // cell + 1):
                met.update(seen.get((tall, cx, cy), ()))
        for j in met:
            a, b = find(i), find(j)
            if a == b:
                continue
            other = min(x1[j] - x0[j], y1[j] - y0[j])
            dx, dy = max(0, max(x0[i], x0[j]) - min(x1[i], x1[j])), max(0, max(y0[i], y0[j]) - min(y1[i], y1[j]))
            if max(size, other) <= ratio * min(size, other) and dx * dx + dy * dy <= distance * distance:
                root[max(a, b)] = min(a, b)
        for cx in range(x0[i] // cell, x1[i] // cell + 1):
            for cy in range(y0[i] // cell, y1[i] // cell + 1):
                seen.setdefault((tall, cx, cy), []).append(i)
    return [ids[find(i)] for i in range(n)]


def _labels_of(of: np.ndarray, box: dict[str, np.ndarray], distance: float, ratio: float, most: int = PAIRED) -> np.ndarray:
    """``_labels`` of the boxes of many images at once, which lie in a row. ``of``: the image of each box."""
    x0, y0, x1, y1, ids = (box[c] for c in ("x0", "y0", "x1", "y1", "box_id"))
    start = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    many = np.diff(np.append(start, len(of)))
    odd = np.add.reduceat((x1 < x0) | (y1 < y0), start) > 0 if len(of) else np.zeros(0, bool)
    alone = (many > most) | odd
    # Every box with those after it in its image.
    end = np.repeat(np.where(alone, 0, start + many), many)
    after = np.maximum(end - np.arange(len(of)) - 1, 0)
    a = np.repeat(np.arange(len(of)), after)
    b = np.arange(len(a)) - np.repeat(np.cumsum(after) - after, after) + a + 1
    w, h = x1 - x0, y1 - y0
    tall, size = h > w, np.minimum(w, h)
    gap = lambda low, high: np.maximum(0, np.maximum(low[a], low[b]) - np.minimum(high[a], high[b]))
    dx, dy = gap(x0, x1), gap(y0, y1)
    near = (tall[a] == tall[b]) & (np.maximum(size[a], size[b]) <= ratio * np.minimum(size[a], size[b])) & (dx * dx + dy * dy <= distance * distance)
    a, b = a[near], b[near]
    root, before = np.arange(len(of)), None
    while before is None or (root != before).any():
        before = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        root = root[root]
    out = ids[root]
    for k in np.flatnonzero(alone):
        at = slice(start[k], start[k] + many[k])
        out[at] = _labels(*(v[at].tolist() for v in (x0, y0, x1, y1, ids)), distance, ratio)
    return out


def box_clusters(boxes: DataFrame, max_distance: float = MAX_DISTANCE, max_ratio: float = MAX_RATIO, most: int = MOST) -> DataFrame:
    """``boxes`` with cluster (smallest box_id reachable by proximity). An image of at most ``most`` boxes is one row of one task; the
    boxes of larger images never meet in one: their edges are contracted by joins. Which way is taken changes no result."""
    sizes = boxes.groupBy("image_id").agg(F.count("*").alias("boxes"))
    large = sizes.where(F.col("boxes") > most).select("image_id")
    if large.isEmpty():
        return _clusters_by_image(boxes, max_distance, max_ratio)
    near = boxes.join(large, "image_id", "left_semi")
    label = components(proximity_edges(near, max_distance, max_ratio), "image_id").select("image_id", F.col("v").alias("box_id"), F.col("label").alias("cluster"))
    joined = near.join(label, ["image_id", "box_id"], "left").select(*boxes.columns, F.coalesce("cluster", "box_id").alias("cluster"))
    small = _clusters_by_image(boxes.join(large, "image_id", "left_anti"), max_distance, max_ratio)
    return small.select(*boxes.columns, "cluster").unionByName(joined)


def _clusters_by_image(boxes: DataFrame, max_distance: float, max_ratio: float) -> DataFrame:
    """One row for each image, all images of a batch at once."""

    @F.arrow_udf("array<long>")
    def of(kids: pa.Array) -> pa.Array:
        at, flat = pc.list_parent_indices(kids).to_numpy(zero_copy_only=False), pc.list_flatten(kids)
        box = {c: pc.struct_field(flat, c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1", "box_id")}
        ends = np.append(0, np.cumsum(np.bincount(at, minlength=len(kids))))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_labels_of(at, box, max_distance, max_ratio), pa.int64()))

    names = [c for c in boxes.columns if c != "image_id"]
    kids = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("box_id", *[c for c in names if c != "box_id"]))).alias("kids"))
    bare = F.transform("kids", lambda k: F.struct(*[k[c].alias(c) for c in ("x0", "y0", "x1", "y1", "box_id")]))
    both = kids.select("image_id", F.explode(F.arrays_zip("kids", of(bare).alias("cluster"))).alias("k"))
    return both.select("image_id", *[F.col(f"k.kids.{c}").alias(c) for c in names], F.col("k.cluster").alias("cluster"))


def merged_lines(clustered: DataFrame) -> DataFrame:
    """One row per cluster: bounds, children in reading order, their text, the first child's score; line number in the image."""
    tall = F.min_by(g.vertical(), F.col("box_id"))
    child = F.struct(g.center_y().alias("cy"), g.center_x().alias("cx"), "box_id", "text", "score")
    m = clustered.groupBy("image_id", "cluster").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.count("*").alias("n"), tall.alias("tall"), F.collect_list(child).alias("kids"), F.avg(F.least(g.width(), g.height())).alias("size"),
    )
    across = F.array_sort("kids")
    down = F.array_sort(F.transform("kids", lambda k: F.struct((-k["cx"]).alias("nx"), k["cy"].alias("cy"), k["box_id"].alias("box_id"), k["text"].alias("text"), k["score"].alias("score"))))
    words = lambda kids: F.array_join(F.filter(F.transform(kids, lambda k: k["text"]), lambda t: F.trim(t) != ""), " ")
    # Most clusters are one box: nothing to order.
    one, only = F.col("n") == 1, F.get("kids", F.lit(0))
    text = F.when(one, F.when(F.trim(only["text"]) != "", only["text"]).otherwise("")).when(F.col("tall"), words(down)).otherwise(words(across))
    score = F.when(one, only["score"]).when(F.col("tall"), F.element_at(down, 1)["score"]).otherwise(F.element_at(across, 1)["score"])
    m = m.select("image_id", "cluster", "x0", "y0", "x1", "y1", "n", text.alias("text"), score.alias("score"), "size")
    return m.withColumn("line", F.row_number().over(Window.partitionBy("image_id").orderBy(g.center_y(), g.center_x(), "cluster")).cast("long"))


def assign_children(children: DataFrame, parents: DataFrame, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """image_id, box_id, parent_id: the parent of same orientation that covers most of a child, at least ``min_overlap``."""
    c = prefixed(children.where(g.area() > 0), "a_").withColumn("a_tall", g.vertical("a_"))
    p = prefixed(parents, "b_").withColumn("b_tall", g.vertical("b_"))
    over = g.intersection("a_", "b_")
    pairs = meeting(c, p, (F.col("a_tall") == F.col("b_tall")) & (over >= g.area("a_") * min_overlap))
    best = F.min_by("b_parent_id", F.struct((-over).alias("o"), F.col("b_parent_id"))).alias("parent_id")
    return pairs.groupBy(F.col("a_image_id").alias("image_id"), F.col("a_box_id").alias("box_id")).agg(best)


def orphans(children: DataFrame, assigned: DataFrame) -> DataFrame:
    return children.where(g.area() > 0).join(assigned.hint("merge"), ["image_id", "box_id"], "left_anti")


def with_children(parents: DataFrame, assigned: DataFrame) -> DataFrame:
    """Parents that have children, with their number and ids in order."""
    kids = assigned.groupBy("image_id", "parent_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("box_id")).alias("kids"))
    return parents.hint("merge").join(kids, ["image_id", "parent_id"])


def hierarchical(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Parents with children, in their order, then every orphan as a parent of itself, in the order of children: image_id,
    seq, parent_id (null: orphan), box_id (null: parent), x0, y0, x1, y1, n."""
    assigned = assign_children(children, parents)
    box, none = ["x0", "y0", "x1", "y1"], F.lit(None).cast("long")
    own = with_children(parents, assigned).select("image_id", F.lit(0).alias("tail"), "parent_id", none.alias("box_id"), *box, "n")
    alone = orphans(children, assigned).select("image_id", F.lit(1).alias("tail"), none.alias("parent_id"), "box_id", *box, F.lit(0).cast("long").alias("n"))
    order = Window.partitionBy("image_id").orderBy("tail", "parent_id", "box_id")
    return own.unionByName(alone).withColumn("seq", F.row_number().over(order).cast("long")).drop("tail")


def parent_text(lines: DataFrame, parent: list[str], order: list[str]) -> DataFrame:
    """Texts of recognised lines (neither null nor empty) joined in order, and their mean score, by parent; parents without
    any are dropped. ``lines``: parent, order, text, score."""
    kept = lines.where("text is not null and text <> ''")
    kids = F.array_sort(F.collect_list(F.struct(*order, "text")))
    return kept.groupBy(*parent).agg(F.array_join(F.transform(kids, lambda k: k["text"]), " ").alias("text"), F.avg("score").alias("score"), F.count("*").alias("n"))
