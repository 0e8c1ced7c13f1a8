"""Texts and sizes of boxes inside boxes, to any depth up to MOST.

A tree is a row a box: tree_id, node_id, parent_id (null: a root), ord (its place among its siblings), x0, y0, x1, y1, text.
The children of a box are read in the order of their first child's orientation: across top to bottom, then left to right; down
right to left, then top to bottom. The order of a whole tree is then that of the paths of its leaves.

A tree of at most NODES boxes is one row of one task, and a level is one vector operation on all trees of a batch, so boxes are
shuffled once. In larger trees a level is one equi-join on the parent and the tree is put together by one aggregation; their
boxes never meet in one task. Which way is taken changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .lineage import cut

#: Levels of a tree, and boxes of a tree up to which one task puts it together.
MOST, NODES = 16, 1 << 12
_STEP = "struct<a:bigint,b:bigint,ord:bigint>"


def ordered_children(tree: DataFrame) -> DataFrame:
    """Every box below a root with step (its sort key among its siblings) and of (how many siblings, itself included)."""
    kids = Window.partitionBy("tree_id", "parent_id")
    down = F.min_by(g.vertical(), F.col("ord")).over(kids)
    a, b = F.when(down, -g.center_x()).otherwise(g.center_y()), F.when(down, g.center_y()).otherwise(g.center_x())
    step = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), F.col("ord").cast("long").alias("ord")).cast(_STEP)
    return tree.where("parent_id is not null").select("*", step.alias("step"), F.count("*").over(kids).alias("of"))


def leaves(tree: DataFrame) -> DataFrame:
    """tree_id, root_id, path (steps from the root), share (one over the numbers of siblings on the path), size, text of every box
    that ends a path: it has no children, or (for text only, ``stops``) text of its own."""
    kids = cut(ordered_children(tree))
    inner = kids.select("tree_id", F.col("parent_id").alias("node_id")).distinct().withColumn("inner", F.lit(True))
    size = F.least(g.width(), g.height()).cast("double")
    at = tree.where("parent_id is null").select("tree_id", F.col("node_id").alias("root_id"), "node_id", F.array().cast(f"array<{_STEP}>").alias("path"), F.lit(1.0).alias("share"), size.alias("size"), "text", F.lit(False).alias("spoken"))
    out = None
    for _ in range(MOST + 1):
        at = at.join(inner, ["tree_id", "node_id"], "left").withColumn("inner", F.coalesce("inner", F.lit(False)))
        here = at.where(~F.col("inner") | (~F.col("spoken") & (F.coalesce("text", F.lit("")) != "")))
        here = here.select("tree_id", "root_id", "path", "share", "size", F.when(~F.col("spoken"), F.col("text")).alias("text"), (~F.col("inner")).alias("leaf"))
        out = here if out is None else out.unionByName(here)
        above = at.where("inner").select("tree_id", "root_id", F.col("node_id").alias("parent_id"), "path", "share", (F.col("spoken") | (F.coalesce("text", F.lit("")) != "")).alias("spoken"))
        at = above.join(kids, ["tree_id", "parent_id"]).select("tree_id", "root_id", "node_id", F.concat("path", F.array("step")).alias("path"), (F.col("share") / F.col("of")).alias("share"), size.alias("size"), "text", "spoken")
        at = cut(at)
        if at.isEmpty():
            return out
    raise ValueError(f"a tree is deeper than {MOST} levels, or no tree")


_BOX = ("node_id", "parent_id", "ord", "x0", "y0", "x1", "y1")
_NONE = np.iinfo(np.int64).min


def _codes(*keys: np.ndarray) -> np.ndarray:
    """Numbers of the rows of ``keys`` in their order; equal rows have one number."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.zeros(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _folded(of: np.ndarray, v: dict[str, np.ndarray], null: dict[str, np.ndarray], text: np.ndarray, trees: int) -> tuple[np.ndarray, dict[str, list]]:
    """Which trees are too deep, and tree, root_id, text, size, leaves of the roots of the others. ``of``: the tree of each box;
    ``v``, ``null``: values of _BOX and where they are null."""
    lost = {a: null[a + "0"] | null[a + "1"] for a in "xy"}
    w, h = v["x1"] - v["x0"], v["y1"] - v["y0"]
    size = np.where(lost["x"], h, np.where(lost["y"], w, np.minimum(w, h))).astype(np.float64)
    sized = ~(lost["x"] & lost["y"])
    half = {a: (lambda s: (s + (s < 0)) >> 1)(v[a + "0"] + v[a + "1"]) for a in "xy"}
    child = np.flatnonzero(~null["parent_id"])
    names = _codes(np.concatenate([of, of[child]]), np.concatenate([v["node_id"], v["parent_id"][child]]))
    node, parent = np.where(null["node_id"], -1, names[: len(of)]), names[len(of) :]
    # The child with the least ord tells the way of its siblings; as in Spark, null is no least ord, and sorts first in steps.
    asked = ~null["ord"][child]
    first = child[asked][np.lexsort((v["ord"][child][asked], parent[asked]))]
    owner, where = np.unique(np.sort(parent[asked]), return_index=True)
    down = np.zeros(names.max(initial=-1) + 1, bool)
    down[owner] = ((h > w) & ~lost["x"] & ~lost["y"])[first[where]]
    turned, (x, y) = down[parent], (np.where(lost[a], _NONE, half[a])[child] for a in "xy")
    rank = _codes(np.where(turned, np.where(x == _NONE, _NONE, -x), y), np.where(turned, y, x), np.where(null["ord"], _NONE, v["ord"])[child])
    order = np.argsort(parent, kind="stable")
    kids, rank, by = child[order], rank[order], parent[order]
    # A level at a time, from the roots down.
    here = np.flatnonzero(null["parent_id"])
    root, share, spoken, path = here, np.ones(len(here)), np.zeros(len(here), bool), np.zeros((len(here), 0), np.int64)
    said, deep, ends = np.array([bool(t) for t in text], bool), np.zeros(trees, bool), []
    for level in range(MOST + 1):
        low, high = np.searchsorted(by, node[here], "left"), np.searchsorted(by, node[here], "right")
        inner = high > low
        out = ~inner | (~spoken & said[here])
        ends.append((root[out], here[out], share[out], spoken[out], ~inner[out], np.pad(path[out], ((0, 0), (0, MOST + 1 - level)), constant_values=-1)))
        many = (high - low)[inner]
        up = np.repeat(np.flatnonzero(inner), many)
        to = np.arange(len(up)) + np.repeat(low[inner] - np.cumsum(many) + many, many)
        root, share, spoken, path = root[up], share[up] / np.repeat(many, many), (spoken | said[here])[up], np.column_stack([path[up], rank[to]])
        here = kids[to]
        if not len(here):
            break
    deep[of[here]] = True
    root, end, share, spoken, leaf, path = (np.concatenate(x) for x in zip(*ends))
    top = _codes(of[root], null["node_id"][root], v["node_id"][root])
    one = np.zeros(top.max(initial=-1) + 1, np.int64)
    one[top] = root
    sizes, known, leaves = np.bincount(top, np.where(leaf & sized[end], size[end] * share, 0)), np.bincount(top, leaf & sized[end]), np.bincount(top, leaf)
    told = np.flatnonzero(~spoken & said[end])
    words: list[list[str]] = [[] for _ in one]
    for j in told[np.lexsort((text[end[told]].astype(str), *path[told].T[::-1], top[told]))] if len(told) else ():
        words[top[j]].append(text[end[j]])
    kept = np.flatnonzero(~deep[of[one]])
    at = one[kept]
    ids = [None if n else k for k, n in zip(v["node_id"][at].tolist(), null["node_id"][at])]
    return deep, {"tree": of[at].tolist(), "root_id": ids, "text": [" ".join(words[k]) for k in kept], "size": [sizes[k] if known[k] else None for k in kept], "leaves": leaves[kept].astype(int).tolist()}


def _by_tree(trees: DataFrame) -> DataFrame:
    """tree_id, root_id, text, size, leaves, apart of ``trees`` (tree_id, kids): a tree without kids, or too deep, is one row with apart."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, kids = b.column("tree_id"), b.column("kids")
            of, flat = pc.list_parent_indices(kids).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(kids)
            fields = {c: pc.struct_field(flat, c) for c in (*_BOX, "text")}
            v = {c: pc.fill_null(fields[c], 0).to_numpy(zero_copy_only=False) for c in _BOX}
            null = {c: pc.is_null(fields[c]).to_numpy(zero_copy_only=False) for c in _BOX}
            text = np.empty(len(of), object)
            text[:] = pc.fill_null(fields["text"], "").to_pylist()
            deep, got = _folded(of, v, null, text, len(ids))
            apart = np.flatnonzero(deep | pc.is_null(kids).to_numpy(zero_copy_only=False)).tolist()
            rest = {c: pa.array(got[c] + [None] * len(apart), t) for c, t in (("root_id", pa.int64()), ("text", pa.string()), ("size", pa.float64()), ("leaves", pa.int64()))}
            yield pa.RecordBatch.from_pydict({"tree_id": ids.take(pa.array(got.pop("tree") + apart, pa.int64())), **rest, "apart": pa.array([False] * (len(rest["text"]) - len(apart)) + [True] * len(apart))})

    return trees.mapInArrow(fold, f"tree_id {trees.schema['tree_id'].dataType.simpleString()}, root_id long, text string, size double, leaves long, apart boolean")


def _by_levels(tree: DataFrame) -> DataFrame:
    kids = F.array_sort(F.collect_list(F.when(F.coalesce("text", F.lit("")) != "", F.struct("path", "text"))))
    text = F.array_join(F.transform(kids, lambda k: k["text"]), " ")
    return leaves(tree).groupBy("tree_id", "root_id").agg(text.alias("text"), F.sum(F.when(F.col("leaf"), F.col("size") * F.col("share"))).alias("size"), F.count_if("leaf").alias("leaves"))


def nested(tree: DataFrame, most: int = NODES) -> DataFrame:
    """tree_id, root_id, text (of the leaves in order, by spaces; a box with text of its own speaks for all inside it), size (mean over
    children of their sizes, recursively), leaves (how many) of every root."""
    # A box over the limit tells a larger tree, whose other boxes are not gathered here: it goes by levels.
    few = tree.withColumn("__nth", F.row_number().over(Window.partitionBy("tree_id").orderBy("node_id"))).where(F.col("__nth") <= most + 1)
    box = F.struct(*[F.col(c).cast("long").alias(c) for c in _BOX], F.col("text").cast("string").alias("text"))
    trees = few.groupBy("tree_id").agg(F.collect_list(box).alias("kids"))
    done = cut(_by_tree(trees.select("tree_id", F.when(F.size("kids") <= most, F.col("kids")).alias("kids"))))
    out, apart = done.where("not apart").drop("apart"), done.where("apart").select("tree_id").distinct()
    return out if apart.isEmpty() else out.unionByName(_by_levels(tree.join(apart.hint("merge"), "tree_id", "left_semi")))
