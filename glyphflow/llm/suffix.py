"""Removal of every byte covered by a 200-byte string that starts anywhere else, by deep-shallow suffix sorting.

Candidates: runs of windows that share their minimiser (``windows``), one copy of each distinct run with its count. A
minimiser with a single run needs no order. The runs of every other minimiser are a bucket, and equal strings lie in one
bucket at the same distance from the minimiser. What follows the minimiser's start in each run is a suffix, and what
precedes it, read backwards, another; both are ordered by multikey quicksort over words of 8 bytes down to a shallow
depth, and each group still together there has a long common prefix and is ordered by a blind trie. From the two orders and
the common prefixes of neighbours, two strings with l bytes before the minimiser are equal exactly if their runs fall into
one class of the first l bytes backwards and one class of the remaining bytes onward. A class met more than once, counts
included, is repeated. Bytes, not hashes, decide.

Buckets of over MOST runs are parted over the cluster before they are ordered: the range of l is halved, and each half keys
its strings by the bytes that all of them hold (multikey partitioning). A part still too large is halved again, until one l
is left, whose strings are grouped as they are. Nothing is dropped on any way, and no bucket grows in one task.

Defined cases: null text is empty; a text under 200 bytes keeps all; repeated rows remove each other, as do ties within a
text; very long texts are read whole; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, table
from .windows import Shape, cut

SHAPE = Shape("byte", 200, 32)
MOST, SHALLOW, CHUNK = 1024, 8, 8 << 20

_KEY = ["mini", "h1", "h2", "count", "at"]
_RUN = [*_KEY, "n"]


def shallow(words: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multikey quicksort of suffixes down to ``depth`` words of 8 bytes, all groups side by side.

    ``words``: the big-endian word at every byte; ``group``: nondecreasing. Returns the suffixes in order, the first slot
    of the group of each, and its depth; groups of one suffix stop early.
    """
    order, first, deep = starts.copy(), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    live = np.arange(len(starts))
    edge = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else live
    size = np.diff(np.append(edge, len(live)))
    while True:
        first[live] = np.repeat(live[edge], size)
        stay = np.repeat(size, size) > 1
        stay &= deep[live] < depth
        live = live[stay]
        if not len(live):
            return order, first, deep
        g = first[live]
        edge = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        size = np.diff(np.append(edge, len(live)))
        key = words[order[live] + 8 * deep[live]]
        pivot = np.repeat(key[edge + size // 2], size)
        part = np.repeat(3 * np.arange(len(edge)), size) + (key >= pivot) + (key > pivot)
        by = np.argsort(part, kind="stable")
        part = part[by]
        order[live], deep[live] = order[live][by], deep[live][by] + (part % 3 == 1)
        edge = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        size = np.diff(np.append(edge, len(live)))


class BlindTrie:
    """Branch positions and branch bytes only; an insertion descends blindly and compares with the one leaf it reaches."""

    def __init__(self):
        self.root = None  # a leaf is (key, members), a branch [position, {byte: child}]

    def add(self, key: bytes, member: int) -> None:
        node = self.root
        if node is None:
            self.root = (key, [member])
            return
        while type(node) is list:
            kids = node[1]
            node = kids.get(key[node[0]]) or next(iter(kids.values()))
        other = node[0]
        if key == other:
            node[1].append(member)
            return
        gap = int.from_bytes(key, "big") ^ int.from_bytes(other, "big")
        at = len(key) - (gap.bit_length() + 7) // 8
        above, node = None, self.root
        while type(node) is list and node[0] < at:
            above, node = node, node[1][key[node[0]]]
        leaf = (key, [member])
        if type(node) is list and node[0] == at:
            node[1][key[at]] = leaf
            return
        branch = [at, {key[at]: leaf, other[at]: node}]
        if above is None:
            self.root = branch
        else:
            above[1][key[above[0]]] = branch

    def leaves(self) -> Iterator[list[int]]:
        """Members of every leaf, in the order of keys."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if type(node) is list:
                stack.extend(child for _, child in sorted(node[1].items(), reverse=True))
            else:
                yield node[1]


def ordered(strings: list[bytes], group: np.ndarray, width: int, depth: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Strings in order within their groups (nondecreasing), by their first ``width`` bytes, zeros behind short ones; and how
    many bytes each shares with the one before it, -1 at the start of a group."""
    size = -(-max(width, 8 * depth) // 8) * 8
    raw = b"".join([x[:width].ljust(size, b"\0") for x in strings])
    flat = np.frombuffer(raw, np.uint8).reshape(len(strings), size)
    words = np.zeros(len(raw), np.uint64)
    words[::8] = np.frombuffer(raw, ">u8")
    order, first, _ = shallow(words, np.arange(len(strings)) * size, group, depth)
    order //= size
    edge = np.flatnonzero(np.append(True, first[1:] != first[:-1])) if len(first) else np.zeros(0, np.int64)
    for a, b in zip(edge.tolist(), np.append(edge[1:], len(order)).tolist()):
        if b - a > 1:
            trie = BlindTrie()
            for k in order[a:b].tolist():
                trie.add(raw[k * size + 8 * depth : k * size + size], k)
            order[a:b] = [k for leaf in trie.leaves() for k in leaf]
    far = flat[order]
    differ = far[1:] != far[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), size)
    shared[group[order][1:] != group[order][:-1]] = -1
    return order, np.append(-1, shared)[: len(order)]


def repeats(pieces: list[bytes], at: np.ndarray, count: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray, group: np.ndarray, width: int) -> list[np.ndarray]:
    """For every run the offsets of its strings that are repeated within its group. ``at``: place of the minimiser in the piece;
    only strings with ``low`` to ``high`` bytes before it count."""
    k = len(pieces)
    onward, share_on = ordered([p[a:] for p, a in zip(pieces, at.tolist())], group, width)
    back, share_back = ordered([p[:a][::-1] for p, a in zip(pieces, at.tolist())], group, width)
    least, most = np.maximum(low, at - count + 1), np.minimum(high, at)
    class_on, class_back, hits = np.zeros(k, np.int64), np.zeros(k, np.int64), []
    for left in range(int(least.min()), int(most.max()) + 1) if k else ():
        here = np.flatnonzero((least <= left) & (left <= most))
        if not len(here):
            continue
        class_on[onward], class_back[back] = np.cumsum(share_on < width - left), np.cumsum(share_back < left)
        key = class_back[here] * (k + 1) + class_on[here]
        by = np.argsort(key, kind="stable")
        edge = np.flatnonzero(np.append(True, key[by][1:] != key[by][:-1]))
        total = np.add.reduceat(weight[here][by], edge)
        twice = here[by][np.repeat(total > 1, np.diff(np.append(edge, len(by))))]
        hits.append((twice, at[twice] - left))
    run = np.concatenate([r for r, _ in hits]) if hits else np.zeros(0, np.int64)
    off = np.concatenate([o for _, o in hits]) if hits else np.zeros(0, np.int64)
    by = np.lexsort((off, run))
    return np.split(off[by], np.searchsorted(run[by], np.arange(1, k)))


def _judge(rows: list[dict], width: int) -> pa.RecordBatch:
    """Runs of whole buckets, with the offsets of their repeated strings."""
    col = lambda c: np.array([r[c] for r in rows], np.int64)
    bucket = col("bucket")
    got = repeats([r["piece"] for r in rows], col("at"), col("count"), col("n"), col("low"), col("high"), np.cumsum(np.append(0, bucket[1:] != bucket[:-1])), width)
    out = [(*(r[c] for c in _KEY), off.tolist()) for r, off in zip(rows, got) if len(off)]
    kinds = [pa.int64()] * len(_KEY) + [pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], [*_KEY, "offs"])


def _parted(runs: DataFrame, shape: Shape, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """Parts of large buckets that are small enough to order, and the paths judged on the way down to a single l."""
    rest, small = shape.width - shape.gram, []
    while True:
        middle = F.expr("(low + high) div 2")
        half = F.explode(F.array(F.struct(F.col("low").alias("l"), middle.alias("h")), F.struct((middle + 1).alias("l"), F.col("high").alias("h")))).alias("half")
        parts = runs.where("low < high").select(*_RUN, "piece", half).select(*_RUN, "piece", F.col("half.l").alias("low"), F.col("half.h").alias("high"))
        parts = parts.where("low <= high and low <= at and high >= at - count + 1")
        held = F.expr(f"substring(piece, cast(at - low + 1 as int), cast(low + {shape.gram} + {rest} - high as int))")
        parts = scratch.keep(parts.withColumn("bucket", F.xxhash64("mini", "low", "high", held)))
        large = scratch.keep(parts.groupBy("bucket").count().where(F.col("count") > MOST).select("bucket"))
        small.append(parts.join(large, "bucket", "left_anti"))
        runs = scratch.keep(parts.join(large, "bucket", "left_semi"))
        if runs.where("low < high").isEmpty():
            break
    string = F.expr(f"substring(piece, cast(at - low + 1 as int), {shape.width})")
    one = runs.where("low = high").withColumn("string", string)
    twice = one.groupBy("string").agg(F.sum("n").alias("t")).where("t > 1").drop("t")
    return small, one.join(scratch.keep(twice), "string").select(*_KEY, F.array(F.col("at") - F.col("low")).alias("offs"))


def by_order(again: DataFrame, shape: Shape, scratch: Scratch) -> DataFrame:
    """As ``windows.by_digest``, judged by the order of suffixes."""
    width, rest = shape.width, shape.width - shape.gram

    def pieces(batches):
        for b in batches:
            out = []
            for text, starts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = text.encode()
                out.extend({**{c: x[c] for c in [*_RUN, "branches"]}, "piece": raw[x["start"] : x["start"] + x["count"] - 1 + width]} for x in starts)
            yield pa.RecordBatch.from_pylist(out, pa.schema([*((c, pa.int64()) for c in [*_RUN, "branches"]), ("piece", pa.binary())]))

    def judge(batches):
        rows, held = [], 0
        for b in batches:
            for r in b.to_pylist():
                if held >= CHUNK and r["bucket"] != rows[-1]["bucket"]:  # a bucket is never parted
                    yield _judge(rows, width)
                    rows, held = [], 0
                rows.append(r)
                held += len(r["piece"])
        if rows:
            yield _judge(rows, width)

    names = [*_RUN, "piece", "low", "high", "bucket"]
    runs = scratch.keep(again.mapInArrow(pieces, ", ".join(f"{c} long" for c in [*_RUN, "branches"]) + ", piece binary"))
    runs = runs.withColumn("low", F.lit(0).cast("long")).withColumn("high", F.lit(rest).cast("long"))
    small, tail = [runs.where(F.col("branches") <= MOST).withColumn("bucket", F.col("mini")).select(names)], None
    large = runs.where(F.col("branches") > MOST)
    if not large.isEmpty():
        more, tail = _parted(large, shape, scratch)
        small += [m.select(names) for m in more]
    every = small[0]
    for m in small[1:]:
        every = every.unionByName(m)
    out = every.repartition("bucket").sortWithinPartitions("bucket", "h1", "h2").mapInArrow(judge, ", ".join(f"{c} long" for c in _KEY) + ", offs array<long>")
    if tail is None:
        return out
    return out.unionByName(tail).groupBy(*_KEY).agg(F.flatten(F.collect_list("offs")).alias("offs"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cut(spark, table(spark, sf_dir, "documents"), SHAPE, branches=by_order)
    return c.select("doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")
