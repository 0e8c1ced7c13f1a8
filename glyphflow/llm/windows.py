"""Repeated windows of symbol sequences, counted inside runs that share a minimiser.

A run is a stretch of consecutive windows with the same minimiser (the smallest hashed gram of a window, leftmost on ties):
a path of the de Bruijn graph whose edges are the windows. It is named by its minimiser and a 128-bit BLAKE2b digest of all
its bytes, so a passage met a million times is one row with a count. Where a minimiser has only one path, that path has no
branch and all its windows repeat exactly if its count is over one. Where a minimiser has several paths (the branches),
one source of each is read again and its windows are judged apart, weighted with the counts of their paths. Equal windows
have equal minimisers, so nothing is missed; only distinct runs, never groups of copies, are expanded. The repeated offsets
of every path go back to all source coordinates.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Rolling, Scratch, WordHashes, mix

_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


@dataclass(frozen=True)
class Shape:
    """Windows of ``width`` symbols (``unit``: word or byte) with minimisers of ``gram`` symbols."""

    unit: str
    width: int
    gram: int


class Sequence:
    """Symbols of one text, its windows and their digests."""

    def __init__(self, text: str | None, shape: Shape, memo: WordHashes):
        self.raw, self.shape = b"" if text is None else text.encode(), shape
        if shape.unit == "word":
            self.words = self.raw.split()
            self.size = len(self.words)
        else:
            self.size = len(self.raw)
        self.enough = self.size >= shape.width
        if self.enough and shape.unit == "word":
            self.memo, self.flat = memo, b" ".join(self.words)
            self.end = np.cumsum(np.fromiter(map(len, self.words), np.int64, self.size) + 1) - 1
            self.begin = np.append(0, self.end[:-1] + 1)
        elif self.enough:
            self.flat = self.raw

    @property
    def symbols(self) -> np.ndarray:
        return self.memo.of(self.words) if self.shape.unit == "word" else _BYTE[np.frombuffer(self.raw, np.uint8)]

    def paths(self):
        """start, number of windows, minimiser, its place after start, two halves of the digest of every path."""
        s = self.shape
        keys = mix(Rolling(self.symbols).windows(s.gram))
        at, span, have = np.arange(len(keys)), s.width - s.gram + 1, 1
        while have < span:
            step = min(have, span - have)
            a, b = at[:-step], at[step:]
            at = np.where(keys[a] <= keys[b], a, b)
            have += step
        start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        count = np.diff(np.append(start, len(at)))
        h = self.digests(start, start + count - 1 + s.width)
        return start, count, keys[at[start]], at[start] - start, h[:, 0], h[:, 1]

    def digests(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """128-bit digests of spans of symbols, as two columns."""
        if self.shape.unit == "word":
            start, end = self.begin[start], self.end[end - 1]
        flat = self.flat
        got = b"".join([blake2b(flat[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist())])
        return np.frombuffer(got, np.int64).reshape(-1, 2)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


_PATH = ["mini", "h1", "h2", "count", "at"]
#: Rows to an Arrow batch, about.
ROWS = 20_000


class Rows:
    """Columns of longs from many texts, sent as few batches: each costs a fixed time on both sides."""

    def __init__(self, names: list[str]):
        self.names, self.parts, self.held = names, [], 0

    def add(self, columns: list[np.ndarray]):
        self.parts.append(columns)
        self.held += len(columns[0])
        if self.held >= ROWS:
            yield from self.rest()

    def rest(self):
        if self.parts:
            yield pa.RecordBatch.from_arrays([_long(np.concatenate(c)) for c in zip(*self.parts)], self.names)
            self.parts, self.held = [], 0


def by_digest(again: DataFrame, shape: Shape, scratch: Scratch) -> DataFrame:
    """Paths with their repeated offsets, by the digests of all windows. ``again``: text, starts (array of its paths)."""
    names = [*_PATH, "off", "w1", "w2", "n"]

    def windows(batches):
        memo, rows = WordHashes(), Rows(names)
        for b in batches:
            for text, starts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                count = np.array([x["count"] for x in starts])
                off = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                of = {c: np.repeat(np.array([x[c] for x in starts], np.int64), count) for c in ["start", *_PATH, "n"]}
                w = Sequence(text, shape, memo).digests(of["start"] + off, of["start"] + off + shape.width)
                yield from rows.add([*[of[c] for c in _PATH], off, w[:, 0], w[:, 1], of["n"]])
        yield from rows.rest()

    apart = scratch.keep(again.mapInArrow(windows, ", ".join(f"{c} long" for c in names)))
    # A window common to many paths is counted before the shuffle and joined back: its paths never meet in one task.
    multiple = scratch.keep(apart.groupBy("w1", "w2").agg(F.sum("n").alias("t")).where("t > 1").drop("t"))
    out = scratch.keep(apart.join(multiple, ["w1", "w2"]).groupBy(*_PATH).agg(F.collect_list("off").alias("offs")))
    scratch.drop(apart, multiple)
    return out


def repeated(spark: SparkSession, texts: DataFrame, shape: Shape, scratch: Scratch, branches=by_digest) -> DataFrame:
    """rid, hits (array of paths with their repeated offsets) of rows with any. ``texts``: rid, text; ``branches`` judges the
    windows of paths that share their minimiser with other paths."""

    def paths(batches):
        memo, rows = WordHashes(), Rows(["rid", "start", *_PATH])
        for b in batches:
            for rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                q = Sequence(text, shape, memo)
                if q.enough:
                    start, count, mini, at, h1, h2 = q.paths()
                    yield from rows.add([np.full(len(start), rid, np.int64), start, mini.view(np.int64), h1, h2, count, at])
        yield from rows.rest()

    longs = ", ".join(f"{c} long" for c in ["rid", "start", *_PATH])
    found = scratch.keep(texts.mapInArrow(paths, longs))
    distinct = scratch.keep(found.groupBy(*_PATH).agg(F.count("*").alias("n"), F.min(F.struct("rid", "start")).alias("src")))
    group = distinct.groupBy("mini").agg(F.count("*").alias("branches"), F.sum("n").alias("total")).where("total > 1")
    marked = scratch.keep(distinct.join(group, "mini"))
    scratch.drop(distinct)
    straight = marked.where("branches = 1").select(*_PATH, F.lit(None).cast("array<long>").alias("offs"))
    starts = marked.where("branches > 1").select(F.col("src.rid").alias("rid"), F.struct(F.col("src.start").alias("start"), *_PATH, "n", "branches").alias("s"))
    starts = starts.groupBy("rid").agg(F.collect_list("s").alias("starts"))
    branched = branches(texts.join(starts, "rid").select("text", "starts"), shape, scratch)
    every = scratch.keep(straight.unionByName(branched))
    scratch.drop(marked)
    hits = found.join(every, _PATH).select("rid", F.struct("start", "count", "offs").alias("h"))
    out = scratch.keep(hits.groupBy("rid").agg(F.collect_list("h").alias("hits")))
    scratch.drop(found, every)
    return out


def cover(size: int, hits: list[dict] | None, shape: Shape) -> np.ndarray:
    """Which of ``size`` symbols a repeated window covers."""
    if not hits:
        return np.zeros(size, bool)
    at = np.concatenate([h["start"] + (np.arange(h["count"]) if h["offs"] is None else np.asarray(h["offs"], np.int64)) for h in hits])
    edge = np.bincount(at, minlength=size + 1) - np.bincount(at + shape.width, minlength=size + 1)
    return np.cumsum(edge[:-1]) > 0


def cut(spark: SparkSession, docs: DataFrame, shape: Shape, doc_id: str = "doc_id", text: str = "text", branches=by_digest) -> DataFrame:
    """doc_id, n (symbols), n_removed, n_spans, kept_sha256 and kept (binary) of every row."""
    scratch = Scratch(spark)
    rows = scratch.keep(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    hits = repeated(spark, rows.select("rid", "text"), shape, scratch, branches)

    def apply(batches):
        import hashlib

        for b in batches:
            out = []
            if not b.num_rows:
                continue
            for did, t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = b"" if t is None else t.encode()
                seq = raw.split() if shape.unit == "word" else np.frombuffer(raw, np.uint8)
                gone = cover(len(seq), h, shape)
                if shape.unit == "word":
                    kept = b" ".join(w for w, g in zip(seq, gone.tolist()) if not g) if h else b" ".join(seq)
                else:
                    kept = seq[~gone].tobytes() if h else raw
                spans = int(np.count_nonzero(gone & ~np.append(False, gone[:-1]))) if len(gone) else 0
                out.append((did, len(seq), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], ["doc_id", "n", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = rows.join(hits, "rid", "left").select("doc_id", "text", "hits")
    # The table of texts and hits stays until the session's folder goes: the frame returned reads it.
    return joined.mapInArrow(apply, "doc_id long, n long, n_removed long, n_spans long, kept_sha256 string, kept binary")
