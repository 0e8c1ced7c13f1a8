"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints of all texts are reduced to distinct values. Their 64 bits are grouped into m parts, bits that go together
in one part; every part i gets a threshold T_i of -1 (skipped) or more with sum T_i = tau - m + 1, so two fingerprints
within tau bits differ by at most T_i bits in some part i. A dynamic program picks the T_i (and m) that cost least:
probes plus expected candidates, estimated from the bit statistics of all distinct fingerprints (a 64 x 64 table).
Every fingerprint is stored once per part and probes the keys within T_i of its own; candidates are verified by their
distance inside the join, and links become components by contraction.

Large groups: before the probe join, members of one stored key link to the smallest fingerprint there (a star) where
they are within tau; the join then looks only for links between different components.

Defined cases: null or blank text has fingerprint zero and links like any other; repeated rows share a fingerprint; an
empty table gives an empty table; null doc_id never names a component unless it is alone; very long texts are read whole,
hashed in slices; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, any_columns, drop_rows, row_digest, table
from .components import components

TAU, WORDS, SEED = 4, 4, 42


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint of one text, as a signed 64-bit integer."""
    import xxhash

    w = [] if text is None else text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not w:
        return 0
    digest, join, n = xxhash.xxh64_intdigest, b" ".join, max(1, len(w) - words + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.fromiter((digest(join(w[i : i + words]), seed) for i in range(at, min(n, at + (1 << 16)))), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", further: Sequence[Column] = ()) -> DataFrame:
    """doc_id, ``further`` columns, fp (long) of every row."""

    @F.pandas_udf("long")
    def of(t: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x) for x in t], dtype="int64")

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), *further, of(F.col(text)).alias("fp"))


def bit_table(fps: DataFrame) -> tuple[np.ndarray, int]:
    """Probability that bits i and j are both set, over all fingerprints; their number. Bounded: 64 x 64 sums per task."""

    def part(frames):
        total, n = np.zeros((64, 64)), 0
        for f in frames:
            bits = np.unpackbits(f["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total, n = total + bits.T @ bits, n + len(bits)
        yield pd.DataFrame({"i": np.arange(4097), "s": np.append(total.ravel(), n)})

    got = fps.mapInPandas(part, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(4097)
    for r in got:
        out[r["i"]] = r["s"]
    n = int(out[4096])
    return out[:4096].reshape(64, 64) / max(n, 1), n


def parts_of(both: np.ndarray, m: int) -> list[list[int]]:
    """Bits in m parts of nearly equal size: each part starts with a free bit and takes the bits most correlated with it."""
    p = np.diag(both)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    cor = np.abs((both - np.outer(p, p)) / np.outer(sd, sd))
    free, out = set(range(64)), []
    for k in range(m):
        size = 64 // m + (k < 64 % m)
        have = [min(free)]
        free.discard(have[0])
        while len(have) < size:
            best = max(sorted(free), key=lambda b: cor[b, have].sum())
            have.append(best)
            free.discard(best)
        out.append(sorted(have))
    return out


def allocation(both: np.ndarray, n: int, tau: int = TAU, most_probes: int = 600) -> tuple[list[list[int]], list[int]]:
    """Parts and thresholds of least estimated cost, by dynamic programming over the parts for every m from 2 to tau + 1."""
    p = np.diag(both)
    same = p**2 + (1 - p) ** 2
    best = None
    for m in range(2, tau + 2):
        parts = parts_of(both, m)
        cost = []
        for bits in parts:
            dist = np.array([1.0])  # distribution of the distance in this part, bits taken as independent
            for b in bits:
                dist = np.append(dist * same[b], 0) + np.append(0, dist * (1 - same[b]))
            row = {-1: 0.0}
            for t in range(tau + 1):
                probes = sum(comb(len(bits), d) for d in range(t + 1))
                if probes <= most_probes:
                    row[t] = 4.0 * n * probes + n * n * dist[: t + 1].sum() / 2
            cost.append(row)
        state = {0: (0.0, [])}
        for row in cost:
            nxt: dict[int, tuple[float, list[int]]] = {}
            for used, (c, ts) in state.items():
                for t, x in row.items():
                    key = used + t
                    if key not in nxt or c + x < nxt[key][0]:
                        nxt[key] = (c + x, [*ts, t])
            state = nxt
        got = state.get(tau - m + 1)
        if got and (best is None or got[0] < best[0]):
            best = (got[0], parts, got[1])
    return best[1], best[2]


def _flip(part: int, key: Column):
    return lambda x: F.struct(F.lit(part).alias("part"), key.bitwiseXOR(x).alias("key"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(spark: SparkSession, fps: DataFrame, scratch: Scratch, tau: int = TAU) -> DataFrame:
    """a, b of links that join everything joined by distances up to tau. ``fps``: distinct fp."""
    both, n = bit_table(fps)
    if n < 2:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    parts, ts = allocation(both, n, tau)
    use = [(k, sum(1 << b for b in bits), bits, t) for k, (bits, t) in enumerate(zip(parts, ts)) if t >= 0]
    far = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    at = F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key")) for k, mask, _, _ in use])
    stored = fps.select("fp", F.explode(at).alias("s")).select("s.part", "s.key", F.col("fp").alias("b"))
    heads = stored.groupBy("part", "key").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    star = scratch.keep(stored.join(heads, ["part", "key"]).where((F.col("a") != F.col("b")) & (far <= tau)).select("a", "b").distinct())
    label = scratch.keep(components(star, scratch))
    known = scratch.keep(fps.join(label.select(F.col("v").alias("fp"), "label"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("label")))
    stored = known.select(F.col("fp").alias("b"), F.col("label").alias("lb"), F.explode(at).alias("s")).select("s.part", "s.key", "b", "lb")
    flips = []
    for k, mask, bits, t in use:
        masks = [_signed(sum(1 << b for b in c)) for d in range(t + 1) for c in combinations(bits, d)]
        key = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        flips.append(F.transform(F.array(*[F.lit(x).cast("long") for x in masks]), _flip(k, key)))
    probes = known.select(F.col("fp").alias("a"), F.col("label").alias("la"), F.explode(F.concat(*flips)).alias("s")).select("s.part", "s.key", "a", "la")
    found = probes.join(stored, (probes["part"] == stored["part"]) & (probes["key"] == stored["key"]) & (F.col("la") != F.col("lb")) & (far <= tau))
    return star.unionByName(found.select("a", "b"))


def _labelled(scratch: Scratch, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, sha (digest of the text), fp, label (of the component), component_id of every row."""
    rows = scratch.keep(fingerprints(docs, doc_id, text, [row_digest(F.col(text)).alias("sha")]))
    fps = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = scratch.keep(links(scratch.spark, fps.select("fp"), scratch).distinct())
    label = components(edges, scratch)
    named = fps.join(label.withColumnRenamed("v", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    names = scratch.keep(named.join(least, "label").select("fp", "label", "component_id"))
    return rows.join(names, "fp")


def clusters(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id of every row."""
    return _labelled(Scratch(spark), docs, doc_id, text).select("doc_id", "fp", "component_id")


@any_columns
def dedup(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", verified: bool = False) -> DataFrame:
    """The first row of every component, all columns. ``verified``: components of texts alike in their shingles
    (``nearcopies``), for which fingerprints give the candidates that they can; else links of fingerprints alone."""
    if verified:
        from . import nearcopies

        return nearcopies.dedup(spark, docs, doc_id, text)
    scratch = Scratch(spark)
    return drop_rows(docs, _labelled(scratch, docs, doc_id, text), scratch, doc_id, text)


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clusters(spark, table(spark, sf_dir, "documents"))
    return c.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
