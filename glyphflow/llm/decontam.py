"""Benchmark decontamination by spaced seeds that no allowed pattern escapes.

A document is contaminated if some stretch of at least LEAST tokens (the whole item, where shorter) agrees with an item in
SIMILAR of its positions. Fixed MASKS read four tokens and ignore selected positions between them: whatever a fifth of the
tokens of a stretch is, and wherever, one mask still reads four that agree (test: every length from 5 to 120, by the least
number of substitutions that leaves no hit; longer stretches hold such a block). Items under five tokens must agree in all,
so their mask is the item. Recall is whole for substitutions at any place; insertions and deletions end a stretch.

Seeds of the items are rows of a table. Every position of every whole document is hashed under every mask; a sieve of fixed
size (2**SIEVE bits, two probes), filled from that table, only spares rows that can join nothing. What passes joins the seed
table in Spark, and around each joint hit document and item are laid side by side and the stretch is verified. Texts
without any hit are never shuffled, and neither documents nor benchmark come to the driver.

Tokens: runs of letters and digits, lower-cased.

Defined cases: null or empty texts and items have no tokens and match nothing; an item of few tokens matches wherever they
stand in a row; repeated rows each get theirs; null item ids match and are named null; ties: all items are named, in order;
very long texts are read whole; an empty benchmark leaves all clean; further columns pass through ``clean``.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, WordHashes, any_columns, blob_id, mix, table

# The masks; 1 reads a token, 0 ignores it. The first four are for stretches of five tokens or more.
MASKS = ("1111", "11011", "10111", "11101", "1", "11", "111")
LEAST, SIMILAR, SIEVE = 20, (4, 5), 26
_TOKEN = re.compile(r"[^\W_]+")
_ASCII = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))
#: Tokens whose masks are hashed at once.
CHUNK = 1 << 16


def tokens(text: str | None, memo: WordHashes) -> np.ndarray:
    if text and text.isascii():
        return memo.of(text.lower().encode().translate(_ASCII).split())
    return memo.of([w.encode() for w in _TOKEN.findall(text.lower())] if text else [])


def seeds(t: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of all places of mask number ``salt``."""
    mask = MASKS[salt]
    n = len(t) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, salt + 1, np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            h = h * np.uint64(0x9E3779B97F4A7C15) + t[i : i + n]
    return mix(h)


def masks_of(n: int) -> list[int]:
    """Numbers of the masks that seed an item of n tokens."""
    return [MASKS.index("1" * n)] if n < 5 else [0, 1, 2, 3]


def stretch(same: np.ndarray, least: int) -> bool:
    """Whether some run of at least ``least`` positions agrees in SIMILAR of them."""
    if len(same) < least or not least:
        return False
    p, q = SIMILAR
    s = np.append(0, np.cumsum(same.astype(np.int64) * q - p))
    low = np.minimum.accumulate(s[: len(s) - least])
    return bool((s[least:] - low >= 0).any())


def agrees(t: np.ndarray, q: np.ndarray, shift: int) -> bool:
    """Whether a stretch of item ``q`` laid at ``shift`` agrees with document ``t``."""
    a, b = max(0, shift), min(len(t), shift + len(q))
    return stretch(t[a:b] == q[a - shift : b - shift], min(LEAST, len(q))) if b > a else False


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _slot(h, 0), _slot(h, 1)


def _slot(h: np.ndarray, probe: int) -> np.ndarray:
    return ((mix(h) if probe else h) >> np.uint64(64 - SIEVE)).astype(np.int64)


def found_in(texts: list[np.ndarray], masks: list[int], bits: np.ndarray) -> list[list[dict]]:
    """h, p of the seeds of each text that the sieve ``bits`` passes; texts are laid in a row and hashed at once."""
    out: list[list[dict]] = [[] for _ in texts]
    many = np.array([len(t) for t in texts], np.int64)
    ends, row = np.cumsum(many), np.concatenate([np.zeros(0, np.uint64), *texts])
    for m in masks:
        h = seeds(row, m)
        place = np.arange(len(h))
        for k in (0, 1):
            s = _slot(h[place], k)
            place = place[(bits[s >> 3] >> (s & 7) & 1).astype(bool)]
        of = np.searchsorted(ends, place, "right")
        whole = place + len(MASKS[m]) <= ends[of]  # no seed crosses from one text to the next
        of, place = of[whole], place[whole]
        for d, a, p in zip(of.tolist(), h[place].view(np.int64).tolist(), (place - ends[of] + many[of]).tolist()):
            out[d].append({"h": a, "p": p})
    return out


def seed_table(benchmark: DataFrame, scratch: Scratch, item_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(items: item, id, tokens; seeds: h, item, at) of all items with a token."""

    @F.pandas_udf("array<long>")
    def of(t: pd.Series) -> pd.Series:
        memo = WordHashes()
        return pd.Series([tokens(x, memo).view(np.int64) for x in t], dtype=object)

    def spread(batches):
        for b in batches:
            for item, ts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = np.array(ts, np.int64).view(np.uint64)
                got = [(seeds(t, m), m) for m in masks_of(len(t))]
                h = np.concatenate([s for s, _ in got])
                at = np.concatenate([np.arange(len(s)) for s, _ in got])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), item, np.int64)), pa.array(at)], ["h", "item", "at"])

    items = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).cast("long").alias("id"), of(F.col(text).cast("string")).alias("tokens"))
    items = scratch.keep(items.where(F.size("tokens") > 0))
    return items, scratch.keep(items.select("item", "tokens").mapInArrow(spread, "h long, item long, at long"))


def _sieve(spark: SparkSession, seed: DataFrame):
    """Bits of all seeds, or-ed by word in Spark; what comes to the driver has a fixed size."""

    def slots(batches):
        for b in batches:
            s = np.unique(np.concatenate(_slots(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))
            yield pa.RecordBatch.from_arrays([pa.array(s >> 3), pa.array(1 << (s & 7))], ["word", "bit"])

    got = seed.select("h").mapInArrow(slots, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (SIEVE - 3), np.uint8)
    bits[got.column("word").to_numpy()] = got.column("bits").to_numpy().astype(np.uint8)
    return spark.sparkContext.broadcast(bits.tobytes())


def _found(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text: Column, scratch: Scratch, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """blob, items (sorted ids) of the texts with a verified overlap."""
    items, seed = seed_table(benchmark, scratch, item_id, item_text)
    shared = _sieve(spark, seed)
    used = sorted({r["m"] for r in items.select(F.explode(F.when(F.size("tokens") < 5, F.array(F.size("tokens") - 5)).otherwise(F.array(F.lit(0)))).alias("m")).distinct().collect()})
    masks = [m for u in used for m in ([0, 1, 2, 3] if u == 0 else masks_of(u + 5))]

    @F.pandas_udf("array<struct<h:long,p:int>>")
    def hits(t: pd.Series) -> pd.Series:
        bits, memo, out, held, size = np.frombuffer(shared.value, np.uint8), WordHashes(), [], [], 0
        for x in t:
            held.append(tokens(x, memo))
            size += len(held[-1])
            if size >= CHUNK:
                out += found_in(held, masks, bits)
                held, size = [], 0
        out += found_in(held, masks, bits)
        return pd.Series(out, dtype=object)

    @F.pandas_udf("boolean")
    def verified(t: pd.Series, q: pd.Series, shifts: pd.Series) -> pd.Series:
        memo, last, ts, out = WordHashes(), None, None, []
        for x, item, at in zip(t, q, shifts):
            if last is None or x is not last:
                last, ts = x, tokens(x, memo)
            out.append(any(agrees(ts, np.array(item, np.int64).view(np.uint64), int(s)) for s in at))
        return pd.Series(out, dtype=bool)

    seen = docs.select(text.alias("text")).withColumn("hits", hits("text")).where(F.size("hits") > 0)
    kept = scratch.keep(seen.select(blob_id(F.col("text")).alias("blob"), "text", "hits"))
    met = kept.select("blob", F.explode("hits").alias("x")).select("blob", "x.h", "x.p").join(seed, "h").select("blob", "item", (F.col("p") - F.col("at")).alias("shift")).distinct()
    pairs = scratch.keep(met.groupBy("blob", "item").agg(F.collect_list("shift").alias("shifts")))
    # A text that repeats is verified once: the first row of its blob.
    once = kept.join(pairs.select("blob").distinct(), "blob", "left_semi").groupBy("blob").agg(F.first("text").alias("text"))
    both = once.join(pairs.join(items, "item"), "blob")
    sure = both.where(verified("text", "tokens", "shifts")).groupBy("blob").agg(F.array_sort(F.collect_set("id")).alias("items"), F.count_if(F.col("id").isNull()).alias("unnamed"))
    out = scratch.keep(sure.select("blob", F.when(F.col("unnamed") > 0, F.concat("items", F.array(F.lit(None).cast("long")))).otherwise(F.col("items")).alias("items")))
    scratch.drop(kept, pairs, items, seed)
    return out


def matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, items (sorted ids of the items found) of every row."""
    t = F.col(text).cast("string")
    found = _found(spark, docs, benchmark, t, Scratch(spark), item_id, item_text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), blob_id(t).alias("blob"))
    return rows.join(found, "blob", "left").select("doc_id", F.coalesce("items", F.array().cast("array<long>")).alias("items"))


@any_columns
def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark, all columns."""
    t = F.col("text").cast("string")
    found = _found(spark, docs, benchmark, t, Scratch(spark)).select(F.col("blob").alias("__gone"))
    return docs.withColumn("__blob", blob_id(t)).join(found, F.col("__blob") == F.col("__gone"), "left_anti").select(*docs.columns)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return m.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("item_ids"))
