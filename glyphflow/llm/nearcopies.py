"""Near copies: SimHash links first, verified on shingles, then an exact set-similarity join for what fingerprints cannot see.

Copies are texts whose sets of shingles of WORDS words have a Jaccard similarity of SIMILAR or more. Every text becomes its
set of shingle hashes (64 bits; two shingles are taken as equal on these). Texts whose fingerprints over the same shingles
link in ``simhash`` (generalised pigeonhole) are compared first and join most groups at once. No number of bits of a 64-bit
fingerprint holds all pairs of a given Jaccard, so pairs of texts that are still apart are sought without it: in one order
of all shingles, two sets of SIMILAR or more share one of their first n - ceil(SIMILAR n) + 1 (the prefix), so every such
pair meets at a prefix shingle; pairs whose sizes or places there rule it out are left, the others verified on whole sets.
Any order is right; shingles found to be frequent within batches (``hot``) come last, which keeps the groups small.

Large groups: members of one prefix shingle first meet three of them (stars): the one with the fewest shingles before it, to
which the others are nearest, one picked among all by hash, one among the components. Groups in which a member still has over
LARGE others of different components on average get stars anew, until those link nothing more. After that, and after the
SimHash links, all pairs of different components are compared, members outside the largest component of a group with the
whole group. Verified pairs become components by contraction.

Disk: a pair is first judged by sketches (``sketch``: the parity of the number of shingles in each of 1,024 cells; no
shingle in one set only changes more than one cell, so two sets differ in at least as many shingles as cells). Whole sets
are made of texts in pairs that this leaves, in shares of at most SHARE pairs, and deleted after each; no other table
outlives the step that reads it last.

Defined cases: words are as in simhash (only A-Z change case, ASCII white space splits); a text under WORDS words is one
shingle; null and blank texts are copies of each other; very long texts are read whole; null doc_id sorts after every other;
of rows that repeat doc_id and text one stays; an empty table gives an empty table; further columns pass through ``dedup``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Rolling, Scratch, WordHashes, any_columns, drop_rows, mix, row_digest
from .components import components
from .simhash import fingerprint
from .simhash import links as fingerprint_links

#: Similarity as a fraction, so that every test is one of integers.
WORDS, SIMILAR = 5, (4, 5)
LARGE, HOT_BATCH, HOT = 16, 4_096, 65_536
CELLS, SHARE = 1_024, 200_000


def shingles(text: str | None, memo: WordHashes, words: int = WORDS) -> np.ndarray:
    """The sorted set of shingle hashes of one text."""
    h = memo.of(text.encode().lower().split()) if text else np.zeros(0, np.uint64)
    return np.unique(mix(Rolling(h).windows(min(words, len(h))))) if len(h) else h


def set_key(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s.tobytes(), 5) - (1 << 63)


def sketch(s: np.ndarray) -> np.ndarray:
    """CELLS bits as longs: the parity of the number of shingles in each cell."""
    odd = np.bincount((s >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64), minlength=CELLS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def hot(docs: DataFrame, text: str) -> np.ndarray:
    """Shingles that repeat within Arrow batches, rarest first. Bounded: HOT_BATCH rows a batch, HOT in all."""

    def part(frames):
        memo = WordHashes()
        for f in frames:
            sets = [shingles(t, memo) for t in f["t"]]
            h, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, int))
            most = np.argsort(-n, kind="stable")[:HOT_BATCH]
            most = most[n[most] > 1]
            yield pd.DataFrame({"h": h[most].view(np.int64), "n": n[most].astype(np.int64)})

    got = docs.select(F.col(text).cast("string").alias("t")).mapInPandas(part, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(HOT).collect()
    return np.array([r["h"] for r in reversed(got)], np.int64).view(np.uint64)


def prefixes(spark: SparkSession, docs: DataFrame, text: str) -> Column:
    """key of the set, its size n, its prefix, the fingerprint and the sketch, of every text."""
    order = hot(docs, text)
    by_hash = np.argsort(order)
    shared = spark.sparkContext.broadcast((order[by_hash], by_hash + 1))

    @F.pandas_udf("key long, n int, prefix array<long>, fp long, sketch array<long>")
    def of(t: pd.Series) -> pd.DataFrame:
        memo, (known, rank) = WordHashes(), shared.value
        out = []
        for x in t:
            s = shingles(x, memo)
            n, last = len(s), np.zeros(len(s), np.int64)
            if len(known) and n:
                at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                last = np.where(known[at] == s, rank[at], 0)
            most = n + -SIMILAR[0] * n // SIMILAR[1] + 1 if n else 0
            out.append((set_key(s), n, s[np.lexsort((s, last))[:most]].view(np.int64), fingerprint(x, WORDS), sketch(s)))
        return pd.DataFrame(out, columns=["key", "n", "prefix", "fp", "sketch"])

    return of(F.col(text).cast("string"))


def _alike(o: Column | int, na: str = "na", nb: str = "nb") -> Column:
    """Whether o common shingles make sets of sizes na and nb similar."""
    p, q = SIMILAR
    return o * (p + q) >= (F.col(na) + F.col(nb)) * p


def _may() -> Column:
    """Whether a pair may be similar whose first common shingle is at pa and pb."""
    return _alike(F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")))


def _may_by_sketch() -> Column:
    """Whether a pair may be similar by its sketches: the sets differ in as many shingles as cells at least."""
    apart = sum((F.bit_count(F.get("wa", F.lit(k)).bitwiseXOR(F.get("wb", F.lit(k)))) for k in range(CELLS // 64)), F.lit(0))
    p, q = SIMILAR
    # With na + nb = 2 o + d, o (p + q) >= (na + nb) p is the same as d (p + q) <= (na + nb) (q - p).
    return apart * (p + q) <= (F.col("na") + F.col("nb")) * (q - p)


def seeds(spark: SparkSession, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b (set keys) of texts with one fingerprint or with fingerprints that link; candidates only. ``rows``: key, fp."""
    head = scratch.keep(rows.groupBy("fp").agg(F.min("key").alias("head")))
    same = rows.select("key", "fp").distinct().join(head, "fp").where("key <> head").select(F.col("key").alias("a"), F.col("head").alias("b"))
    far = scratch.keep(fingerprint_links(spark, head.select("fp"), scratch).distinct())
    of = lambda x: head.select(F.col("fp").alias("f" + x), F.col("head").alias(x))
    near = far.select(F.col("a").alias("fa"), F.col("b").alias("fb")).join(of("a"), "fa").join(of("b"), "fb").select("a", "b")
    return same.unionByName(near)


def links(rows: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b (set keys) of links that join everything joined by similar pairs. ``rows``: sha, key, n, prefix, fp, sketch (its
    table is dropped); ``texts``: sha, text."""

    @F.pandas_udf("array<long>")
    def whole(t: pd.Series) -> pd.Series:
        memo = WordHashes()
        return pd.Series([shingles(x, memo).view(np.int64) for x in t], dtype=object)

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        p, q = SIMILAR
        return pd.Series([len(np.intersect1d(x, y, assume_unique=True)) * (p + q) >= (len(x) + len(y)) * p for x, y in zip(a, b)], dtype=bool)

    # Rows that repeat a text give it once: one set for each key.
    one = scratch.keep(rows.groupBy("key").agg(F.min(F.struct("sha", "n", "sketch")).alias("x")).select("key", "x.*"))
    seed = scratch.keep(seeds(scratch.spark, rows.select("key", "fp"), scratch))
    at = rows.select("key", "n", F.posexplode("prefix").alias("p", "h"))
    # Counted before the shuffle and joined back: members of a frequent shingle never meet in one task.
    shared = scratch.keep(at.groupBy("h").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.min("n").alias("least")).where("low <> high").select("h", "least"))
    # A place too late for the smallest set of the group is too late for all.
    met = scratch.keep(at.join(shared, "h").where(_alike(F.col("n") - F.col("p"), "n", "least")).select("h", "key", "n", "p").distinct())
    scratch.drop(shared, rows)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = scratch.keep(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        side = lambda x: one.select(F.col("key").alias(x), F.col("n").alias("n" + x), F.col("sketch").alias("w" + x))
        left = scratch.keep(pairs.join(side("a"), "a").join(side("b"), "b").where(_may_by_sketch()).select("a", "b"))
        scratch.drop(pairs)
        shares, out = -(-left.count() // SHARE), [left.where("false")]
        for k in range(shares):
            part = left.where(F.pmod(F.xxhash64("a", "b"), F.lit(shares)) == k)
            asked = part.select(F.explode(F.array("a", "b")).alias("key")).distinct()
            sets = scratch.keep(texts.join(one.select("key", "sha").join(asked, "key"), "sha").dropDuplicates(["key"]).select("key", whole("text").alias("s")))
            both = part.join(sets.select(F.col("key").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("key").alias("b"), F.col("s").alias("sb")), "b")
            out.append(scratch.keep(both.where(similar("sa", "sb")).select("a", "b")))
            scratch.drop(sets)
        return reduce(DataFrame.unionAll, out)

    def named(edges: DataFrame) -> DataFrame:
        """``met`` with the label of each key's component so far."""
        label = components(edges, scratch).withColumnRenamed("v", "key")
        return scratch.keep(met.join(label, "key", "left").withColumn("label", F.coalesce("label", "key")))

    def groups(known: DataFrame) -> DataFrame:
        """h, main (the label of most members), left (pairs of different labels), of (members) of the groups with two labels or more."""
        each = known.groupBy("h", "label").agg(F.count("*").alias("of"))
        of = each.groupBy("h").agg(F.max(F.struct("of", "label")).alias("top"), F.sum("of").alias("of"), F.sum(F.col("of") * F.col("of")).alias("same"))
        return of.where("top.of < of").select("h", F.col("top.label").alias("main"), ((F.col("of") * F.col("of") - F.col("same")) / 2).alias("left"), "of")

    def stars(known: DataFrame, turn: int) -> DataFrame:
        one, member = F.struct("key", "n", "p", "label"), F.xxhash64("key", F.lit(turn))
        picks = [F.struct("p", member), F.struct(member), F.struct(F.xxhash64("label", F.lit(turn)), member)]
        heads = known.groupBy("h").agg(*[F.min(F.struct(by, one.alias("m")))["m"].alias(f"m{k}") for k, by in enumerate(picks)])
        heads = heads.select("h", F.explode(F.array_distinct(F.array("m0", "m1", "m2"))).alias("m")).select("h", "m.*")
        return pairs_of(known, heads)

    sides = lambda d, x: d.select("h", F.col("key").alias(x), F.col("n").alias("n" + x), F.col("p").alias("p" + x), F.col("label").alias("l" + x))
    pairs_of = lambda x, y: sides(x, "a").join(sides(y, "b"), "h").where((F.col("la") != F.col("lb")) & _may())
    out = verified(seed.where("a <> b"))
    scratch.drop(seed)
    known, turn = named(out), 0
    large = known
    while True:
        new = verified(stars(large, turn))
        if new.isEmpty():
            break
        out = out.unionByName(new)
        scratch.drop(known)
        known, turn = named(out), turn + 1
        large = known.join(groups(known).where(F.col("left") > F.col("of") * LARGE).select("h"), "h")
        if large.isEmpty():
            break
    scratch.drop(met)
    several = known.join(groups(known).select("h", "main"), "h")
    out = out.unionByName(verified(pairs_of(several.where("label <> main"), several)))
    scratch.drop(known, one)
    return out


def _clusters(scratch: Scratch, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = scratch.keep(docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_digest(F.col(text)).alias("sha"), prefixes(scratch.spark, docs, text).alias("x")).select("doc_id", "sha", "x.*"))
    names = scratch.keep(rows.select("doc_id", "sha", "key"))
    edges = links(rows, docs.select(row_digest(F.col(text)).alias("sha"), F.col(text).cast("string").alias("text")), scratch)
    label = components(edges, scratch)
    return names.join(label.withColumnRenamed("v", "key"), "key", "left").select("doc_id", "sha", F.coalesce("label", "key").alias("label"))


def clusters(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, sha (digest of the text), label (of the component) of every row."""
    return _clusters(Scratch(spark), docs, doc_id, text)


@any_columns
def dedup(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The first row of every component, all columns."""
    scratch = Scratch(spark)
    out = drop_rows(docs, _clusters(scratch, docs, doc_id, text), Scratch(spark), doc_id, text)
    scratch.clear()  # what goes is named in tables of its own
    return out
