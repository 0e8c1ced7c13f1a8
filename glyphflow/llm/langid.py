"""Language identification by bit-sliced Bloom filters of character n-grams.

Learned from labelled rows only: of every language the SAMPLE rows with the smallest hash of their id (ids are chosen
first, texts join them) give n-gram counts. An n-gram goes into the filter of every language in which it is at least SHARE
as frequent as in the language where it is most frequent; no n-gram is left out for being rare. The filters are
bit-sliced: slot s holds words of 64 bits, one bit for each language, so the AND of HASHES slots returns all languages that
contain an n-gram. A text is read as a whole; hits are counted per language bit, corrected for the filter's false positive
rate f: (hits - n f) / (1 - f); the largest corrected count wins, ties go to the language first in order. ``score`` is its
share of the corrected counts.

Bounds: SAMPLE rows of a language, 2**BITS slots of as many words as the languages ask for; they do not grow with the corpus.

Defined cases: null text or one without a letter gives ``und`` and 0; a text none of whose n-grams is known gives the most
frequent learned language and 0; no labelled rows: all ``und``; repeated rows each get theirs; very long texts are read
whole; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch, mix, table

SAMPLE, BITS, HASHES, SHARE, SIZES, MEMO, GRAMS = 5_000, 22, 3, 0.05, (2, 3, 4), 200_000, 400_000
_RUN = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased. ``\\w`` also holds numerals that are no digits; they part words."""
    found = _RUN.findall(text.lower())
    return found if all(map(str.isalpha, found)) else [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]


def grams(text: str) -> Counter:
    """n-grams of the words of a whole text, words padded with a space on both sides."""
    out: Counter = Counter()
    for word, n in Counter(words_of(text)).items():
        w = f" {word} "
        for k in SIZES:
            for i in range(len(w) - k + 1):
                out[w[i : i + k]] += n
    return out


def _slots(keys: list[str]) -> np.ndarray:
    h = mix(np.fromiter((zlib.crc32(k.encode()) | zlib.adler32(k.encode()) << 32 for k in keys), np.uint64, len(keys)))
    return np.stack([(mix(h + np.uint64(i)) >> np.uint64(64 - BITS)).astype(np.int64) for i in range(HASHES)])


class Filters:
    """``rows``: training rows by language; ``slots``: 2**BITS x words, bit l % 64 of word l // 64 belongs to language l."""

    def __init__(self, rows: dict[str, int], slots: np.ndarray):
        self.langs, self.slots = sorted(rows), slots
        self.known, self.bits = {}, np.zeros((0, len(self.langs)), np.uint8)
        self.common = max(self.langs, key=lambda x: rows[x]) if self.langs else "und"
        fill = np.array([np.count_nonzero(slots[:, b // 64] >> np.uint64(b % 64) & np.uint64(1)) for b in range(len(self.langs))]) / (1 << BITS)
        self.false = np.minimum(fill**HASHES, 0.999)

    @classmethod
    def of(cls, counts: dict[str, Counter], rows: dict[str, int]) -> "Filters":
        """Filters of counts held here, for small tests."""
        langs = sorted(counts)
        total = {x: max(1, sum(counts[x].values())) for x in langs}
        best: dict[str, float] = {}
        for x in langs:
            for g, n in counts[x].items():
                best[g] = max(best.get(g, 0.0), n / total[x])
        slots = np.zeros((1 << BITS, -(-max(1, len(langs)) // 64)), np.uint64)
        for bit, x in enumerate(langs):
            keys = [g for g, n in counts[x].items() if n / total[x] >= SHARE * best[g]]
            if keys:
                np.bitwise_or.at(slots[:, bit // 64], _slots(keys).ravel(), np.uint64(1 << bit % 64))
        return cls(rows, slots)

    def _of_grams(self, grams: list[str]) -> np.ndarray:
        """For every n-gram, which languages' filters have it. Far fewer n-grams than words are new, so they are remembered,
        GRAMS at most and more only for the words of one call."""
        new = [g for g in set(grams) if g not in self.known]
        if len(self.known) + len(new) > GRAMS:
            self.known.clear()
            new = list(set(grams))
        if new:
            got = np.bitwise_and.reduce(self.slots[_slots(new)], axis=0)
            bit, at = np.arange(len(self.langs)), len(self.known)
            if at + len(new) > len(self.bits):
                more = np.zeros((max(2 * len(self.bits), at + len(new)), len(bit)), np.uint8)
                more[: len(self.bits)] = self.bits
                self.bits = more
            self.bits[at : at + len(new)] = got[:, bit // 64] >> (bit % 64).astype(np.uint64) & np.uint64(1)
            self.known.update(zip(new, range(at, at + len(new))))
        return self.bits[np.fromiter(map(self.known.__getitem__, grams), np.int64, len(grams))]

    def _hits(self, words: list[str]) -> np.ndarray:
        """For every word, how many of its n-grams each language's filter has; last, how many n-grams it has."""
        keys, size = [], []
        for x in words:
            w = f" {x} "
            n = len(w)
            for k in SIZES:
                keys += [w[i : i + k] for i in range(n - k + 1)]
            size.append(sum(max(0, n - k + 1) for k in SIZES))
        return np.column_stack([np.add.reduceat(self._of_grams(keys), np.append(0, np.cumsum(size)[:-1]), axis=0, dtype=np.int64), size]).astype(np.float64)

    def predict(self, text: str | None, memo: dict[str, bytes] | None = None) -> tuple[str, float]:
        """``memo``: hits of words met before, kept by the caller and emptied at MEMO words."""
        words = Counter(words_of(text)) if text else Counter()
        if not words or not self.langs:
            return "und", 0.0
        memo = {} if memo is None else memo
        if len(memo) >= MEMO:
            memo.clear()
        new = [w for w in words if w not in memo]
        if new:
            flat, wide = self._hits(new).tobytes(), 8 * (len(self.langs) + 1)
            memo.update(zip(new, [flat[i : i + wide] for i in range(0, len(flat), wide)]))
        hits = np.frombuffer(b"".join([memo[w] for w in words])).reshape(len(words), -1)
        total = np.fromiter(words.values(), np.float64, len(words)) @ hits
        right = np.maximum((total[:-1] - total[-1] * self.false) / (1 - self.false), 0)
        if right.max() <= 0:
            return self.common, 0.0
        return self.langs[int(right.argmax())], float(min(1.0, right.max() / right.sum()))


def _chosen(known: DataFrame, key: str, sample: int) -> DataFrame:
    """__lang, __key of the ``sample`` rows of every language with the least hashes of their keys (ties: by key). No language is one
    task: rows are counted by the leading bits of the hash, and only those of the buckets that are wanted are ranked, each
    bucket apart."""
    ids = known.select(F.col("lang").alias("__lang"), F.col(key).alias("__key")).withColumn("__hash", F.xxhash64("__key")).withColumn("__bucket", F.shiftright("__hash", 52))
    sizes = ids.groupBy("__lang", "__bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("__lang").orderBy("__bucket")) - F.col("n")
    wanted = sizes.select("__lang", "__bucket", before.alias("__before")).where(F.col("__before") < sample)
    turn = F.row_number().over(Window.partitionBy("__lang", "__bucket").orderBy("__hash", "__key"))
    ranked = ids.join(wanted, ["__lang", "__bucket"]).withColumn("__turn", turn).where(F.col("__turn") <= sample)  # cut before the shuffle too
    ranked = ranked.where(F.col("__turn") <= F.lit(sample) - F.col("__before"))
    return ranked.select("__lang", "__key").distinct()


def train(labelled: DataFrame, key: str = "doc_id", sample: int = SAMPLE) -> Filters:
    """``labelled``: key, text, lang. Counting, choice of n-grams and setting of bits are distributed; slots come back."""
    scratch = Scratch(labelled.sparkSession)
    known = labelled.where("lang is not null and text is not null")
    chosen = scratch.keep(_chosen(known, key, sample))
    rows = {r["__lang"]: r["n"] for r in chosen.groupBy("__lang").agg(F.count("*").alias("n")).collect()}
    if not rows:
        return Filters({}, np.zeros((1 << BITS, 1), np.uint64))
    texts = known.join(F.broadcast(chosen), (F.col(key) == F.col("__key")) & (F.col("lang") == F.col("__lang"))).select("lang", "text")

    def count(frames):
        seen: dict[str, Counter] = {}
        for f in frames:
            for lang, text in zip(f["lang"], f["text"]):
                seen.setdefault(lang, Counter()).update(grams(text))
        for x, c in seen.items():
            yield pd.DataFrame([(x, g, n) for g, n in c.items()], columns=["lang", "gram", "n"])

    counts = scratch.keep(texts.mapInPandas(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    total = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    place = {x: k for k, x in enumerate(sorted(rows))}

    def bits(frames):
        for f in frames:
            share = [[n / total[x] for x, n in zip(ls, ns)] for ls, ns in zip(f["langs"], f["ns"])]
            out = []
            for g, ls, sh in zip(_slots(list(f["gram"])).T.tolist(), f["langs"], share):
                word: dict[int, int] = {}
                top = max(sh)
                for x, v in zip(ls, sh):
                    if v >= SHARE * top:
                        k = place[x]
                        word[k // 64] = word.get(k // 64, 0) | 1 << k % 64
                out += [(s, w, b - (1 << 64) if b >> 63 else b) for s in g for w, b in word.items()]
            yield pd.DataFrame(out, columns=["slot", "word", "bits"])

    by_gram = counts.groupBy("gram").agg(F.collect_list("lang").alias("langs"), F.collect_list("n").alias("ns"))
    got = by_gram.mapInPandas(bits, "slot int, word int, bits long").groupBy("slot", "word").agg(F.bit_or("bits").alias("bits")).toArrow()
    slots = np.zeros((1 << BITS, -(-len(place) // 64)), np.uint64)
    slots[got.column("slot").to_numpy(), got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    scratch.drop(counts, chosen)
    return Filters(rows, slots)


def predict(spark: SparkSession, docs: DataFrame, model: Filters, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with lang_pred and score. The model is a broadcast of fixed size (8 * 2**BITS bytes)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def of(t: pd.Series) -> pd.DataFrame:
        memo: dict[str, np.ndarray] = {}
        return pd.DataFrame([shared.value.predict(x, memo) for x in t], columns=["lang_pred", "score"])

    return docs.select(*keep, of(F.col(text)).alias("p")).select(*keep, "p.lang_pred", "p.score")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    model = train(docs.where("not held_out").select("doc_id", "text", "lang"))
    return predict(spark, docs.select("doc_id", "held_out", "text"), model, ["doc_id", "held_out"])
