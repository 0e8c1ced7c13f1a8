"""Quality classifier: document evidence combined with hierarchical empirical Bayes posteriors of host and path.

Document evidence: two logistic models (low quality, toxic) over shape features and the presence of telling words, fitted on
a bounded sample of labelled rows (SAMPLE ids with the smallest hash). A telling word is one whose log likelihood ratio
of presence by class has a root of Z or more; the words of the sample are counted by class in Spark, and only the WORDS most telling ones
reach the driver, with one sparse row for each sampled document.

Sites: the source is host/path. The mean evidence of a host is shrunk toward the corpus mean, that of a path toward its
host, each with the weight k of as many documents as the spread between sites asks for (method of moments); counts and
means cover all documents. A source without a path has its host's posterior alone. A document's own evidence is taken out
of its site's before its odds move by LAMBDA times what the site's log odds differ from the corpus's.

Defined cases: null or empty text has shape zero and no words; null source is the site ''; no labels (or one class
only): all kept with score 1; null labels and labels of null ids are not read; of several labels of an id low quality
and toxic win; of rows that repeat a labelled id one is learned from; repeated rows count each; very long texts are read
whole; an empty table gives an empty table; further columns pass through.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, any_columns, row_digest, table

SAMPLE, WORDS, Z, LAMBDA = 20_000, 256, 3.5, 0.5
#: Texts that a worker holds as Python objects at a time.
SLICE = 256
_WORD = re.compile(r"[^\W\d_]+")
_KINDS = ("letter", "upper", "digit", "symbol", "bar")
_TABLE = 0x3000  # characters beyond are counted one by one


def _kind(c: str) -> int:
    return c.isalpha() | c.isupper() << 1 | c.isdigit() << 2 | (c in "!#$%&*<>=+~^@") << 3 | (c in "|{}[]\\") << 4


_KIND = np.array([_kind(chr(i)) for i in range(_TABLE)], np.uint8)


def kinds(text: str) -> list[int]:
    """How many letters, capitals, digits, symbols and bars a text has."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    near = codes < _TABLE
    seen = np.bincount(_KIND[codes[near]], minlength=32)
    for c in codes[~near].tolist():
        seen[_kind(chr(c))] += 1
    return [int(seen[[k for k in range(32) if k >> b & 1]].sum()) for b in range(len(_KINDS))]


def shape(text: str, words: list[str]) -> list[float]:
    """Shares of capitals, symbols, digits, bars and repeats; length."""
    n, k = max(1, len(text)), max(1, len(words))
    letters, upper, digits, symbols, bars = kinds(text)
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        upper / max(1, letters) * 4,
        symbols / k * 2,
        digits / n * 10,
        bars / k * 4,
        (1 - len(set(lines)) / len(lines)) * 4 if lines else 0.0,
        (1 - len(set(words)) / k) * math.sqrt(1 / (1 + math.log1p(k))),
        n / k / 5,
        math.log1p(k) / 4,
    ]


def features(text: str | None) -> tuple[list[float], set[str]]:
    text = text or ""
    return shape(text, text.split()), set(_WORD.findall(text.lower()))


class Logit:
    """Logistic regression by Newton's steps. ``found``: for every row, the places of its words in ``words``."""

    def __init__(self, shapes: np.ndarray, found: Sequence[Sequence[int]], words: list[str], y: np.ndarray):
        self.w = None
        if not len(y) or not 0 < y.mean() < 1:
            return
        k = 1 + shapes.shape[1]
        x = np.zeros((len(y), k + len(words)))
        x[:, 0], x[:, 1:k] = 1, shapes
        for row, at in zip(x, found):
            row[k + np.asarray(at, int)] = 1
        w, pull = np.zeros(x.shape[1]), np.full(x.shape[1], 0.1)
        pull[0] = 1e-6
        for _ in range(15):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pull)
            step = np.linalg.solve(h, x.T @ (p - y) + pull * w)
            w -= step
            if abs(step).max() < 1e-6:
                break
        self.w, self.weight = w[:k], dict(zip(words, w[k:].tolist()))

    def __call__(self, shape: list[float], words: set[str]) -> float:
        if self.w is None:
            return 0.0
        z = float(self.w[0] + self.w[1:] @ shape) + math.fsum(self.weight[w] for w in words & self.weight.keys())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _telling(words: DataFrame, mark: str, marked: int, other: int) -> list[str]:
    """The WORDS most telling words for the class ``mark``. ``words``: w, n, and how often in rows of each class."""
    n, all_ = F.col("n"), float(marked + other)
    cells = [(F.col(mark), n * (marked / all_)), (marked - F.col(mark), (all_ - n) * (marked / all_)), (n - F.col(mark), n * (other / all_)), (other - n + F.col(mark), (all_ - n) * (other / all_))] if all_ else []
    ratio = sum((F.when(o > 0, o * F.log(o / e)).otherwise(0.0) for o, e in cells), F.lit(0.0))
    z = F.sqrt(F.greatest(F.lit(0.0), 2 * ratio))
    return [r["w"] for r in words.select("w", z.alias("z")).where(F.col("z") >= Z).orderBy(F.desc("z"), "w").limit(WORDS).collect()]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Logit, Logit]:
    """(low quality, toxic), fitted on the driver from one sparse row for each of at most ``sample`` documents."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    id_ = F.col("doc_id").cast("long").alias("__id")
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(id_).agg((F.min("quality") == 0).cast("long").alias("low"), (F.max("toxic") == 1).cast("long").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(sample)

    def read(frames):
        for f in frames:
            for at in range(0, len(f), SLICE):
                part = f.iloc[at : at + SLICE]
                x = [features(t) for t in part["text"]]
                yield pd.DataFrame({"id": part["__id"], "low": part["low"], "toxic": part["toxic"], "shape": [a for a, _ in x], "words": [sorted(b) for _, b in x]})

    got = docs.select(id_, F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "__id").select("__id", "low", "toxic", "text").mapInPandas(read, "id long, low long, toxic long, shape array<double>, words array<string>")
    rows = scratch.keep(got.dropDuplicates(["id"]))
    n, low, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("low"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    words = scratch.keep(rows.select("low", "toxic", F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"), F.sum("low").alias("low"), F.sum("toxic").alias("toxic")))
    lists = [_telling(words, mark, m, n - m) for mark, m in (("low", low), ("toxic", toxic))]
    every = sorted({w for x in lists for w in x})
    place = {w: i for i, w in enumerate(every)}

    def sparse(frames):
        for f in frames:
            yield f.assign(at=[[place[w] for w in ws if w in place] for ws in f["words"]])[["id", "low", "toxic", "shape", "at"]]

    data = rows.mapInPandas(sparse, "id long, low long, toxic long, shape array<double>, at array<int>").toPandas().sort_values("id", ignore_index=True)
    scratch.drop(rows, words)
    shapes = np.array(data["shape"].tolist() or np.zeros((0, 8)), float)
    out = []
    for mark, own in zip(("low", "toxic"), lists):
        to = np.full(len(every), -1)
        to[[place[w] for w in own]] = np.arange(len(own))
        out.append(Logit(shapes, [k[k >= 0] for k in (to[np.asarray(a, int)] for a in data["at"])], own, data[mark].to_numpy(float)))
    return out[0], out[1]


def judged(texts: pa.Array, models: tuple[Logit, Logit]) -> pa.Array:
    """p_low and p_toxic of a column of texts; of one text at a time the words are held, and of SLICE the text."""
    (low, toxic), out = models, np.empty((2, len(texts)))
    for at in range(0, len(texts), SLICE):
        for k, t in enumerate(texts.slice(at, SLICE).to_pylist(), at):
            of, words = features(t)
            out[:, k] = low(of, words), toxic(of, words)
    return pa.StructArray.from_arrays([pa.array(x) for x in out], names=["p_low", "p_toxic"])


def evidence(spark: SparkSession, docs: DataFrame, models: tuple[Logit, Logit], keep: list[str]) -> DataFrame:
    """``keep`` with p_low and p_toxic of every whole text."""
    shared = spark.sparkContext.broadcast(models)

    @F.arrow_udf("p_low double, p_toxic double")
    def of(t: pa.Array) -> pa.Array:
        return judged(t, shared.value)

    return docs.select(*keep, of(F.col("text")).alias("__e")).select(*keep, "__e.*")


def _logit(p):
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _weight(sites: DataFrame) -> float:
    """The number of documents a prior counts for, by the method of moments over (n, s, q) of sites; one row comes back."""
    r = sites.agg(F.count("*").alias("sites"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b")).first()
    if not r["n"] or r["sites"] < 2 or r["n"] <= r["sites"]:
        return 10.0
    mean = r["s"] / r["n"]
    within = max(1e-9, (r["q"] - r["b"]) / (r["n"] - r["sites"]))
    between = max(1e-6, (r["b"] - r["n"] * mean * mean - (r["sites"] - 1) * within) / r["n"])
    return float(min(1e4, max(1.0, within / between)))


def posteriors(scored: DataFrame, scratch: Scratch) -> tuple[DataFrame, dict[str, float]]:
    """host, path, sums of evidence (n, s) of the path and (n_host, s_host) of its host; the priors: corpus mean, k_host, k_path."""
    paths = scratch.keep(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p_low").alias("s"), F.sum(F.col("p_low") * F.col("p_low")).alias("q")))
    hosts = scratch.keep(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = (total["s"] or 0.0) / max(1, total["n"] or 0)
    prior = {"mean": mean, "host": _weight(hosts), "path": _weight(paths.where("path <> ''"))}
    sites = scratch.keep(paths.join(hosts.select("host", F.col("n").alias("n_host"), F.col("s").alias("s_host")), "host").select("host", "path", "n", "s", "n_host", "s_host"))
    scratch.drop(paths, hosts)
    return sites, prior


def _without_own(prior: dict[str, float]) -> Column:
    """The posterior of a document's site from all its documents but this one."""
    own = F.col("p_low")
    host = (F.col("s_host") - own + prior["host"] * prior["mean"]) / (F.col("n_host") - 1 + prior["host"])
    path = (F.col("s") - own + prior["path"] * host) / (F.col("n") - 1 + prior["path"])
    return F.greatest(F.lit(0.0), F.when(F.col("path") == "", host).otherwise(path))


def _site(source):
    s = F.coalesce(F.regexp_replace(source, "^[a-z]+://", ""), F.lit(""))
    return F.substring_index(s, "/", 1).alias("host"), F.when(F.instr(s, "/") > 0, F.element_at(F.split(s, "/"), 2)).otherwise("").alias("path")


def scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, further: Sequence[Column] = ()) -> DataFrame:
    """rid, doc_id, host, path, p_low, p_toxic, p_site, score (probability of a good document), keep, of every row; ``further`` columns too."""
    scratch = Scratch(spark)
    models = train(docs, labels)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), *_site(F.col("source").cast("string")), F.col("text").cast("string").alias("text"), *further)
    scored = scratch.keep(evidence(spark, rows, models, [c for c in rows.columns if c != "text"]))
    sites, prior = posteriors(scored, scratch)
    low = 1 / (1 + F.exp(-(_logit(F.col("p_low")) + LAMBDA * (_logit(F.col("p_site")) - _logit(F.lit(prior["mean"]))))))
    out = scored.join(sites, ["host", "path"]).withColumn("p_site", _without_own(prior)).drop("n", "s", "n_host", "s_host")
    return out.withColumn("score", (1 - low) * (1 - F.col("p_toxic"))).withColumn("keep", (low < 0.5) & (F.col("p_toxic") < 0.5))


@any_columns
def accepted(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, all columns.

    A decision depends on text and source alone, so rows are told apart by doc_id, text and source: ids may be null or repeat.
    """
    scratch = Scratch(spark)
    who = lambda: [F.col("doc_id").cast("long").alias("__id"), row_digest(F.col("text").cast("string")).alias("__sha"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__source")]
    out = scores(spark, docs, labels, who()).where("not keep").select(F.col("__id").alias("__gone"), F.col("__sha").alias("__of"), F.col("__source").alias("__from")).distinct()
    same = F.col("__id").eqNullSafe(F.col("__gone")) & (F.col("__sha") == F.col("__of")) & (F.col("__source") == F.col("__from"))
    return docs.select("*", *who()).join(scratch.keep(out), same, "left_anti").select(*docs.columns)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return s.select("doc_id", "host", "p_low", "p_toxic", "p_site", "score", "keep")
