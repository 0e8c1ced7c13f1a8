"""Helpers shared by the corpus operators: table scans, shared work folder, hashing of token sequences."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts: space and tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"

_SCRATCH: dict[str, tempfile.TemporaryDirectory] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary folder only where that is unset and the master is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "local" not in _SCRATCH:
        _SCRATCH["local"] = tempfile.TemporaryDirectory(prefix="glyphflow-")
    return "file://" + _SCRATCH["local"].name


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the folder goes with its owner
        pass


class Scratch:
    """Tables written to the shared folder, each cutting its lineage.

    ``keep`` writes a frame and reads it back, so a lost executor never forces what lies above it to run again. The
    shuffle files of that write go as soon as it has ended (its result no longer needs them), so that the disk in use is
    that of one step. ``drop`` deletes tables that no later frame reads.
    """

    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{work_dir(spark)}/glyphflow/{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        # Frames that are returned read their tables as long as the session lives; with its driver the folder goes.
        p = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        store = p.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(p)
        store.deleteOnExit(p)

    def keep(self, df: DataFrame, by: str | None = None, **conf: str) -> DataFrame:
        """``conf``: settings for this write alone, dots as double underscores. ``by``: a folder for each value of this column."""
        path = f"{self.root}/{len(self.paths)}"
        self.paths[len(self.paths)] = path
        wanted = {self.CLEANUP: "true", **{k.replace("__", "."): v for k, v in conf.items()}}
        before = {k: self.spark.conf.get(k, None) for k in wanted}
        try:
            for k, v in wanted.items():
                self.spark.conf.set(k, v)
            df.write.parquet(path, partitionBy=by)
        finally:
            for k, v in before.items():
                if v is None:
                    self.spark.conf.unset(k)
                else:
                    self.spark.conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            _drop(self.spark, df.scratch_path)

    def drop_part(self, df: DataFrame, by: str, value) -> None:
        """Deletes the rows of one value of the column that the table was kept ``by``."""
        _drop(self.spark, f"{df.scratch_path}/{by}={value}")

    def clear(self) -> None:
        """Deletes all tables."""
        _drop(self.spark, self.root)


def any_columns(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators that return rows of their second argument with all columns: those whose names begin with two underscores, as
    the operator's own do, go by other names meanwhile."""

    @functools.wraps(operator)
    def sheltered(spark: SparkSession, docs: DataFrame, *args, **named) -> DataFrame:
        names = docs.columns
        if not any(n.startswith("__") for n in names):
            return operator(spark, docs, *args, **named)
        taken, inside = {n.lower() for n in names}, []
        for k, n in enumerate(names):
            if n.startswith("__"):
                n = f"input{k}"
                while n in taken:
                    n += "_"
            inside.append(n)
        return operator(spark, docs.toDF(*inside), *args, **named).toDF(*names)

    return sheltered


def blob_id(text: Column) -> Column:
    """128 bits of content address (the first half of SHA-256); null counts as the empty text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def row_digest(text: Column) -> Column:
    """SHA-256 of a text as it is; null counts as the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def drop_rows(docs: DataFrame, labelled: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The first row of every label, all columns. ``labelled``: doc_id, sha (row_digest), label of every row of ``docs``.

    Rows are told apart by doc_id and text, as ids may be null or repeat; null ids come last, and of rows equal in both
    one stays. Only what goes is named.
    """
    rows = scratch.keep(labelled.groupBy("label", "doc_id", "sha").count().withColumn("who", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha")))
    first = rows.groupBy("label").agg(F.min("who").alias("first"), F.count("*").alias("of")).where("of > 1").drop("of")
    gone = scratch.keep(rows.join(first, "label").where("who <> first").select(F.col("doc_id").alias("__id"), F.col("sha").alias("__of")))
    own = scratch.keep(rows.where("count > 1").select(F.col("doc_id").alias("__id"), F.col("sha").alias("__of")))
    names, same = docs.columns, F.col(doc_id).cast("long").eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__of"))
    kept = docs.withColumn("__sha", row_digest(F.col(text))).join(gone, same, "left_anti")
    if not own.isEmpty():
        kept = kept.join(own, same, "left_anti").unionByName(kept.join(own, same, "left_semi").dropDuplicates([doc_id, "__sha"]))
    return kept.select(*names)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _inverse(b: int) -> int:
    return pow(b, -1, 1 << 64)


class Rolling:
    """Hashes of all windows of a symbol sequence: sums of symbol hashes times powers of an odd base, modulo 2**64.

    Every window comes from two prefix sums, so any width costs the same few vector operations.
    """

    def __init__(self, symbols: np.ndarray, base: int = 0xD6E8FEB86659FD93):
        n = len(symbols)
        self.powers = _powers(base, n)
        self.back = _powers(_inverse(base), n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * self.powers[:n], out=self.sums[1:])

    def windows(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return (self.sums[width:] - self.sums[:n]) * self.back[:n]

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n + 1:
        size = max(1 << 16, 1 << (n + 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        _POWERS[base] = have
    return have


class WordHashes(dict):
    """64-bit hashes of words (bytes); a memo of bounded size."""

    def __init__(self, seed: int = 7, most: int = 300_000):
        import xxhash

        self._hash, self._seed, self._most = xxhash.xxh64_intdigest, seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self._most:
            self.clear()
        h = self[word] = self._hash(word, self._seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` entries, by doubling."""
    if len(keys) < width:
        return keys[:0]
    out, have = keys, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(keys) - width + 1], out[width - have :])
    return out


def batches(column):
    """Texts of an Arrow string column as bytes, null as empty."""
    return [b"" if x is None else x.encode() for x in column.to_pylist()]


__all__ = ["SPACES", "Rolling", "Scratch", "WordHashes", "any_columns", "blob_id", "drop_rows", "mix", "rolling_min", "row_digest", "table", "work_dir"]
