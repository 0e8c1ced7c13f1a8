"""Exact dedup by a tree merge of sorted digest runs, in DataFrame functions only.

The rows of a partition, with digests of their normalised texts, are a run (RUNS of them; more partitions share runs), so a
group of copies, however large, is spread over the runs that its rows lie in and is one entry in each. A run is cut into
SLICES by the leading bits of the digest and sorted. Rounds follow as in a binomial tree: run r goes to run r // FAN_IN;
each slice of the FAN_IN runs meets in one task (one exchange), which merges the sorted entries (a sort of runs and a
streaming aggregate) and keeps the smallest identifier of each digest. After the last round one run is left. A digest is
believed only together with a second, independent hash and the length of the text, which are part of the key at every
level and of the joins that follow.

Defined cases: null text is the empty text; null doc_id sorts after every other; of rows that repeat doc_id and text one
stays; very long texts are read whole; an empty table gives an empty table; further columns are not read by ``groups`` and
pass through ``dedup``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACES, Scratch, any_columns, table

RUNS, FAN_IN, SLICES = 64, 8, 4_096
_KEY = ["sha", "check", "size"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """rid, doc_id, sha (binary), check, size of every row."""
    t = docs.select(F.col(doc_id).cast("long").alias("doc_id"), normalised(F.col(text)).alias("t"))
    return t.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.unhex(F.sha2("t", 256)).alias("sha"), F.xxhash64("t").alias("check"), F.length("t").alias("size"))


def merged(digests: DataFrame, runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """sha, check, size, keep (struct of null flag, doc_id, rid), n: one row for each group."""
    slice_ = (F.conv(F.hex(F.substring("sha", 1, 2)), 16, 10).cast("int") % SLICES).alias("slice")
    entry = [F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid").alias("keep"), F.lit(1).cast("long").alias("n")]
    level = digests.select(slice_, *_KEY, F.pmod(F.shiftright("rid", 33), F.lit(runs)).cast("int").alias("run"), *entry)

    def reduced(d: DataFrame) -> DataFrame:
        return d.groupBy("run", "slice", *_KEY).agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))

    level = reduced(level)
    while runs > 1:
        runs = -(-runs // fan_in)
        level = level.withColumn("run", F.expr(f"run div {fan_in}").cast("int")).repartition("run", "slice").sortWithinPartitions("run", "slice", *_KEY)
        level = reduced(level)
    return level.drop("run", "slice")


def groups(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; rid and check, size for ``dedup``."""
    scratch = Scratch(spark)
    d = scratch.keep(digests(docs, doc_id, text))
    multiple = scratch.keep(merged(d).where("n > 1"))
    j = d.join(multiple, _KEY, "left")
    one = F.col("n").isNull()
    return j.select(
        "doc_id",
        F.when(one, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (one | (F.col("rid") == F.col("keep.rid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


@any_columns
def dedup(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns."""
    scratch = Scratch(spark)
    d = scratch.keep(digests(docs, doc_id, text))
    # Only what goes is named: (doc_id, digest) pairs other than their group's smallest; few rows against the table.
    multiple = scratch.keep(merged(d).where("n > 1").select(*_KEY, F.col("keep.doc_id").alias("keep_id")))
    gone = scratch.keep(d.join(multiple, _KEY).where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias("__id"), F.col("sha").alias("__gone")).distinct())
    own = scratch.keep(d.groupBy("doc_id", "sha").count().where("count > 1").select(F.col("doc_id").alias("__id"), F.col("sha").alias("__sha2")))
    names, here = docs.columns, F.unhex(F.sha2(normalised(F.col(text)), 256))
    kept = docs.withColumn("__sha", here).join(gone, F.col(doc_id).cast("long").eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__gone")), "left_anti")
    if not own.isEmpty():  # rows that repeat doc_id and text: one of them stays
        same = F.col(doc_id).cast("long").eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__sha2"))
        kept = kept.join(own, same, "left_anti").unionByName(kept.join(own, same, "left_semi").dropDuplicates([doc_id, "__sha"]))
    return kept.select(*names)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark, table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept,
       text_sha256
FROM d
"""
