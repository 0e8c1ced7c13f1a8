"""Decoding of recogniser outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ctc(df: DataFrame, logits: Column, classes: int, charset: list[str]) -> DataFrame:
    """``df`` with text and score of a flat T x C array: first largest class of each step, repeats and blanks collapsed."""
    steps = F.transform(F.sequence(F.lit(0), (F.size("__l") / classes).cast("int") - 1), lambda t: F.slice("__l", t * classes + 1, classes))
    df = df.withColumn("__l", logits).withColumn("__s", F.transform(steps, lambda a: F.struct((F.array_position(a, F.array_max(a)) - 1).alias("c"), F.array_max(a).cast("double").alias("p"))))
    emit = F.filter("__s", lambda s, i: (s["c"] != 0) & ((i == 0) | (s["c"] != F.get("__s", i - 1)["c"])) & (s["c"] < len(charset)))
    df = df.withColumn("__e", emit)
    chars = F.array(*[F.lit(x) for x in charset])
    total = F.aggregate("__e", F.lit(0.0), lambda a, s: a + F.when(s["p"] > 0, F.ln(s["p"])).otherwise(0.0))
    score = F.when(F.size("__e") > 0, F.exp(total / F.size("__e"))).otherwise(0.0)
    return df.withColumn("text", F.array_join(F.transform("__e", lambda s: F.get(chars, s["c"].cast("int"))), "")).withColumn("score", score).drop("__l", "__s", "__e")


def steps(df: DataFrame, logits: Column, classes: int) -> DataFrame:
    """``df`` once for each time step t of a flat T x C array, with its first largest class c and value p."""
    parts = F.transform(F.sequence(F.lit(0), (F.size(logits) / classes).cast("int") - 1), lambda t: F.slice(logits, t * classes + 1, classes))
    best = F.transform(parts, lambda a: F.struct((F.array_position(a, F.array_max(a)) - 1).alias("c"), F.array_max(a).cast("double").alias("p")))
    return df.select(*df.columns, F.posexplode(best).alias("__t", "__s")).select(*df.columns, F.col("__t").cast("long").alias("t"), "__s.*")


#: Entries of a dictionary up to which it is broadcast.
SMALL = 1 << 16


def ctc_by_table(df: DataFrame, key: list[str], logits: Column, classes: int, dictionary: DataFrame, small: int = SMALL) -> DataFrame:
    """key, text, score of a flat T x C array by a dictionary table (class, entry), which may be of any size: it is broadcast up to
    ``small`` rows and joined by class beyond. Repeats and class 0 collapse; a class that the table lacks ends a repeat but gives
    nothing, and nothing to the score."""
    s = steps(df.select(*key, logits.alias("__l")), F.col("__l"), classes).select(*key, "t", F.col("c").cast("long").alias("class"), "p")
    s = s.withColumn("before", F.lag("class").over(Window.partitionBy(*key).orderBy("t")))
    s = s.where((F.col("class") != 0) & (F.col("before").isNull() | (F.col("before") != F.col("class"))))
    known = dictionary.select(F.col("class").cast("long").alias("class"), "entry")
    if known.limit(small + 1).count() <= small:
        known = F.broadcast(known)
    got = s.join(known, "class").groupBy(*key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "entry"))), lambda x: x["entry"]), "").alias("text"),
        F.exp(F.sum(F.when(F.col("p") > 0, F.ln("p")).otherwise(0.0)) / F.count("*")).alias("score"),
    )
    return df.select(*key).join(got, key, "left").select(*key, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
