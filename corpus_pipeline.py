"""Corpus pipeline: quality, exact dedup, near-dedup, decontamination, encoding. Part of the subpackage llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.llm import decontam, exact_dedup, quality, sentencepiece, simhash
from glyphflow.llm._common import Scratch, table


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(spark, docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(spark, docs, verified=True)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the ids of every document that is left."""
    return sentencepiece.encode(spark, docs, ["doc_id"]).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", filter_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("encode", encode_pieces),
]

#: Classifier, near-copy join and lattice have no SQL; tests/llm/test_pipeline.py runs each stage and the whole on planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs, last = Scratch(spark), table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(*last)
        last = [docs]
    return docs
