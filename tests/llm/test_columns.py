"""Further columns of any name pass through the operators that return rows, and shared tables go with the session."""

import os
import subprocess
import sys

import pytest

from glyphflow.llm import decontam, exact_dedup, nearcopies, quality, simhash

NAMES = ["__sha", "__id", "__gone", "__of", "__blob", "__sha2", "__source", "__from", "__ID", "label", "items", "input1"]
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def items(spark):
    return spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)))], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(30)], "doc_id long, quality long, toxic long")


OPERATORS = {
    "exact": lambda s, d: exact_dedup.dedup(s, d), "near": lambda s, d: nearcopies.dedup(s, d), "simhash": lambda s, d: simhash.dedup(s, d),
    "clean": lambda s, d: decontam.clean(s, d, items(s)), "quality": lambda s, d: quality.accepted(s, d, labels(s)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(spark, name):
    text = lambda i: "SPAM!! BUY!! NOW!!" * 5 if i % 4 == 0 else " ".join(f"w{i % 7}{k}" for k in range(40))
    rows = [(None if i == 5 else i, text(i), f"s{i % 3}", *[f"{n}{i}" for n in NAMES[:8]], *[f"{n}{i}" for n in NAMES[9:]]) for i in range(30)]
    names = [n for n in NAMES if n != "__ID"]
    plain = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, source string")
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    got = OPERATORS[name](spark, d)
    assert got.columns == d.columns
    kept = {tuple(r[:3]) for r in OPERATORS[name](spark, plain).collect()}
    whole = got.collect()
    assert {tuple(r[:3]) for r in whole} == kept and 0 < len(kept) < 30 + (name == "clean")
    assert {tuple(r) for r in whole} <= set(rows)


def test_shared_tables_go_with_the_session(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
from glyphflow.llm import exact_dedup
d = s.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
assert exact_dedup.dedup(s, d).count() == 1
import os
assert os.listdir("{tmp_path}/glyphflow")
s.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True)
    folder = tmp_path / "glyphflow"
    assert not folder.exists() or not os.listdir(folder)
