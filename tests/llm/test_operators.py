"""Corpus operators against brute force, on texts with nulls, empties, copies and repeats."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphflow.llm import decontam, exact_dedup, langid, quality, secrets, sentencepiece, simhash
from glyphflow.llm.windows import Shape, cut

SCHEMA = "doc_id long, text string, lang string, source string, n long, count long"


def texts():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdé"), rng.integers(2, 6)))
    base = [" ".join(word() for _ in range(k)) for k in (3, 12, 60, 200)]
    out = [None, "", "   ", "one", "x" * 700, "a b " * 300, *base, *base, base[2] + " " + base[3], base[3][50:] + base[2], base[1].replace(" ", "\n", 3)]
    return [(i, t, "aa" if i % 2 else "bb", f"h{i % 3}/p", i, i) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), SCHEMA)


@pytest.mark.parametrize("unit, width, gram", [("word", 35, 6), ("word", 5, 2), ("byte", 200, 32), ("byte", 20, 4)])
def test_cut(spark, docs, unit, width, gram):
    seqs = {i: (t or "").encode().split() if unit == "word" else [bytes([b]) for b in (t or "").encode()] for i, t, *_ in texts()}
    seen = Counter(tuple(s[k : k + width]) for s in seqs.values() for k in range(len(s) - width + 1))
    for r in cut(spark, docs, Shape(unit, width, gram)).collect():
        s = seqs[r.doc_id]
        gone = [False] * len(s)
        for k in range(len(s) - width + 1):
            if seen[tuple(s[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        kept = (b" " if unit == "word" else b"").join(x for x, g in zip(s, gone) if not g)
        assert (r.n, r.n_removed, r.kept_sha256) == (len(s), sum(gone), hashlib.sha256(kept).hexdigest())


def test_simhash_components(spark, docs):
    got = simhash.clusters(spark, docs).collect()
    fp = {r.doc_id: r.fp & (2**64 - 1) for r in got}
    root = {i: i for i in fp}
    for _ in fp:
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= simhash.TAU:
                    root[a] = root[b] = min(root[a], root[b])
    assert {r.doc_id: r.component_id for r in got} == root


def test_exact_dedup(spark, docs):
    import re

    norm = {i: re.sub("[\x20\x09-\x0d]+", " ", t or "") for i, t, *_ in texts()}
    first = {}
    for i in sorted(norm):
        first.setdefault(norm[i], i)
    got = exact_dedup.groups(spark, docs).collect()
    assert {r.doc_id: (r.keep_id, r.kept) for r in got} == {i: (first[t], first[t] == i) for i, t in norm.items()}
    assert sorted(r.doc_id for r in exact_dedup.dedup(spark, docs).collect()) == sorted(first.values())


def test_secrets_ledger(spark):
    d = spark.createDataFrame([(1, "password = abcdefghijkl x"), (2, None), (3, "password = abcdefghijkl x"), (4, "AKIA" + "A" * 14 + " 0123456789abcdef0")], "doc_id long, text string")
    versions, ledger = secrets.scan(spark, d)
    got = {r.doc_id: [(s["kind"], s["start"], s["end"]) for s in r.spans] for r in secrets.findings(versions, ledger).collect()}
    assert got == {1: [("assign", 0, 23)], 2: [], 3: [("assign", 0, 23)], 4: [("access", 0, 18), ("hex", 19, 36)]}
    again, later = secrets.scan(spark, d, ledger)
    assert later.count() == ledger.count()


def test_round_trip(spark):
    t = [None, "", " ", "a  b\n▁c 😀 " + "z" * 500, "Hello world", "  lead"]
    d = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    e = sentencepiece.encode(spark, d, ["doc_id", "text"])
    for r in e.select("doc_id", "text", sentencepiece.decode(spark, F.col("ids")).alias("back")).collect():
        assert r.back == (r.text or "")


def test_language(spark):
    rows = [(i, "der die und nicht" if i % 2 else "the and of with", "de" if i % 2 else "en") for i in range(40)]
    d = spark.createDataFrame([*rows, (100, None, "de"), (101, "123 !", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(spark, d, langid.train(d), ["doc_id"]).collect()}
    assert got == {**{i: x for i, _, x in rows}, 100: "und", 101: "und"}


def test_decontamination(spark):
    item = " ".join(f"w{i}" for i in range(40))
    near = " ".join(f"w{i}" if i % 9 else "zz" for i in range(40))
    d = spark.createDataFrame([(1, "x y " + item), (2, "q " + near + " q"), (3, " ".join(f"v{i}" for i in range(90))), (4, None)], "doc_id long, text string")
    b = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    assert {r.doc_id: list(r["items"]) for r in decontam.matches(spark, d, b).collect()} == {1: [7], 2: [7], 3: [], 4: []}


def test_quality(spark):
    d = spark.createDataFrame([(i, "SPAM!! BUY!! NOW!!" * 5 if i % 4 == 0 else "plain words in a line of text", f"s{i % 3}") for i in range(80)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(60)], "doc_id long, quality long, toxic long")
    assert {r.doc_id for r in quality.accepted(spark, d, labels).collect()} == {i for i in range(80) if i % 4}


def test_empty_tables(spark):
    d = spark.createDataFrame([], SCHEMA)
    b = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    frames = [cut(spark, d, Shape("word", 5, 2)), simhash.clusters(spark, d), exact_dedup.groups(spark, d), decontam.matches(spark, d, b), sentencepiece.encode(spark, d, ["doc_id"]), quality.scores(spark, d, labels), langid.predict(spark, d, langid.train(d), ["doc_id"])]
    assert [f.count() for f in frames] == [0] * 7
