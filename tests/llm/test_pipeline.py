"""Every stage of the pipeline, and the whole, on planted rows with null and repeated ids."""

import random
import weakref
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from glyphflow.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BAD = "SPAM!! BUY!! NOW!!"
r = random.Random(9)
ITEM = [f"item{k}" for k in range(30)]


def words(n):
    return ["".join(r.choices("abcdefghij", k=5)) for _ in range(n)]


def near(base, at):
    return [f"new{at}x{i}" if i in at else w for i, w in enumerate(base)]


BASE = [words(200), words(120)]
COPIES = [(0, near(BASE[0], (50,))), (0, near(BASE[0], (20, 150))), (0, near(BASE[0], (10, 90, 180))), (1, near(BASE[1], (60,)))]
LEAK = words(15) + [w if i % 5 else "zz" for i, w in enumerate(ITEM)] + words(15)
CLEAN = [(i, " ".join(words(40))) for i in range(200, 224)] + [(None, " ".join(words(40))), (None, " ".join(words(40))), (230, " ".join(words(40))), (230, " ".join(words(40)))]
KEPT = [*CLEAN, (1, " ".join(BASE[0])), (2, " ".join(BASE[1]))]
EXACT = [(300, KEPT[0][1]), (301, KEPT[-2][1]), (None, KEPT[1][1]), (230, CLEAN[-1][1])]
NEAR = [(310 + i, " ".join(t)) for i, (_, t) in enumerate(COPIES)] + [(None, " ".join(COPIES[0][1]).upper())]
LOW = [(i, f"{BAD} " * 5 + f"n{i}") for i in range(400, 416)] + [(None, f"{BAD} " * 6), (230, f"{BAD} " * 7)]
LEAKS = [(320, " ".join(LEAK)), (None, " ".join(ITEM))]


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    rows = KEPT + EXACT + NEAR + LOW + LEAKS
    random.Random(1).shuffle(rows)
    spark.createDataFrame([(i, t, "en", "h/p", len(t)) for i, t in rows], SCHEMA).write.parquet(f"{root}/documents.parquet")
    labels = [(i, 0 if i >= 400 else 1, 0) for i, _ in rows if i is not None and i != 230]
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, " ".join(ITEM)), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def after(spark, given, stage, rows):
    docs = spark.createDataFrame([(i, t, "en", "h/p", len(t)) for i, t in rows], SCHEMA)
    return Counter((x.doc_id, x.text) for x in dict(corpus_pipeline.STAGES)[stage](spark, docs, given).collect())


def test_quality(spark, given):
    docs = spark.read.parquet(f"{given}/documents.parquet")
    got = Counter((x.doc_id, x.text) for x in corpus_pipeline.filter_quality(spark, docs, given).collect())
    assert got == Counter(KEPT + EXACT + NEAR + LEAKS)


def test_quality_holds_the_words_of_one_text(monkeypatch):
    """The words of a text are gone before those of the text after the next are read, however long the batch."""

    class Words(set):
        __hash__ = object.__hash__

    held, most, real = weakref.WeakSet(), [], quality.features

    def features(text):
        of, words = real(text)
        held.add(words := Words(words))
        most.append(len(held))
        return of, words

    model = quality.Logit(np.arange(48.0).reshape(6, 8) % 7, [[0], [], [0], [], [1], []], ["buy", "aaaaa"], np.array([1.0, 0, 1, 0, 1, 0]))
    texts = [" ".join(words(9)) + " buy" * (i % 3) for i in range(2 * quality.SLICE + 9)] + [None, ""]
    want = [model(*real(t)) for t in texts]
    monkeypatch.setattr(quality, "features", features)
    got = quality.judged(pa.array(texts, pa.string()), (model, model))
    assert got.field("p_low").to_pylist() == got.field("p_toxic").to_pylist() == want and len(set(want)) > 1
    assert len(most) == len(texts) and max(most) <= 2


@pytest.mark.parametrize("stage, gone", [("exact_dedup", EXACT), ("near_dedup", NEAR), ("decontaminate", LEAKS)])
def test_stage(spark, given, stage, gone):
    assert after(spark, given, stage, KEPT + gone) == Counter(KEPT)


def test_run(spark, given):
    got = corpus_pipeline.run(spark, given)
    assert got.columns == ["doc_id", "n_tokens", "ids"]
    rows = got.collect()
    text = corpus_pipeline.sentencepiece.decode(spark, got["ids"])
    assert Counter((x.doc_id, x.text) for x in got.select("doc_id", text.alias("text")).collect()) == Counter(KEPT)
    assert all(x.n_tokens == len(x.ids) for x in rows)
