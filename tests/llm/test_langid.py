"""Predictions from remembered words equal those read n-gram by n-gram."""

from collections import Counter

import numpy as np

from glyphflow.llm import langid


def test_memo(monkeypatch):
    monkeypatch.setattr(langid, "MEMO", 3)
    learned = {"de": "der die und nicht straße", "en": "the and of with the"}
    model = langid.Filters.of({k: langid.grams(t) for k, t in learned.items()}, Counter(de=1, en=1))
    memo = {}
    for text in (None, "", "12 !", "é", "the die the of", "qqq zzz", *learned.values(), "Ø" * 900):
        got = langid.grams(text or "")
        if not got:
            want = ("und", 0.0)
        else:
            bits = np.bitwise_and.reduce(model.slots[langid._slots(list(got))], axis=0)[:, 0]
            n = np.array(list(got.values()), float)
            hits = np.array([(n * (bits >> np.uint64(b) & np.uint64(1))).sum() for b in range(2)])
            right = np.maximum((hits - n.sum() * model.false) / (1 - model.false), 0)
            want = (model.langs[int(right.argmax())], min(1.0, right.max() / right.sum())) if right.max() > 0 else (model.common, 0.0)
        assert model.predict(text, memo) == want == model.predict(text)


def test_many_languages_and_numerals(spark):
    rows = [(i, f"{chr(97 + i % 20)}{chr(97 + i // 20)}x" * 3 + f" q{chr(97 + i % 20)}{chr(97 + i // 20)}z", f"l{i:02}") for i in range(70)]
    d = spark.createDataFrame([*rows, (200, "½ ² 12", "l00"), (201, None, "l01"), (202, "abx½abx", None)], "doc_id long, text string, lang string")
    model = langid.train(d)
    assert len(model.langs) == 70 and model.slots.shape[1] == 2
    got = {r.doc_id: r.lang_pred for r in langid.predict(spark, d, model, ["doc_id"]).collect()}
    assert got == {**{i: x for i, _, x in rows}, 200: "und", 201: "und", 202: got[202]} and got[202] != "und"


def test_filters_in_spark_equal_filters_here(spark):
    rows = [(i, "der die und nicht straße" if i % 2 else "the and of with der", "de" if i % 2 else "en") for i in range(8)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = {x: sum((langid.grams(t) for _, t, y in rows if y == x), Counter()) for x in ("de", "en")}
    assert (model.slots == langid.Filters.of(counts, {"de": 4, "en": 4}).slots).all()


def test_remembered_grams_change_nothing(monkeypatch):
    """Words all of whose n-grams were met before ask the filters for nothing; forgetting n-grams changes no prediction."""
    learned = {"de": "der die und nicht straße", "en": "the and of with the"}
    counts = {k: langid.grams(t) for k, t in learned.items()}
    texts = ["the die the of", "qqq zzz", *learned.values(), "Ø" * 900, "ab", "abab", "ababab"]
    want = [langid.Filters.of(counts, Counter(de=1, en=1)).predict(x) for x in texts]
    model, asked, slots = langid.Filters.of(counts, Counter(de=1, en=1)), [], langid._slots
    monkeypatch.setattr(langid, "_slots", lambda keys: asked.extend(keys) or slots(keys))
    assert [model.predict(x) for x in texts * 2] == want * 2
    assert len(asked) == len(set(asked))
    monkeypatch.setattr(langid, "GRAMS", 5)
    assert [model.predict(x) for x in texts] == want


def test_sample_is_the_least_hashes(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    d = spark.range(4000).selectExpr("case when id % 50 = 0 then null when id % 50 = 1 then 7 else id end as k", "case when id % 3 = 0 then 'a' else 'b' end as lang").repartition(6)
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("k"), "k"))
    for n in (1, 70, 900, 5000):
        want = {tuple(r) for r in d.select("lang", "k", turn.alias("t")).where(F.col("t") <= n).select("lang", "k").collect()}
        got = [tuple(r) for r in langid._chosen(d, "k", n).collect()]
        assert set(got) == want and len(got) == len(want)
