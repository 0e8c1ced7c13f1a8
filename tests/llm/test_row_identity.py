"""Decisions fall on rows, not on ids: null and repeated doc_id."""

from collections import Counter

from glyphflow.llm import quality, simhash

SCHEMA = "doc_id long, text string, source string"
BAD, GOOD = "SPAM!! BUY!! NOW!!" * 5, "plain words in a line of text"


def test_quality(spark):
    rows = [(i, BAD if i % 4 == 0 else GOOD, f"s{i % 3}") for i in range(80)]
    odd = [(None, BAD, "s0"), (None, GOOD, "s1"), (None, GOOD, "s1"), (None, None, None), (70, BAD, "s1"), (72, GOOD, "s0")]
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(60)], "doc_id long, quality long, toxic long")
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    want = Counter(x for x in rows + odd if x[1] == GOOD)
    assert Counter(tuple(r) for r in quality.accepted(spark, docs, labels).where("text is not null").collect()) == want


def test_simhash_dedup(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, a, ""), (7, a, ""), (7, b, ""), (9, b, ""), (None, c, ""), (None, c + " ", ""), (None, "d e f g h i", ""), (9, c, ""), (5, "q r s t", ""), (5, "q r s t", ""), (None, "only null u v", ""), (None, "another null w x", "")]
    got = Counter((r.doc_id, r.text) for r in simhash.dedup(spark, spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == Counter({(3, a): 1, (7, b): 1, (9, c): 1, (None, "d e f g h i"): 1, (5, "q r s t"): 1, (None, "only null u v"): 1, (None, "another null w x"): 1})
