"""The near-copy stage of the pipeline against brute force over all pairs."""

import hashlib
import random
import sys
from collections import Counter

import numpy as np

import corpus_pipeline
from glyphflow.llm import _common, nearcopies

SCHEMA = "doc_id long, text string, source string"


def sets(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def survivors(rows):
    """Brute force: all pairs of Jaccard 0.8 or more, components, the first row of each (null ids last, ties by digest)."""
    s = [sets(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    near = 0
    for i in range(len(rows)):
        for j in range(i):
            both, either = len(s[i] & s[j]), len(s[i] | s[j])
            if both * 5 >= either * 4:
                near += both < either
                root[find(i)] = find(j)
    first = {}
    for i, (doc_id, text, _) in enumerate(rows):
        first.setdefault(find(i), []).append((doc_id is None, doc_id or 0, hashlib.sha256((text or "").encode()).digest(), text or ""))
    return Counter((None if none else i, t) for none, i, _, t in map(min, first.values())), near


def planted():
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    line = [word() for _ in range(12)]
    texts = []
    for size in (6, 20, 45, 60, 90, 150, 200, 300, 400):
        base = [word() for _ in range(size)] + line
        texts.append(base)
        for far in (1, 1, 2, 2, 3, 4, 6):  # substitutions: each breaks up to 5 shingles
            t = list(base)
            for k in r.sample(range(size), min(size, far * max(1, size // 100))):
                t[k] = word()
            texts.append(t)
    rows = [(i, " ".join(t), "h/p") for i, t in enumerate(texts)]
    r.shuffle(rows)
    clean = [" ".join(word() for _ in range(40)) for _ in range(4)]
    return rows + [(None, clean[0], "a"), (None, clean[1], "b"), (None, clean[0].upper(), "c"), (7, clean[2], "d"), (7, clean[3], "e"), (500, clean[2] + " tail", "f"), (501, None, "g"), (502, " ", "h"), (503, "one two", "i"), (504, "One  two", "j"), (505, clean[3], "k"), (505, clean[3], "k")]


def test_near_copies(spark):
    rows = planted()
    want, near = survivors(rows)
    assert near > 30
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert Counter((r.doc_id, r.text or "") for r in got) == want


def test_large_group(spark):
    """Copies of one text, each with its own changes: the stars link most, all must be linked as brute force does."""
    r = random.Random(6)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(120):
        t = list(base)
        for k in r.sample(range(100), 1 + i % 4):
            t[k] = f"x{r.random()}"
        rows.append((i, " ".join(t), ""))
    assert Counter((x.doc_id, x.text) for x in nearcopies.dedup(spark, spark.createDataFrame(rows, SCHEMA)).collect()) == survivors(rows)[0]


def test_empty(spark):
    assert nearcopies.dedup(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_sketches_never_part_similar_sets():
    """Sets differ in as many shingles as cells of their sketches, or more."""
    r = np.random.default_rng(3)
    for size in (0, 1, 2, 9, 50, 400, 3_000):
        a = np.unique(r.integers(0, 1 << 63, size, np.uint64) * np.uint64(2))
        for gone, new in ((0, 0), (1, 0), (0, 1), (5, 3), (size, 20)):
            b = np.unique(np.append(a[gone:], r.integers(0, 1 << 63, new, np.uint64) * np.uint64(2) + np.uint64(1)))
            cells = np.bitwise_count((nearcopies.sketch(a) ^ nearcopies.sketch(b)).view(np.uint64)).sum()
            assert cells <= len(np.setxor1d(a, b)) and (gone + new or not cells)


def test_tables_go_and_shares_change_nothing(spark, tmp_path, monkeypatch):
    """Only what names the rows that go is left on disk, however many shares the pairs are verified in."""
    monkeypatch.setattr(nearcopies, "SHARE", 7)
    monkeypatch.setattr(_common, "work_dir", lambda spark: f"file://{tmp_path}")
    rows = planted()
    got = nearcopies.dedup(spark, spark.createDataFrame(rows, SCHEMA))
    assert len(list(tmp_path.glob("glyphflow/*/*"))) <= 3
    assert Counter((r.doc_id, r.text or "") for r in got.collect()) == survivors(rows)[0]


def test_large_group_is_not_all_pairs(spark, monkeypatch):
    """Edited copies of one text, many too far from all others: what is compared grows with the group, not with its square."""
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    base, rows = [word() for _ in range(150)], []
    for i in range(400):
        t = list(base)
        for k in r.sample(range(0, 150, 5), i % 6):
            t[k] = word()
        rows.append((i, " ".join(t), "h/p"))
    compared, keep = [], _common.Scratch.keep

    def counted(self, df, *args, **named):
        out = keep(self, df, *args, **named)
        if sys._getframe(1).f_code.co_name == "verified":
            compared.append(out.count())
        return out

    monkeypatch.setattr(_common.Scratch, "keep", counted)
    got = nearcopies.dedup(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((x.doc_id, x.text) for x in got) == survivors(rows)[0]
    assert compared and max(compared) < 10 * len(rows)
