"""Deep-shallow order and removal against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from glyphflow.llm import suffix
from glyphflow.llm.windows import Shape, cut

from test_operators import SCHEMA, texts


@pytest.mark.parametrize("letters, width, depth", [(b"ab", 40, 2), (b"a", 24, 3), (b"abcdefgh", 20, 1), (bytes(range(256)), 16, 2), (b"ab", 5, 4)])
def test_order(letters, width, depth):
    rng = np.random.default_rng(5)
    part = bytes(rng.choice(list(letters), 90).tolist())
    raw = part + bytes(rng.choice(list(letters), 60).tolist()) + part[7:]
    strings = [raw[s : s + width] for s in range(len(raw))]
    group = np.arange(len(raw)) * 3 // len(raw)
    order, shared = suffix.ordered(strings, group, width, depth)
    full = [(int(g), s.ljust(width, b"\0")) for g, s in zip(group, strings)]
    assert [full[k] for k in order] == sorted(full)
    for i, j, n in zip(order, order[1:], shared[1:]):
        (g, a), (h, b) = full[i], full[j]
        assert n == -1 if g != h else min(n, width) == next((k for k in range(width) if a[k] != b[k]), width)


def test_repeats():
    rng = np.random.default_rng(6)
    width, gram = 12, b"GRAM"
    left = [bytes(rng.choice(list(b"ab"), 8).tolist()) for _ in range(60)]
    right = [bytes(rng.choice(list(b"ab"), 8).tolist()) for _ in range(60)]
    at, end = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
    runs = [(x[8 - a :] + gram + y[:e], int(a)) for x, y, a, e in zip(left, right, at, end) if a + e >= 8]
    group, weight = np.arange(len(runs)) // 20, np.where(np.arange(len(runs)) % 9, 1, 2)
    count = np.array([len(p) - width + 1 for p, _ in runs])
    place = np.array([a for _, a in runs])
    seen = Counter()
    for (p, a), c, g, w in zip(runs, count, group, weight):
        for k in range(c):
            seen[g, a - k, p[k : k + width]] += int(w)
    got = suffix.repeats([p for p, _ in runs], place, count, weight, np.zeros(len(runs), int), np.full(len(runs), 8), group, width)
    for (p, a), c, g, off in zip(runs, count, group, got):
        assert off.tolist() == [k for k in range(c) if seen[g, a - k, p[k : k + width]] > 1]


@pytest.mark.parametrize("width, gram, most", [(200, 32, 1024), (20, 4, 1024), (20, 4, 2)])
def test_removal(spark, monkeypatch, width, gram, most):
    monkeypatch.setattr(suffix, "MOST", most)
    raw = {i: (t or "").encode() for i, t, *_ in texts()}
    seen = Counter(s[k : k + width] for s in raw.values() for k in range(len(s) - width + 1))
    docs = spark.createDataFrame(texts(), SCHEMA)
    for r in cut(spark, docs, Shape("byte", width, gram), branches=suffix.by_order).collect():
        s = raw[r.doc_id]
        gone = np.zeros(len(s), bool)
        for k in range(len(s) - width + 1):
            if seen[s[k : k + width]] > 1:
                gone[k : k + width] = True
        kept = bytes(x for x, g in zip(s, gone) if not g)
        assert (r.n, r.n_removed, r.kept_sha256) == (len(s), int(gone.sum()), hashlib.sha256(kept).hexdigest())


def test_texts_share_batches(spark, monkeypatch):
    """Paths and windows of many texts share Arrow batches, and batches of any size give the same result."""
    from glyphflow.llm import windows

    line = [f"l{k}" for k in range(12)]
    d = spark.createDataFrame([(i, " ".join([*(f"w{i}x{k}" for k in range(i % 9)), *line[: 5 + i % 8], f"t{i}"])) for i in range(60)], "doc_id long, text string").coalesce(1)
    want = sorted(map(tuple, windows.cut(spark, d, windows.Shape("word", 5, 2)).collect()))
    assert any(r[2] for r in want)
    rows = windows.Rows(["a"])
    assert not [b for k in range(50) for b in rows.add([np.full(3, k)])]
    (one,) = rows.rest()
    assert one.num_rows == 150 and not list(rows.rest())
    monkeypatch.setattr(windows, "ROWS", 1)
    assert sorted(map(tuple, windows.cut(spark, d, windows.Shape("word", 5, 2)).collect())) == want
