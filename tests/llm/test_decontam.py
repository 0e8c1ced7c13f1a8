"""Recall of benchmark overlap against every allowed pattern of substitutions."""

import random
from itertools import combinations

import numpy as np
import pytest

from glyphflow.llm import decontam


def killed(masks, n):
    """The least number of substitutions that leaves no mask a place to hit in n positions."""
    span = max(map(len, masks))
    reads = [[i for i, c in enumerate(m) if c == "1"] for m in masks]
    state = {(): 0}
    for _ in range(n):
        nxt = {}
        for before, cost in state.items():
            for gone in (0, 1):
                s = (before + (gone,))[-span:]
                if not any(len(s) >= len(m) and not any(s[len(s) - len(m) + i] for i in r) for m, r in zip(masks, reads)):
                    nxt[s[1 - span :]] = min(cost + gone, nxt.get(s[1 - span :], n + 1))
        state = nxt
    return min(state.values())


def test_masks_lose_nothing():
    masks = [decontam.MASKS[k] for k in decontam.masks_of(5)]
    assert any("0" in m for m in masks)
    assert all(killed(masks, n) > n // 5 for n in range(5, 121))


@pytest.mark.parametrize("n", range(1, 21))
def test_every_pattern(n):
    """Every allowed pattern keeps a seed and verifies; one substitution more does not, with the whole item asked."""
    q = np.arange(1, n + 1).astype(np.uint64)
    for gone in combinations(range(n), n // 5):
        d = q.copy()
        d[list(gone)] = 99
        assert any(np.isin(decontam.seeds(d, m), decontam.seeds(q, m)).any() for m in decontam.masks_of(n)), gone
        assert decontam.agrees(d, q, 0)
    d[: n // 5 + 1] = 98
    assert not decontam.agrees(np.where(np.arange(n) <= n // 5, 98, q).astype(np.uint64), q, 0)


def brute(a, b):
    """Any diagonal with a stretch of 20 tokens (the whole item, where shorter) that agrees in 0.8 of its places."""
    least = min(20, len(a))
    for shift in range(-len(a), len(b)):
        lo, hi = max(0, shift), min(len(b), shift + len(a))
        same = [a[k - shift] == b[k] for k in range(lo, hi)]
        if any(5 * sum(same[i:j]) >= 4 * (j - i) for i in range(len(same)) for j in range(i + least, len(same) + 1)):
            return True
    return False


def test_against_brute_force(spark):
    r = random.Random(8)
    items = [[f"w{r.randrange(60)}" for _ in range(r.choice([2, 4, 5, 7, 9, 12, 16, 20, 25, 40, 55]))] for _ in range(40)]
    docs = []
    for k in range(160):
        item, rate = items[k % 40], r.choice([0.0, 0.1, 0.18, 0.22, 0.3])
        docs.append([f"v{r.randrange(9)}" for _ in range(r.randrange(6))] + ["zz" if r.random() < rate else w for w in item][r.randrange(4) * (len(item) > 8) :] + [f"u{r.randrange(9)}" for _ in range(r.randrange(6))])
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)] + [(900, None), (901, ""), (None, " ".join(docs[0]))], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(900, None), (901, "!")], "item_id long, text string")
    got = {x.doc_id: list(x["items"]) for x in decontam.matches(spark, d, b).collect()}
    want = {i: [k for k, q in enumerate(items) if brute(q, x)] for i, x in enumerate(docs)}
    assert got == {**want, 900: [], 901: [], None: want[0]}
    assert 20 < sum(map(bool, want.values())) < 150
    assert sorted((x.doc_id for x in decontam.clean(spark, d, b).collect() if x.doc_id is not None)) == sorted(i for i, x in got.items() if not x and i is not None)


def test_texts_hashed_at_once_equal_those_hashed_alone():
    """Empty and short texts among others: each has its own seeds, and none that crosses into the next."""
    from glyphflow.llm._common import WordHashes

    memo, r = WordHashes(), random.Random(5)
    texts = ["", None, "a", "a b", "a b c", *[" ".join(r.choice("abcd") for _ in range(r.randrange(30))) for _ in range(60)], "", "a b c d e"]
    bits = np.full(1 << (decontam.SIEVE - 3), 0x55, np.uint8)
    masks, ts = list(range(len(decontam.MASKS))), [decontam.tokens(x, memo) for x in texts]
    want = []
    for t in ts:
        h = [(int(v.view(np.int64)), p) for m in masks for p, v in enumerate(decontam.seeds(t, m))]
        want.append([(a, p) for a, p in h if not any(s % 2 for s in (int(decontam._slot(np.array([a]).view(np.uint64), k)[0]) for k in (0, 1)))])
    got = [[(x["h"], x["p"]) for x in g] for g in decontam.found_in(ts, masks, bits)]
    assert got == want and any(want) and not want[0]


def test_tokens_of_ascii_equal_the_expression():
    from glyphflow.llm._common import WordHashes

    memo = WordHashes()
    for x in ["".join(map(chr, range(128))), "A_b-c9\x00d\x1ce", "É_a", "", "__", "x\x7fy"]:
        assert decontam.tokens(x, memo).tolist() == memo.of([w.encode() for w in decontam._TOKEN.findall(x.lower())]).tolist()
