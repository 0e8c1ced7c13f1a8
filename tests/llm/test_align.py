"""Token alignment against a brute-force version on the libraries' own encodings."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from glyphflow.llm import align

TEXTS = [None, "", " ", "one", "a▁b", "<|endoftext|> <s> is text", "it's 'tis we'll", "  lead  and trail  ", "a   b    c", "tab\tline\r\nend {\r\n}", "漢字かな交じり文 😀😀 𠀀 é ﬁ ß", "=" * 77 + "-" * 99, "1234567890" * 20, "x" + " " * 5000 + "y", "a" * 3000, "same words here", "same words here", "\x00 nul", "word and number 12 " * 2000]


def by_hand(texts):
    """(A ids, B ids, groups) of every text by comparing byte offsets."""
    import sentencepiece

    a, b, out = align._library(align.A_FILE), sentencepiece.SentencePieceProcessor(model_file=align.B_FILE), []
    spelt_a, spelt_b = align.ByRanks().bytes, align.ByPieces().bytes
    for t in texts:
        raw, ids = (" " + (t or "")).encode(), ([], [])
        if t:
            ids = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            spelt = [[spelt_a[i] for i in ids[0]], [b" " if x == "▁".encode() else x for x in (spelt_b[i] for i in ids[1])]]
            if any(b"".join(x) != raw for x in spelt):
                ids = [], []
        if not ids[0]:
            out.append([])
            continue
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in spelt]
        groups, at = [], [0, 0]
        for end in sorted(set(ends[0]) & set(ends[1])):
            to = [e.index(end) + 1 for e in ends]
            groups.append((ids[0][at[0] : to[0]], ids[1][at[1] : to[1]]))
            at = to
        out.append(groups)
    return out


def expected(texts):
    rows = by_hand(texts)
    linked = [Counter((a, b) for ga, gb in groups for a in ga for b in gb) for groups in rows]
    count = Counter(p for c in linked for p in c)
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for groups, c in zip(rows, linked):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(c.values()), sum(n for p, n in c.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in c.items()), digest))
    return out


@pytest.mark.parametrize("hot", [align.HOT, 40, 0])
def test_against_brute_force(spark, hot):
    d = spark.createDataFrame([(i, t, "kept", 7, 8) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_a string, __row long, __keep0 long")
    got = align.align(spark, d, ["doc_id", "n_a", "__row", "__keep0"], hot=hot, derived={"digest": align.groups_digest("a", "b", "sizes")})
    assert got.columns == ["doc_id", "__row", "__keep0", "digest", *align._RESULTS]
    assert [(*r[4:], r.digest) for r in got.orderBy("doc_id").collect()] == expected(TEXTS)


def test_groups_are_lists_of_ids(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = align.align(spark, d, ["doc_id"]).orderBy("doc_id").collect()
    assert [[(list(x.a), list(x.b)) for x in r.groups] for r in got] == [[(list(a), list(b)) for a, b in g] for g in by_hand(TEXTS)]


def test_stretches_change_nothing():
    short, whole = align.Aligner(align.A_RANKS, align.A_FILE, align.B_FILE), align.Aligner(align.A_RANKS, align.A_FILE, align.B_FILE)
    short.stretch = 16
    assert short.align(TEXTS).equals(whole.align(TEXTS))


def test_wide_groups_and_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 9, (40, 2))
    a, b = (rng.integers(0, 5, n).astype(np.int32) for n in sizes.sum(0))
    columns = [align._packed(np.asarray(x), np.array([len(x)])) for x in (a, b, sizes.ravel())]
    plain = [x.tolist() for x in align.Groups(*columns).pairs()]
    monkeypatch.setattr(align, "WIDE", 12)
    monkeypatch.setattr(align, "BLOCK", 50)
    assert [x.tolist() for x in align.Groups(*columns).pairs()] == plain


def test_empty_table(spark):
    assert align.align(spark, spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0


def test_later_tasks_give_tokenizers_back():
    align._aligner(align.A_RANKS, align.A_FILE, align.B_FILE)
    align._without_tokenizers()
    assert align._aligner.cache_info().currsize == align._library.cache_info().currsize == 0
