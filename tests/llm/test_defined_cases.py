"""Cases that docstrings define: empty tables, nulls, repeated rows, very long texts and clashing names, for operators whose own
tests lack them."""

import hashlib

import pytest
from pyspark.sql import functions as F

from glyphflow.llm import decontam, exact_dedup, html, langid, quality, secrets

SCHEMA = "doc_id long, text string, lang string, source string, rid long, ids long, p_low double, kind string, lang_pred string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "h/p", 1, 2, 0.5, "k", "x") for i, t in texts], SCHEMA)


LONG = "the quick brown fox jumps over the lazy dog " * 20_000


def test_html_pages(spark):
    page = lambda n: "<html><body><nav><a>menu</a></nav><article>" + "".join(f"<p>words of line {k}</p>" for k in range(n)) + "</article><footer>end</footer></body></html>"
    rows = [(1, "u", page(3), "a", 1.0), (1, "u", page(3), "a", 1.0), (None, None, page(4), "b", 2.0), (3, "v", page(1500), "c", 3.0), (4, "w", None, "d", 4.0)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string, p double")
    model = html.train(d)
    got = html.extract(spark, d, model, ["page_id", "url", "p"])
    assert got.columns == ["page_id", "url", "p", "text"]
    found = got.orderBy("p", "text").collect()
    assert len(found) == 5 and found[0].text == found[1].text and found[-1].text == ""
    assert found[3].text.count("words of line") == 1500
    none = d.limit(0)
    assert html.extract(spark, none, html.train(none), ["page_id"]).count() == 0


def test_quality_of_repeats_and_long_texts(spark):
    spam = "SPAM!! BUY!! NOW!!" * 5
    d = docs(spark, [(i, spam if i % 4 == 0 else "plain words in a line of text") for i in range(40)] + [(1, "plain words in a line of text"), (None, None), (900, LONG)])
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(40)], "doc_id long, quality long, toxic long")
    got = quality.scores(spark, d, labels).collect()
    assert len(got) == 43 and len({r.rid for r in got}) == 43
    assert {(r.doc_id, r.keep) for r in got if r.doc_id is not None and r.doc_id < 40} == {(i, i % 4 != 0) for i in range(40)}


def test_site_posteriors_by_hand(spark):
    """p_site is recomputed from p_low: sums without the document's own, shrunk to the host, and the host to the corpus."""
    r = __import__("random").Random(3)
    rows = [(i, " ".join(r.choice(["plain", "words", "SPAM!!", "BUY!!", "line"]) for _ in range(12)), f"http://h{i % 3}/{'ab'[i % 2]}/x" if i % 5 else f"h{i % 3}") for i in range(60)]
    d = spark.createDataFrame([(i, t, "en", s, 0, 0, 0.0, "", "") for i, t, s in rows], SCHEMA)
    labels = spark.createDataFrame([(i, int("SPAM!!" not in t), 0) for i, t, _ in rows], "doc_id long, quality long, toxic long")
    got = {x.doc_id: x for x in quality.scores(spark, d, labels).collect()}
    low = {i: x.p_low for i, x in got.items()}
    site = {i: (x.host, x.path) for i, x in got.items()}
    mean = sum(low.values()) / len(low)

    def weight(groups):
        groups = [g for g in groups if g]
        n, s = sum(map(len, groups)), sum(sum(g) for g in groups)
        if not n or len(groups) < 2 or n <= len(groups):
            return 10.0
        m, b = s / n, sum(sum(g) ** 2 / len(g) for g in groups)
        within = max(1e-9, (sum(v * v for g in groups for v in g) - b) / (n - len(groups)))
        between = max(1e-6, (b - n * m * m - (len(groups) - 1) * within) / n)
        return min(1e4, max(1.0, within / between))

    members = lambda key: {k: [low[i] for i in site if key(i) == k] for k in {key(i) for i in site}}
    hosts, paths = members(lambda i: site[i][0]), members(lambda i: site[i])
    k_host, k_path = weight(hosts.values()), weight([v for (_, p), v in paths.items() if p])
    for i, x in got.items():
        h, p = hosts[x.host], paths[site[i]]
        host = (sum(h) - low[i] + k_host * mean) / (len(h) - 1 + k_host)
        want = host if x.path == "" else (sum(p) - low[i] + k_path * host) / (len(p) - 1 + k_path)
        assert x.p_site == pytest.approx(max(0.0, want), abs=1e-9)


def test_language_of_repeats_and_long_texts(spark):
    d = docs(spark, [(1, LONG), (1, LONG), (None, "the quick fox"), (3, None), (4, "12 !")])
    model = langid.train(d)
    got = langid.predict(spark, d, model, ["doc_id", "lang"]).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got) == [(0, "en"), (1, "en"), (1, "en"), (3, "und"), (4, "und")]


def test_secrets_of_repeats_nulls_and_empty_tables(spark):
    d = docs(spark, [(1, "token=abcdefghijklmnop"), (1, "token=abcdefghijklmnop"), (None, "AKIA" + "B" * 16), (4, "x " * 200_000 + "deadbeefdeadbeef"), (5, None)])
    got = secrets.findings(*secrets.scan(spark, d)).collect()
    assert sorted((r.doc_id or 0, [(s["kind"], s["start"]) for s in r.spans]) for r in got) == [(0, [("access", 0)]), (1, [("assign", 0)]), (1, [("assign", 0)]), (4, [("hex", 400_000)]), (5, [])]
    assert secrets.findings(*secrets.scan(spark, d.limit(0))).count() == 0


def test_contamination_of_long_texts(spark):
    item = " ".join(f"w{i}" for i in range(40))
    d = docs(spark, [(1, LONG + item), (2, LONG), (2, LONG), (None, item), (5, "")])
    b = spark.createDataFrame([(7, item, "t"), (7, item, "t"), (None, "", "t")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, len(r["items"]) > 0) for r in decontam.matches(spark, d, b).collect()}
    assert got == {(1, True), (2, False), (None, True), (5, False)}
    kept = decontam.clean(spark, d, b)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [2, 2, 5]


def test_exact_copies_of_long_texts(spark):
    d = docs(spark, [(9, LONG), (3, LONG.replace(" ", "\n")), (4, LONG + "x"), (None, None), (None, ""), (7, "")])
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.groups(spark, d).collect()}
    assert got == {(9, 3, 2), (3, 3, 2), (4, 4, 1), (None, 7, 3), (7, 7, 3)}
    sha = {r.doc_id: r.text_sha256 for r in exact_dedup.groups(spark, d.where(F.col("doc_id") == 4)).collect()}
    assert sha == {4: hashlib.sha256((LONG + "x").encode()).hexdigest()}
    assert sorted(r.doc_id for r in exact_dedup.dedup(spark, d).collect()) == [3, 4, 7]
