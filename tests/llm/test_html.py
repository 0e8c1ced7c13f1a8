"""The block labeller against the article text of the given pages, and its defined cases."""

import html as H
import re

import numpy as np

from glyphflow.llm import html


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    model = html.train(pages)
    got = {r.page_id: r.text for r in html.extract(spark, pages, model, ["page_id"]).collect()}
    for r in pages.collect():
        body = re.sub(r"<(?!/?b>)[^>]*>", " ", re.search(r"<article>(.*?)</article>", r.html, re.S)[1]).replace("<b>", "").replace("</b>", "")
        assert got[r.page_id] == " ".join(H.unescape(body).split())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "<script>x</script>")], "page_id long, html string")
    assert {r.text for r in html.extract(spark, odd, model, ["page_id"]).collect()} == {""}


def test_sample_is_by_id_then_digest(spark):
    rows = [(i % 40 if i % 9 else None, f"<p>page {i % 55}</p>") for i in range(300)] + [(3, None)]
    d = spark.createDataFrame(rows, "page_id long, html string")
    got = html.sample(d.repartition(7), most=16)
    ids = [r.page_id for r in d.selectExpr("page_id", "xxhash64(page_id) h").distinct().orderBy("h", "page_id").limit(16).collect()]
    assert 10 < len(got) == len(set(got)) <= 16 and set(got) <= {h for i, h in rows if i in ids}
    assert html.sample(d.where("page_id = 1"), most=16) and html.sample(d.limit(0)) == []


def test_implied_ends():
    texts = lambda page: [(t, sorted(p)) for t, p, _ in html.blocks(page)]
    flat = texts("<ul><li>a<li>b<li>c</ul><table><tr><td>d<td>e<tr><td>f</table><dl><dt>g<dd>h<dt>i</dl><p>j<p>k")
    assert flat == texts("<ul><li>a</li><li>b</li><li>c</li></ul><table><tr><td>d</td><td>e</td></tr><tr><td>f</td></tr></table><dl><dt>g</dt><dd>h</dd><dt>i</dt></dl><p>j</p><p>k</p>")
    inner = texts("<ul><li>a<ul><li>b</ul><li>c</ul>")
    assert [t for t, _ in inner] == ["a", "b", "c"] and inner[0] == ("a", inner[2][1])


def test_hostile_page_is_linear():
    import time

    took = []
    for n in (4_000, 16_000):
        start = time.process_time()
        assert len(html.blocks("<div>x</span></b>" * n)) == n and len(html.blocks("<li>y" * n)) == n
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0] + 0.5


def test_pages_side_by_side(spark, monkeypatch):
    """Pages read side by side get the probabilities that each gets alone, whatever their lengths."""
    pages = [html.blocks("".join(f"<p class='c{k % 5}'>word{k % 7} {'text ' * (k % 4)}</p>" for k in range(n))) for n in (3, 0, 1, 40, 3, 0, 17, 2)]
    model = html.Labeller()
    alone = [model.probabilities(html.vectors(b)) for b in pages]
    for together in (1, 20, 8_192):
        monkeypatch.setattr(html, "TOGETHER", together)
        got = model.probabilities_of(pages)
        assert [len(p) for p in got] == [len(b) for b in pages]
        assert all(np.allclose(x, y, rtol=0, atol=1e-12) for x, y in zip(alone, got))
    assert model.probabilities_of([]) == []
