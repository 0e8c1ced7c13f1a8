"""Training reads the sampled pages whole."""

from glyphflow.llm import html


def test_late_blocks_are_taught(spark, monkeypatch):
    page = "<html><body><article>" + "".join(f"<p>line {i}</p>" for i in range(600)) + "</article><footer><p>late words</p></footer></body></html>"
    seen = []
    monkeypatch.setattr(html.Labeller, "fit", lambda self, pages: seen.extend(pages) or self)
    html.train(spark.createDataFrame([(1, page)], "page_id long, html string"))
    (x, y), = seen
    assert len(x) == len(y) == 601
    assert y[0] != y[-1]
