"""URL rules against regular expressions, one rule at a time."""

import random
import re

import duckdb

from glyphflow.llm import urls

URLS = [None, "", "no scheme", "https://", "http://COM/", "http://com", "https://example.com/en/x?y=/de/#z", "https://www.Example.com/en/", "https://a.www.example.com/en/a/b", "https://notexample.com/en/", "https://example.com/EN/", "https://example.com:80/en/", "ftp://u@x.net/es/", "https://net/fr/1#t", "https://x.net/fr", "https://x.net/frx/", "http://x.org/com/a", "http://y.org/a.com/en/b.gif", "http://y.org/a.gif?x", "http://y.edu/login.png", "http://casinoé.org/ü/x", "a://b://c.net/es/", "https://x.net?/es/", "https://x.net#/es/", "http://z.org/1/2/3/4/5/6/7/8", "http://z.org/" + "a/" * 4000 + "x.pdf", "http://z.org/a\nb/cart/1"]


def by_hand(url):
    found = re.search("://([^/?#]*)([^?#]*)", url or "")
    host, path = (found[1], found[2]) if found else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for site, verdict in urls.SITES:
        of, at = site.split("/", 1)
        if (host == of or host.endswith("." + of)) and path.startswith("/" + at):
            fits.append((len(site), site, verdict))
    if fits:
        return (host, path, max(fits)[1], None, max(fits)[2])
    fits = [(-len(g), v != "block", g, v) for g, v in urls.GLOBS if re.fullmatch(urls._pattern(g)[1:-1], f".{host}{path}")]
    return (host, path, None, min(fits)[2], min(fits)[3]) if fits else (host, path, None, None, urls.DEFAULT)


def test_judge(spark):
    d = spark.createDataFrame([(i, u, "other", "kept") for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, host string, __host string")
    got = urls.judge(spark, d, ["page_id", "host", "__host"])
    assert got.columns == ["page_id", "__host", "host", "path", "rule", "glob", "verdict"]
    assert [tuple(r)[2:] for r in got.orderBy("page_id").collect()] == [by_hand(u) for u in [*URLS, *URLS]]
    assert urls.judge(spark, d.limit(0), ["page_id"]).count() == 0
    assert {r.verdict for r in urls.judge(spark, d, ["page_id"], sites=(), globs=(), default="block").collect()} == {"block"}


def test_sql():
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", list(enumerate(URLS)))
    got = con.execute(f"select * from ({urls.SQL}) order by page_id").fetchall()
    assert [r[1:] for r in got] == [by_hand(u) for u in URLS]


def test_automaton_against_patterns(monkeypatch):
    r = random.Random(2)
    monkeypatch.setattr(urls, "CELLS", 40)
    globs = ["".join(r.choice(["a", "b", "/", "*", "**", "é"]) for _ in range(r.randint(0, 9))) for _ in range(60)]
    texts = ["".join(r.choice("ab/é") for _ in range(r.randint(0, 12))) for _ in range(300)]
    want = [next((k for k, g in enumerate(globs) if re.fullmatch(urls._pattern(g)[1:-1], t)), len(globs)) for t in texts]
    assert urls.Automaton(globs).words > 2
    assert urls.Automaton(globs).first([t.encode() for t in texts]).tolist() == want
