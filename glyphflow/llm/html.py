"""Main text of web pages by a recurrent block labeller.

A page becomes a sequence of blocks (texts between block-level tags). Each block is two hashed vectors: its tag path (tags and
the words of class, id and role) and its words. A bidirectional LSTM in numpy reads the whole sequence and labels every
block, so each decision sees the whole page. It is trained here on a bounded sample (SAMPLE pages with the smallest hash
of their id, each whole); the labels of the training blocks come from the tags and class words below, which are not consulted when a page
is read. Script, style and markup are never text.

Defined cases: null or empty html gives the empty text; repeated rows each get theirs; a page without blocks gives the empty
text; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from html.parser import HTMLParser
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

SAMPLE, PATHS, WORDS, HIDDEN, EPOCHS = 64, 96, 32, 16, 12
#: Pages that a worker holds as blocks; blocks that are read side by side, those of one page at least.
SLICE, TOGETHER = 256, 8_192
# Tags that never hold text, tags inside a line, void tags, and what marks training blocks as boilerplate.
SILENT = {"script", "style", "noscript", "template", "title", "svg", "select", "textarea", "iframe"}
INLINE = set("a abbr b bdi bdo cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
OUTSIDE = set("nav header footer aside form button menu dialog label fieldset".split())
# Tags that end where one of these begins, and the tags beyond which that does not reach.
ENDED = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "option": ("option",)}
FENCES = set("ul ol dl table div section article body".split())
MARKS = set("ad ads advert advertisement sponsor sponsored promo banner sidebar comment comments reply replies menu nav navigation navbar breadcrumb breadcrumbs header footer notice cookie cookies consent related share social newsletter subscribe popup modal login search widget".split())
_SPLIT, _SPACE = re.compile(r"[^a-z0-9]+"), re.compile(r"\s+")


@lru_cache(1 << 12)
def _cell(word: str) -> int:
    return zlib.crc32(word.encode()) % PATHS


@lru_cache(1 << 15)
def _word_cell(word: str) -> int:
    return PATHS + zlib.crc32(word.lower().encode()) % WORDS


class Blocks(HTMLParser):
    """Blocks of a page with their paths. The path is kept as counts of the cells that the words of all open tags take, so that a block
    costs the same however deep it lies."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, list[int], bool]] = []
        self.open: dict[str, int] = {}
        self.path: dict[int, int] = {}
        self.outside, self.text, self.out, self.mute = 0, [], [], 0

    def _end_block(self):
        if not self.text:
            return
        t = _SPACE.sub(" ", "".join(self.text)).strip()
        if t:
            self.out.append((t, tuple(self.path), not self.outside))
        self.text = []

    def _pop(self):
        tag, cells, marked = self.stack.pop()
        self.open[tag] -= 1
        for c in cells:
            if self.path[c] == 1:
                del self.path[c]
            else:
                self.path[c] -= 1
        self.outside -= marked
        self.mute -= tag in SILENT

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self._end_block()
        if tag in VOID:
            return
        for other in ENDED.get(tag, ()):
            if self.open.get(other):
                self._close(other, within={tag, *ENDED[tag]})
        named = [w for k, v in attrs if k in ("class", "id", "role") and v for w in _SPLIT.split(v.lower()) if w]
        cells = [_cell("<" + tag), *(_cell("." + w) for w in named)]
        marked = tag in OUTSIDE or not MARKS.isdisjoint(named)
        self.stack.append((tag, cells, marked))
        self.open[tag] = self.open.get(tag, 0) + 1
        for c in cells:
            self.path[c] = self.path.get(c, 0) + 1
        self.outside += marked
        self.mute += tag in SILENT

    def _close(self, tag, within=None):
        """Ends the innermost ``tag`` and what is open in it; with ``within``, only if nothing but these and inline tags lies between."""
        if not self.open.get(tag):
            return
        at = len(self.stack) - 1
        while self.stack[at][0] != tag:
            if within and self.stack[at][0] not in INLINE | within and (tag == "p" or self.stack[at][0] in FENCES):
                return
            at -= 1
        while len(self.stack) > at:
            self._pop()

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self._end_block()
        self._close(tag)

    def handle_data(self, data):
        if not self.mute:
            self.text.append(data)


def blocks(page: str | None) -> list[tuple[str, tuple[int, ...], bool]]:
    """Text, path (which cells its hashed words take) and training label (whether no open tag marks it as boilerplate) of every
    block, in page order."""
    p = Blocks()
    p.feed(page or "")
    p.close()
    p._end_block()
    return p.out


def vectors(page: list[tuple[str, tuple[int, ...], bool]]) -> np.ndarray:
    width = PATHS + WORDS
    words = [text.split() for text, *_ in page]
    many = np.array([len(w) for w in words], np.int64)
    cells = np.fromiter(map(_word_cell, chain.from_iterable(words)), np.int64, int(many.sum()))
    at = np.repeat(np.arange(len(page)) * width, many) + cells
    out = np.bincount(at, np.repeat(1 / np.maximum(many, 1), many), len(page) * width).reshape(len(page), width)
    paths = [path for _, path, _ in page]
    rows = np.repeat(np.arange(len(page)), [len(x) for x in paths])
    out[rows, np.fromiter(chain.from_iterable(paths), np.int64, len(rows))] = 1
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    def __init__(self, seed: int = 11):
        r, h, d = np.random.default_rng(seed), HIDDEN, PATHS + WORDS
        self.p = {}
        for s in "fb":
            self.p["x" + s], self.p["h" + s], self.p["c" + s] = r.normal(0, 0.15, (d, 4 * h)), r.normal(0, 0.15, (h, 4 * h)), np.zeros(4 * h)
        self.p["o"], self.p["z"] = r.normal(0, 0.2, 2 * h), np.zeros(1)

    def _run(self, x, s):
        n, k, h = len(x), HIDDEN, np.zeros(HIDDEN)
        c, gates, cells, hs = np.zeros(k), np.zeros((n, 4 * k)), np.zeros((n + 1, k)), np.zeros((n + 1, k))
        pre, wh = x @ self.p["x" + s] + self.p["c" + s], self.p["h" + s]
        for t in range(n):
            a = pre[t] + h @ wh
            g = gates[t]
            g[: 3 * k], g[3 * k :] = _sigmoid(a[: 3 * k]), np.tanh(a[3 * k :])
            c = g[k : 2 * k] * c + g[:k] * g[3 * k :]
            h = g[2 * k : 3 * k] * np.tanh(c)
            cells[t + 1], hs[t + 1] = c, h
        return gates, cells, hs

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return _sigmoid(np.hstack([self._run(x, "f")[2][1:], self._run(x[::-1], "b")[2][:0:-1]]) @ self.p["o"] + self.p["z"])

    def _read(self, pre: np.ndarray, s: str, first: np.ndarray, step: int, n: np.ndarray) -> np.ndarray:
        """The hidden states of many pages at once. ``first``: row of ``pre`` where a page begins, ``n``: its blocks, most first."""
        k, wh, hs = HIDDEN, self.p["h" + s], np.zeros((len(pre), HIDDEN))
        h, c = np.zeros((len(n), k)), np.zeros((len(n), k))
        for t, live in enumerate(np.searchsorted(-n, -np.arange(n[0]) if len(n) else []).tolist()):
            rows = first[:live] + step * t
            a = pre[rows] + h[:live] @ wh
            g, top = _sigmoid(a[:, : 3 * k]), np.tanh(a[:, 3 * k :])
            c = g[:, k : 2 * k] * c[:live] + g[:, :k] * top
            h = g[:, 2 * k :] * np.tanh(c)
            hs[rows] = h
        return hs

    def probabilities_of(self, pages: list[list[tuple[str, tuple[int, ...], bool]]]) -> list[np.ndarray]:
        """``probabilities`` of the blocks of every page, pages of about TOGETHER blocks read side by side."""
        out, at = [], 0
        while at < len(pages):
            stop, held = at, 0
            while stop < len(pages) and (stop == at or held + len(pages[stop]) <= TOGETHER):
                held += len(pages[stop])
                stop += 1
            part = pages[at:stop]
            n = np.array([len(b) for b in part], np.int64)
            ends, order = np.cumsum(n), np.argsort(-n, kind="stable")
            x = vectors(list(chain.from_iterable(part)))
            first = {"f": ((ends - n)[order], 1), "b": ((ends - 1)[order], -1)}
            hidden = [self._read(x @ self.p["x" + s] + self.p["c" + s], s, *first[s], n[order]) for s in "fb"]
            p = _sigmoid(np.hstack(hidden) @ self.p["o"] + self.p["z"])
            out += np.split(p, ends[:-1])
            at = stop
        return out

    def _back(self, x, s, run, dh_out, grad):
        (gates, cells, hs), k = run, HIDDEN
        da, dh, dc = np.zeros_like(gates), np.zeros(k), np.zeros(k)
        for t in range(len(x) - 1, -1, -1):
            i, f, o, g = np.split(gates[t], 4)
            dh = dh + dh_out[t]
            th = np.tanh(cells[t + 1])
            dc = dc + dh * o * (1 - th**2)
            da[t] = np.concatenate([dc * g * i * (1 - i), dc * cells[t] * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g**2)])
            dc, dh = dc * f, self.p["h" + s] @ da[t]
        grad["x" + s], grad["h" + s], grad["c" + s] = x.T @ da, hs[:-1].T @ da, da.sum(0)

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], rate: float = 0.02) -> "Labeller":
        m, v, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for _ in range(EPOCHS):
            for x, y in pages:
                f, b = self._run(x, "f"), self._run(x[::-1], "b")
                hid = np.hstack([f[2][1:], b[2][:0:-1]])
                d = (_sigmoid(hid @ self.p["o"] + self.p["z"]) - y) / len(y)
                grad = {"o": hid.T @ d, "z": np.array([d.sum()])}
                dh = np.outer(d, self.p["o"])
                self._back(x, "f", f, dh[:, :HIDDEN], grad)
                self._back(x[::-1], "b", b, dh[::-1, HIDDEN:], grad)
                step += 1
                for k, g in grad.items():
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def sample(pages: DataFrame, key: str = "page_id", html: str = "html", most: int = SAMPLE) -> list[str]:
    """The html of the ``most`` pages whose ids have the smallest hashes (ties: by id, then by digest of the html), each different
    page once. Ids are chosen first, then digests; only what is chosen comes to the driver, whatever the number of tasks."""
    given = pages.where(F.col(html).isNotNull()).select(F.col(key).alias("key"), F.col(html).alias("html"))
    order = [F.xxhash64("key").alias("hash"), F.col("key")]
    ids = [r["key"] for r in given.select(*order).distinct().orderBy("hash", "key").limit(most).collect()]
    named = given.where(F.col("key").isin([i for i in ids if i is not None]) | (F.col("key").isNull() if None in ids else F.lit(False)))
    dated = named.select(*order, F.sha2("html", 256).alias("sha"))
    chosen = [r["sha"] for r in dated.distinct().orderBy("hash", "key", "sha").limit(most).collect()]
    found = named.withColumn("sha", F.sha2("html", 256)).where(F.col("sha").isin(chosen)).groupBy("sha").agg(F.min("html").alias("html"))
    by = {r["sha"]: r["html"] for r in found.collect()}
    return [by[c] for c in dict.fromkeys(chosen)]


def train(pages: DataFrame, key: str = "page_id", html: str = "html") -> Labeller:
    got = [blocks(x) for x in sample(pages, key, html)]
    return Labeller().fit([(vectors(b), np.array([float(own) for *_, own in b])) for b in got if b])


def extract(spark: SparkSession, pages: DataFrame, model: Labeller, keep: list[str], html: str = "html") -> DataFrame:
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def of(page: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(page), SLICE):
            read = [blocks(x) for x in page.iloc[at : at + SLICE]]
            out += [" ".join(t for (t, *_), own in zip(b, (p > 0.5).tolist()) if own) for b, p in zip(read, shared.value.probabilities_of(read))]
        return pd.Series(out, dtype=object)

    return pages.select(*keep, of(F.col(html)).alias("text"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(spark, pages, train(pages), ["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))
