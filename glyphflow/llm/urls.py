"""URL filters by a bit-parallel wildcard automaton.

Every rule is a glob over a canonical URL, `.host/path`: `*` is any run without a slash, `**` any run at all. All globs are laid
side by side in the bits of a few 64-bit words, a bit for each number of symbols read, and run at once (Shift-And): a byte
moves the bits of the states that expect it by one, across words, and the states before a wildcard stay. Rows of a batch go
through the bytes together, longest first, so a step is a few numpy operations whatever the number of rules and rows.

A site rule (`example.com/en/`) fits its host and all hosts below it, if the path starts as the rule's does. Of the site rules
that fit, the longest decides; where none fits, the longest fitting glob of GLOBS; where none fits either, DEFAULT. Ties: block
before allow, then by text.

Defined cases: the host is what follows the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased (a port or a user stays
part of it); the path goes on up to `?`, `#` or the end; null and urls without `://` have both empty and are judged as such;
repeated rows each get theirs; very long urls are read whole (a step a byte); an empty table gives an empty table; further
columns pass through, those named like a result give way to it.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

#: Rows times words that are held at once.
CELLS = 1 << 16
DEFAULT = "allow"
# The site rules.
SITES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
# What urls without a site rule are judged by: kinds of host, kinds of page and kinds of file.
GLOBS = (
    ("*.ads.*/**", "block"), ("*.doubleclick.*/**", "block"), ("*-bets.*/**", "block"), ("*casino*/**", "block"), ("*.edu/**", "allow"), ("*.gov/**", "allow"),
    ("**/admin/**", "block"), ("**/cart/**", "block"), ("**/checkout/**", "block"), ("**/login**", "block"), ("**/search/**", "block"), ("**/tag/*", "block"), ("*/wp-content/**", "block"),
    ("**.css", "block"), ("**.gif", "block"), ("**.jpg", "block"), ("**.js", "block"), ("**.mp4", "block"), ("**.pdf", "block"), ("**.png", "block"), ("**.zip", "block"),
    ("*/*/*/*/*/*/*/*/**", "block"),
)
_RESULTS = ("host", "path", "rule", "glob", "verdict")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    glob: str
    verdict: str
    site: str | None = None


def ordered(sites=SITES, globs=GLOBS) -> list[Rule]:
    """All rules, the one that wins first."""
    rules = [Rule(f"*.{s}**", v, s) for s, v in sites] + [Rule(g, v) for g, v in globs]
    return sorted(rules, key=lambda r: (r.site is None, -len(r.site or r.glob), r.verdict != "block", r.site or r.glob))


class Automaton:
    """All globs at once."""

    def __init__(self, globs: list[str]):
        symbols = [[s.encode() if s[0] != "*" else s for s in re.findall(r"\*\*|\*|[^*]", g)] for g in globs]
        sizes = [1 + sum(len(s) for s in g if isinstance(s, bytes)) for g in symbols]
        self.words, self.last, at = -(-sum(sizes) // 64), [], 0
        reads, stays, start = (np.zeros(shape, bool) for shape in ((256, self.words * 64), (256, self.words * 64), self.words * 64))
        every = np.ones(256, bool)
        for g in symbols:
            start[at] = True
            for s in g:
                if isinstance(s, bytes):
                    for c in s:
                        at += 1
                        reads[c, at] = True
                else:
                    stays[:, at] |= every if s == "**" else every & (np.arange(256) != ord("/"))
            self.last.append(at)
            at += 1
        self.reads, self.stays, self.start = (np.packbits(x, axis=-1, bitorder="little").view(np.uint64) for x in (reads, stays, start))

    def fits(self, urls: list[bytes]) -> np.ndarray:
        """By url and glob: whether the glob fits the whole url. ``urls``: longest first."""
        size = np.array([len(u) for u in urls])
        data, at = np.frombuffer(b"".join(urls), np.uint8), np.cumsum(size) - size
        state = np.tile(self.start, (len(urls), 1))
        for step in range(int(size.max(initial=0))):
            k = int(np.searchsorted(-size, -step))  # urls longer than this
            byte, old = data[at[:k] + step], state[:k]
            moved = old << np.uint64(1)
            moved[:, 1:] |= old[:, :-1] >> np.uint64(63)
            state[:k] = (moved & self.reads[byte]) | (old & self.stays[byte])
        last = np.array(self.last, np.int64)
        return (state[:, last >> 6] >> (last & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def first(self, urls: list[bytes]) -> np.ndarray:
        """Number of the first glob that fits each url, or how many globs there are."""
        out, order = np.full(len(urls), len(self.last)), np.argsort([-len(u) for u in urls], kind="stable")
        rows = max(1, CELLS // max(1, self.words))
        for i in range(0, len(urls) if self.last else 0, rows):
            part = order[i : i + rows]
            fit = self.fits([urls[j] for j in part])
            out[part] = np.where(fit.any(1), fit.argmax(1), len(self.last))
        return out


def judge(spark: SparkSession, pages: DataFrame, keep: list[str], url: str = "url", sites=SITES, globs=GLOBS, default: str = DEFAULT) -> DataFrame:
    """``keep`` and host, path, rule (site rule that decides, or null), glob (glob that decides, or null), verdict of every row."""
    rules = ordered(sites, globs)
    automaton = Automaton([r.glob for r in rules])
    said = pa.StructArray.from_arrays([pa.array([*column, None], pa.string()) for column in ([r.site for r in rules], [r.glob if r.site is None else None for r in rules])] + [pa.array([*(r.verdict for r in rules), default])], ["rule", "glob", "verdict"])

    @F.arrow_udf("rule string, glob string, verdict string")
    def of(canonical: pa.Array) -> pa.Array:
        return said.take(pa.array(automaton.first([u.encode() for u in canonical.to_pylist()])))

    part = lambda k: F.coalesce(F.regexp_extract(F.col(url).cast("string"), r"://([^/?#]*)([^?#]*)", k), F.lit(""))
    host, path = F.translate(part(1), _UPPER, _LOWER), part(2)
    kept = [F.col(c).alias(f"__keep{k}") for k, c in enumerate(keep)]
    rows = pages.select(*kept, host.alias("__host"), path.alias("__path")).withColumn("__said", of(F.concat(F.lit("."), "__host", "__path")))
    shown = [F.col(f"__keep{k}").alias(c) for k, c in enumerate(keep) if c not in _RESULTS]
    return rows.select(*shown, F.col("__host").alias("host"), F.col("__path").alias("path"), *[F.col(f"__said.{c}").alias(c) for c in _RESULTS[2:]])


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, table(spark, sf_dir, "pages"), ["page_id"])


def _pattern(glob: str) -> str:
    return "^" + "".join({"**": "(?s:.*)", "*": "[^/]*"}.get(s, re.escape(s)) for s in re.findall(r"\*\*|\*|[^*]", glob)) + "$"


def _case(column: str) -> str:
    value = lambda x: "NULL" if x is None else f"'{x}'"
    said = {"rule": lambda r: r.site, "glob": lambda r: None if r.site else r.glob, "verdict": lambda r: r.verdict}[column]
    whens = " ".join(f"WHEN regexp_matches('.' || host || path, '{_pattern(r.glob)}') THEN {value(said(r))}" for r in ordered())
    return f"CASE {whens} ELSE {value(DEFAULT if column == 'verdict' else None)} END AS {column}"


SQL = f"""
WITH cut AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, host, path, {_case("rule")}, {_case("glob")}, {_case("verdict")} FROM cut
"""
