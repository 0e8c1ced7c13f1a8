"""Cross-tokenizer alignment by per-byte label strings.

Tokenizer A (byte-level BPE) and B (a SentencePiece model) read one space and the text. Every byte of it has a label: none,
end of an A token, end of a B token, both. A regex scan cuts the label string into spans up to each "both"; how many A and B
labels a span holds says how many tokens of each its group has. Tokens of one group are linked, all with all.

A runs from its rank file. B's scores are merge ranks in the installed model, so the same merge engine runs it: characters are
put together first, then pieces by rank, and what is no piece becomes byte tokens (test: the library's ids); texts with runs of
characters whose pieces are tied, and models with other scores, are run by the library. Very long texts are encoded a stretch
at a time, cut where neither can have a token across.

Links are counted over the whole corpus: tasks count the documents of each id pair they see and Spark adds up. To bring the
counts back, the pairs in most documents (HOT at most, the proven bound of what is broadcast) are looked up where the
tokens are; every other pair of a document is a row and joins the counts. Which pairs are hot changes no result.

Defined cases: null or empty texts, and texts whose joined token bytes differ from space and text (such as those with the
mark "▁" of B), have no tokens, no groups and no links; the strings of special tokens are plain text; repeated rows each get
theirs and count as documents of their own; ties for the highest count of an A id are all best; very long texts are read
whole; an empty table gives an empty table; further columns pass through, those named like a result give way to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sentencepiece
from ._common import Scratch, table

A_RANKS, A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: what splits a text before A's merges, as its vocabulary file says.
A_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Most pairs that are broadcast; characters encoded at once; bytes or links that numpy holds at once.
HOT, STRETCH, BLOCK = 1 << 20, 1 << 18, 1 << 19
#: A group of more links than this is counted by its distinct ids.
WIDE = 1 << 12
#: Ids are under 2**20; a pair of ids is one long.
_BITS = 20
_RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPAN, _BLANK, _BORDER = re.compile(rb"[^\x03]*\x03"), re.compile(f"[{_WHITE}]{{4096}}"), re.compile(f"(?<=[^{_WHITE}])(?= )")
_GROUPS = T.ArrayType(T.StructType([T.StructField(c, T.ArrayType(T.IntegerType())) for c in "ab"]))
_ZSTD = {"spark__sql__parquet__compression__codec": "zstd", "spark__sql__execution__arrow__maxRecordsPerBatch": "500"}


class _Sizes(dict):
    """Numbers of A and B tokens of a span of labels, packed; short spans are remembered."""

    def __missing__(self, span: bytes) -> bytes:
        both = span.count(3)
        got = np.array([span.count(1) + both, span.count(2) + both], np.int32).tobytes()
        if len(span) <= 24:
            if len(self) >= 1 << 16:
                self.clear()
            self[span] = got
        return got


class ByRanks:
    """Byte-level BPE by ranks. Texts with very long blank runs, which its pattern cannot take, go to the library of ``plain``."""

    def __init__(self, ranks: str = A_RANKS, plain: str = A_FILE):
        import tiktoken

        known = {base64.b64decode(t): int(r) for t, r in map(bytes.split, open(ranks, "rb"))}
        self.run = tiktoken.Encoding("a", pat_str=A_PATTERN, mergeable_ranks=known, special_tokens={})._core_bpe.encode_ordinary
        self.bytes = [b""] * (max(known.values()) + 1)
        for t, r in known.items():
            self.bytes[r] = t
        self.plain = plain

    def ids(self, text: str) -> np.ndarray:
        if len(text) > 4096 and _BLANK.search(text):
            return np.array(_library(self.plain).encode(text, add_special_tokens=False).ids, np.int32)
        return np.array(self.run(text), np.int32)


@lru_cache(2)
def _library(file: str):
    from tokenizers import Tokenizer

    got = Tokenizer.from_file(file)
    got.encode_special_tokens = True
    return got


class ByPieces:
    """A SentencePiece model."""

    def __init__(self, model: str = B_FILE):
        rows = sentencepiece.pieces(model)
        self.bytes = [b""] * (1 + max(i for i, *_ in rows))
        for i, t, _, b in rows:
            self.bytes[i] = bytes([b]) if b >= 0 else t.encode()
        import sentencepiece as library

        whole = library.SentencePieceProcessor(model_file=model).encode
        merges = sorted((-s, i, t) for i, t, s, b in rows if b < 0 and len(t) > 1)
        times = Counter(s for s, *_ in merges)
        tied = {t for s, _, t in merges if times[s] > 1}
        if sentencepiece.rule_of(model) == "merges" and all(len(set(t)) == 1 for t in tied):
            # Pieces of equal rank compete only in runs of their character: those texts go to the library.
            run, runs = self._merger(rows, merges, sentencepiece.pattern(model)), re.compile("|".join(sorted(re.escape(3 * t[0]) for t in tied)) or "(?!)")
            self.ids = lambda text: np.array(whole(text[1:]), np.int32) if runs.search(text) else run(text)
        else:
            self.ids = lambda text: np.array(whole(text[1:]), np.int32)

    @staticmethod
    def _merger(rows, merges, pattern: str):
        import tiktoken

        byte, one = {b: i for i, _, _, b in rows if b >= 0}, {t: i for i, t, _, b in rows if b < 0 and len(t) == 1}
        ranks, ids = {}, []

        def add(token: bytes, to: list[int]) -> None:
            if token not in ranks:
                ranks[token] = len(ids)
                ids.append(to)

        for b in range(256):
            add(bytes([b]), [one[chr(b)] if b < 128 and chr(b) in one else byte[b]])
        for c, i in one.items():  # the bytes of a character come together before anything else does
            raw = c.encode()
            for k in range(2, len(raw) + 1):
                add(raw[:k], [i] if k == len(raw) else [byte[b] for b in raw[:k]])
        for _, i, t in merges:
            add(t.encode(), [i])
        run = tiktoken.Encoding("b", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        first = np.array([x[0] if len(x) == 1 else -1 for x in ids], np.int32)

        def of(text: str) -> np.ndarray:
            got = run(text)
            out = first[got]
            return out if out.min(initial=0) >= 0 else np.array(list(chain.from_iterable(map(ids.__getitem__, got))), np.int32)

        return of


class Aligner:
    """Encodes texts by both tokenizers, labels their bytes and scans the labels."""

    def __init__(self, a_ranks: str, a_file: str, b_file: str):
        self.a, self.b = ByRanks(a_ranks, a_file), ByPieces(b_file)
        self.sizes = _Sizes()
        # Neither tokenizer has a token across a border, unless a piece of B does.
        self.stretch = 1 << 62 if any(re.search(rb"[^ ] ", p) for p in self.b.bytes) else STRETCH
        self.spelt = [pa.array(x.bytes, pa.binary()) for x in (self.a, self.b)]
        self.lengths = [np.array(list(map(len, x.bytes)), np.int64) for x in (self.a, self.b)]

    def _encoded(self, text: str | None) -> list[np.ndarray]:
        if not text or "▁" in text:  # B reads the mark as a space, so its tokens do not spell such a text
            return [np.zeros(0, np.int32)] * 2
        text, at, parts = " " + text, 0, ([], [])
        while at < len(text):
            border = _BORDER.search(text, at + self.stretch) if len(text) - at > self.stretch else None
            stop = border.start() if border else len(text)
            for to, by in zip(parts, (self.a, self.b)):
                to.append(by.ids(text[at:stop]))
            at = stop
        ids = [np.concatenate(p) for p in parts]
        for k in (0, 1):
            spelt = self.spelt[k].take(pa.array(ids[k]))
            if spelt.buffers()[2].to_pybytes()[: int(self.lengths[k][ids[k]].sum())] != text.encode():
                return [np.zeros(0, np.int32)] * 2
        return ids

    def align(self, texts: list[str | None]) -> pa.StructArray:
        """a, b (ids) and sizes (numbers of A and B tokens of each group in turn) of every text, packed as 32-bit integers."""
        rows = [self._encoded(t) for t in texts]
        ids = [np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, np.int32) for k in (0, 1)]
        ends = [np.cumsum(self.lengths[k][ids[k]]) for k in (0, 1)]
        labels = np.zeros(int(ends[0][-1]) if len(ends[0]) else 0, np.uint8)
        for k in (0, 1):
            labels[ends[k] - 1] |= k + 1
        packed, sizes, at = labels.tobytes(), [], 0
        while at < len(packed):
            stop = packed.find(b"\x03", at + BLOCK) + 1 or len(packed)
            sizes.append(b"".join(map(self.sizes.__getitem__, _SPAN.findall(packed[at:stop]))))
            at = stop
        last = np.append(0, ends[0])[np.cumsum([len(r[0]) for r in rows], dtype=np.int64)]
        groups = np.append(0, np.cumsum(labels == 3))[last]
        return pa.StructArray.from_arrays([_packed(ids[0], np.cumsum([len(r[0]) for r in rows])), _packed(ids[1], np.cumsum([len(r[1]) for r in rows])), _packed(np.frombuffer(b"".join(sizes), np.int32), 2 * groups)], ["a", "b", "sizes"])


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of 32-bit integers; row k ends before value ``ends[k]``."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, 4 * ends).astype(np.int32).tobytes()), pa.py_buffer(values.astype(np.int32).tobytes())])


@lru_cache(1)
def _aligner(*files: str) -> Aligner:
    return Aligner(*files)


def _without_tokenizers() -> None:
    """Gives the tokenizers of a worker back, whose later tasks need them no more but would keep them."""
    _aligner.cache_clear()
    _library.cache_clear()
    sentencepiece.pieces.cache_clear()


def _ints(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All 32-bit integers of a binary column and how many every row has."""
    ends = np.frombuffer(packed.buffers()[1], np.int32, len(packed) + 1, 4 * packed.offset) if len(packed) else np.zeros(1, np.int32)
    data = np.frombuffer(packed.buffers()[2], np.uint8, ends[-1] - ends[0], ends[0]).view(np.int32) if ends[-1] > ends[0] else np.zeros(0, np.int32)
    return data, np.diff(ends) // 4


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; run k ends before value ``ends[k]``."""
    return np.diff(np.append(0, np.cumsum(values))[np.append(0, ends)])


class Groups:
    """The groups of a slice of rows as flat arrays."""

    def __init__(self, a: pa.Array, b: pa.Array, sizes: pa.Array):
        (self.a, self.n_a), (self.b, self.n_b), (flat, n) = _ints(a), _ints(b), _ints(sizes)
        self.n_groups, self.of_a, self.of_b = n // 2, flat[::2].astype(np.int64), flat[1::2].astype(np.int64)
        self.at_a, self.at_b = np.cumsum(self.of_a) - self.of_a, np.cumsum(self.of_b) - self.of_b
        self.row = np.repeat(np.arange(len(n)), self.n_groups)

    def n_links(self) -> np.ndarray:
        return _sums(self.of_a * self.of_b, np.cumsum(self.n_groups))

    def _linked(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys (row, A id, B id) of the links of groups ``g``, each once, and how often."""
        many = self.of_a[g] * self.of_b[g]
        k = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        g = np.repeat(g, many)
        i, j = self.at_a[g] + k // self.of_b[g], self.at_b[g] + k % self.of_b[g]
        return np.unique((self.row[g] << 2 * _BITS) | (self.a[i].astype(np.int64) << _BITS) | self.b[j], return_counts=True)

    def _wide(self, g: int) -> tuple[np.ndarray, np.ndarray]:
        """The same of one group of many links, by its distinct ids."""
        ids, of = np.unique(self.a[self.at_a[g] : self.at_a[g] + self.of_a[g]].astype(np.int64), return_counts=True)
        ids_b, of_b = np.unique(self.b[self.at_b[g] : self.at_b[g] + self.of_b[g]], return_counts=True)
        return ((self.row[g] << 2 * _BITS) | (ids[:, None] << _BITS) | ids_b).ravel(), np.outer(of, of_b).ravel()

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, pair and number of links of every id pair linked in a row, each once, by row."""
        many = self.of_a * self.of_b
        narrow = np.flatnonzero(many <= WIDE)
        cuts = np.flatnonzero(np.diff(np.cumsum(many[narrow]) // BLOCK)) + 1
        got = [self._linked(g) for g in np.split(narrow, cuts)] + [self._wide(g) for g in np.flatnonzero(many > WIDE)]
        keys, times = got[0]
        if len(got) > 1:
            keys, back = np.unique(np.concatenate([k for k, _ in got]), return_inverse=True)
            order = np.argsort(back, kind="stable")
            times = _sums(np.concatenate([t for _, t in got])[order], np.cumsum(np.bincount(back)))
        return keys >> 2 * _BITS, keys & ((1 << 2 * _BITS) - 1), times

    def written(self, spelling: pa.Array) -> tuple[bytes, np.ndarray]:
        """`a1,a2|b1;a3|b2,b3;` of all rows in a row, and where each row ends. ``spelling``: ``_spelling``."""
        group_a, group_b = np.repeat(np.arange(len(self.of_a)), self.of_a), np.repeat(np.arange(len(self.of_b)), self.of_b)
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[self.at_a + self.of_a - 1] = 1
        last_b[self.at_b + self.of_b - 1] = 1
        codes[np.arange(len(self.a)) + self.at_b[group_a]] = self.a * np.int64(4) + last_a
        codes[np.arange(len(self.b)) + (self.at_a + self.of_a)[group_b]] = self.b * np.int64(4) + 2 + last_b
        text = spelling.take(pa.array(codes))
        ends = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, 4 * text.offset) if len(text) else np.zeros(1, np.int32)
        return (text.buffers()[2].to_pybytes() if len(text) else b""), ends[np.cumsum(self.n_a + self.n_b)]


@lru_cache(2)
def _spelling(bits: int) -> pa.Array:
    """Ids of so many bits as decimals with what may follow: A inside and at the end of its part of a group, and B."""
    return pa.array([f"{i}{c}".encode() for i in range(1 << bits) for c in (",", "|", ",", ";")], pa.binary())


def _slices(*columns: pa.Array):
    """Slices of columns of BLOCK bytes together or of one row."""
    if not len(columns[0]):
        return
    sizes = sum(np.diff(np.frombuffer(c.buffers()[1], np.int32, len(c) + 1, 4 * c.offset)).astype(np.int64) for c in columns)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // BLOCK)) + 1).tolist(), len(sizes)]
    for at, stop in zip(cuts, cuts[1:]):
        yield [c.slice(at, stop - at) for c in columns]


def encode(spark: SparkSession, docs: DataFrame, keep: list[str], text: str = "text", files: tuple[str, str, str] = (A_RANKS, A_FILE, B_FILE), scratch: Scratch | None = None) -> DataFrame:
    """__keep0.. (the ``keep`` columns), __row, a, b, sizes (packed) of every row, as a table."""

    names = [f"__keep{k}" for k in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.monotonically_increasing_id().alias("__row"), F.col(text).cast("string").alias("__text"))

    def encoded(batches):
        for batch in batches:
            at = 0
            for (texts,) in _slices(batch.column("__text")):
                own = [c.slice(at, len(texts)) for c in batch.columns[:-1]]
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*own, *_aligner(*files).align(texts.to_pylist()).flatten()], [*names, "__row", *_PACKED])

    kind = T.StructType([*rows.schema.fields[:-1], *(T.StructField(c, T.BinaryType()) for c in _PACKED)])
    return (scratch or Scratch(spark)).keep(rows.mapInArrow(encoded, kind), **_ZSTD)


def links(encoded: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best (whether no pair of its A id is in more)."""

    def counted(batches):
        _without_tokenizers()
        held, size = [], 0

        def out():
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], ["pair", "n"])

        for batch in batches:
            for part in _slices(*batch.columns):
                held.append(Groups(*part).pairs()[1])
                size += len(held[-1])
                if size > 2 * BLOCK:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    n = encoded.select("a", "b", "sizes").mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    n = n.withColumn("a", F.shiftright("pair", _BITS))
    return n.join(n.groupBy("a").agg(F.max("n").alias("top")), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _hot(counts: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(least count, pairs, counts, whether best) of the hot pairs: as many counts, from the highest down, as ``most`` pairs have."""
    held, cut = 0, 1 << 62
    for r in counts.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).count().orderBy(F.desc("n")).toLocalIterator():
        held += r["count"]
        if held > most:
            break
        cut = r["n"]
    got = counts.where(F.col("n") >= cut).toArrow()
    pair, n, best = (got.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pair)
    return cut, pair[order].astype(np.int64), n[order].astype(np.int64), best[order].astype(bool)


def align(spark: SparkSession, docs: DataFrame, keep: list[str], text: str = "text", files: tuple[str, str, str] = (A_RANKS, A_FILE, B_FILE), hot: int = HOT, derived: dict[str, Column] | None = None) -> DataFrame:
    """``keep`` and, of every row: what is ``derived`` from a, b (ids) and sizes (numbers of A and B tokens of each group in turn),
    all packed as 32-bit integers (by default ``groups``, the groups themselves); n_a, n_b, n_groups, n_links, n_best (links whose count is the
    highest of their A id), count_sum (over links)."""
    scratch, derived = Scratch(spark), {"groups": groups("a", "b", "sizes")} if derived is None else derived
    encoded = encode(spark, docs, keep, text, files, scratch)
    counts = scratch.keep(links(encoded), **_ZSTD)
    cut, *known = _hot(counts, hot)
    shared = spark.sparkContext.broadcast(known)

    @F.arrow_udf("n_links long, n_best long, count_sum long, pair array<long>, times array<long>")
    def scored(a: pa.Array, b: pa.Array, sizes: pa.Array) -> pa.Array:
        _without_tokenizers()
        pairs, n, best = shared.value
        out = []
        for part in _slices(a, b, sizes):
            g = Groups(*part)
            row, pair, times = g.pairs()
            k = np.minimum(np.searchsorted(pairs, pair), max(0, len(pairs) - 1))
            met = pairs[k] == pair if len(pairs) else np.zeros(len(pair), bool)
            ends = np.searchsorted(row, np.arange(len(g.n_groups)), "right")
            own = [np.zeros(len(pair), np.int64) for _ in (best, n)]
            for x, of in zip(own, (best, n)):
                x[met] = of[k[met]] * times[met]
            left = pa.array(np.append(0, np.cumsum(_sums(~met, ends))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(left, pa.array(x[~met].astype(np.int64))) for x in (pair, times)]
            out.append(pa.StructArray.from_arrays([pa.array(g.n_links()), *(pa.array(_sums(x, ends)) for x in own), *lists], _SCORED))
        return pa.concat_arrays(out) if out else pa.array([], pa.struct([(c, pa.int64() if k < 3 else pa.list_(pa.int64())) for k, c in enumerate(_SCORED)]))

    # Packed columns are large: all that is wanted of them is made here, and only small rows join the counts of rare pairs.
    names, more = [f"__keep{k}" for k in range(len(keep))], [c.alias(f"__own{k}") for k, c in enumerate(derived.values())]
    sizes = [(F.octet_length(c) / size).cast("long").alias(n) for n, c, size in zip(_RESULTS, _PACKED, (4, 4, 8))]
    own = scratch.keep(encoded.select(*names, "__row", *sizes, *more, scored("a", "b", "sizes").alias("__s")), **_ZSTD)
    scratch.drop(encoded)
    rare = own.where(F.size("__s.pair") > 0).select("__row", F.explode(F.arrays_zip("__s.pair", "__s.times")).alias("x")).select("__row", "x.pair", "x.times")
    rare = rare.join(counts.where(F.col("n") < cut), "pair").groupBy("__row").agg(F.sum(F.col("n") * F.col("times")).alias("__sum"), F.sum(F.col("best").cast("long") * F.col("times")).alias("__best"))
    shown = [F.col(f"__keep{k}").alias(c) for k, c in enumerate(keep) if c not in (*derived, *_RESULTS)]
    sums = [(F.col(f"__s.{c}") + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("n_best", "__best"), ("count_sum", "__sum"))]
    return own.join(rare, "__row", "left").select(*shown, *[F.col(f"__own{k}").alias(c) for k, c in enumerate(derived)], "n_a", "n_b", "n_groups", "__s.n_links", *sums)


_PACKED = ("a", "b", "sizes")
_SCORED = ["n_links", "n_best", "count_sum", "pair", "times"]


@F.arrow_udf(_GROUPS)
def groups(a: pa.Array, b: pa.Array, sizes: pa.Array) -> pa.Array:
    """The groups of packed columns: the ids of A and of B in each, in order."""
    g = Groups(a, b, sizes)
    parts = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(of)).astype(np.int32)), pa.array(ids)) for ids, of in ((g.a, g.of_a), (g.b, g.of_b))]
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(g.n_groups)).astype(np.int32)), pa.StructArray.from_arrays(parts, ["a", "b"]))


@F.arrow_udf(T.StringType())
def groups_digest(a: pa.Array, b: pa.Array, sizes: pa.Array) -> pa.Array:
    """SHA-256 (lowercase hex) of the groups written as `a1,a2|b1;a3|b2,b3`; without tokens the empty text."""
    out = []
    for part in _slices(a, b, sizes):
        g = Groups(*part)
        text, ends = g.written(_spelling(max(16, int(max(g.a.max(initial=0), g.b.max(initial=0))).bit_length())))
        out += [hashlib.sha256(text[p : q - 1]).hexdigest() if q > p else "" for p, q in zip([0, *ends[:-1]], ends)]
    return pa.array(out, pa.string())


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark, table(spark, sf_dir, "documents"), ["doc_id"], derived={"groups_sha256": groups_digest("a", "b", "sizes")})
