"""Secret scan over an incremental blob ledger, in DataFrame functions only.

Each row of the input is a version of a path. Texts are content-addressed by SHA-256; the ledger holds, for every (blob,
rule, rule version) that was ever scanned, the spans found (none included). A run scans only pairs that the ledger
lacks, each blob once however many versions share it, and joins the findings of old and new pairs back to all paths.

Spans come from one ``regexp_replace`` per rule that puts markers around the matches; the pieces between markers give
the positions in code points. Characters of the text that equal a marker are exchanged first for one that no rule matches.

Defined cases: null text is the empty text (no spans); null doc_id keeps its row; repeated rows each get their row; an
empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, table


@dataclass(frozen=True)
class Rule:
    """``pattern`` has two groups, lead and body; a match counts if body (``whole``: lead and body) has ``least`` characters."""

    kind: str
    version: int
    pattern: str
    least: int
    whole: bool = False


def either(word: str) -> str:
    """A word whose ASCII letters match in either case (a case flag would also fold letters beyond ASCII in some engines)."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = f"""((?:{"|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))})["']?\\x20*[:=]\\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
#: The query replays the table as so many commits of a history; each finds the ledger that those before it left.
COMMITS = 2

# The three base rules, in the order in which spans at one start are listed.
RULES = (
    Rule("assign", 1, ASSIGN, 12),
    Rule("access", 1, r"(AKIA)([A-Z0-9]+)", 18, whole=True),
    Rule("hex", 1, r"()([0-9a-f]+)", 16, whole=True),
)

_SPAN = "array<struct<start:int,end:int>>"


def spans(text: Column, rule: Rule) -> Column:
    """All spans of a rule in a text: array of (start, end) in code points."""
    clean = F.translate(text, "\x01\x02\x03", "﷐﷐﷐")
    # Runs of a single class that are too short never hide a longer match, so the least length can go into the pattern.
    pattern = rule.pattern
    if rule.kind == "hex":
        pattern = r"()([0-9a-f]{%d,})" % rule.least
    elif rule.kind == "access":
        pattern = r"(AKIA)([A-Z0-9]{%d,})" % (rule.least - 4)
    parts = F.transform(F.split(F.regexp_replace(clean, pattern, "\x01$1\x02$2\x03"), "[\x01\x02\x03]", -1), F.length)
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.lit(0).alias("lead"), F.array().cast(_SPAN).alias("out"))

    def step(a, n):
        third, size = F.pmod(a["k"], F.lit(3)), (a["lead"] if rule.whole else F.lit(0)) + n
        found = F.array(F.struct((a["at"] - a["lead"]).alias("start"), (a["at"] + n).alias("end")))
        return F.struct((a["at"] + n).alias("at"), (a["k"] + 1).alias("k"), F.when(third == 1, n).otherwise(0).alias("lead"), F.when((third == 2) & (size >= rule.least), F.concat(a["out"], found)).otherwise(a["out"]).alias("out"))

    return F.when(F.size(parts) > 1, F.aggregate(parts, zero, step, lambda a: a["out"])).otherwise(F.array().cast(_SPAN))


def scan(spark: SparkSession, docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(versions, ledger): doc_id and blob of every row; the ledger after this run, one row for each blob, rule and version."""
    scratch = Scratch(spark)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = texts.withColumn("blob", F.unhex(F.sha2("text", 256)))
    versions = scratch.keep(texts.select("doc_id", "blob"))
    names = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    wanted = versions.groupBy("blob").agg(F.min("doc_id").alias("from_id"))
    if ledger is None:
        wanted = wanted.withColumn("todo", names)
    else:
        pairs = wanted.withColumn("pair", F.explode(names)).select("blob", "from_id", "pair.*")
        todo = pairs.join(ledger.select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti")
        wanted = todo.groupBy("blob").agg(F.min("from_id").alias("from_id"), F.collect_set(F.struct("kind", "version")).alias("todo"))
    wanted = wanted.withColumnRenamed("blob", "__blob")
    unseen = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("from_id")) & (F.col("blob") == F.col("__blob")))
    found = [F.when(F.array_contains("todo", F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans(F.col("text"), r).alias("spans"))) for r in rules]
    fresh = unseen.select("blob", F.explode(F.array_compact(F.array(*found))).alias("f")).select("blob", "f.*")
    fresh = scratch.keep(fresh.groupBy("blob", "kind", "version").agg(F.first("spans").alias("spans")))
    return versions, fresh if ledger is None else ledger.select(*fresh.columns).unionByName(fresh)


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and, of every version, an array of (start, kind number, end, kind) by start, then kind as in ``rules``."""
    order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(f"{r.kind}:{r.version}"), F.lit(k))])
    hits = ledger.where(F.size("spans") > 0).withColumn("no", order[F.concat_ws(":", "kind", "version")]).where("no is not null")
    hits = hits.select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("no").alias("no"), s["end"].alias("end"), F.col("kind").alias("kind"))).alias("spans"))
    # Written before it joins the versions, so that the versions of a blob met very often can be dealt to several tasks.
    hits = Scratch(hits.sparkSession).keep(hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")))
    return versions.join(hits, "blob", "left").select("doc_id", F.coalesce("spans", F.array().cast("array<struct<start:int,no:int,end:int,kind:string>>")).alias("spans"))


def history(spark: SparkSession, commits: list[DataFrame], rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(versions, ledger) after all ``commits`` in order; a blob that an earlier commit brought is not scanned again."""
    versions, ledger = None, None
    for c in commits:
        new, ledger = scan(spark, c, ledger, rules, doc_id, text)
        versions = new if versions is None else versions.unionByName(new)
    return versions, ledger


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = F.coalesce(F.pmod(F.col("doc_id"), F.lit(COMMITS)), F.lit(0))
    found = findings(*history(spark, [docs.where(part == k) for k in range(COMMITS)]))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


SQL = r"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), chr(1) || chr(2) || chr(3), chr(64976) || chr(64976) || chr(64976)) AS x FROM documents),
r AS (
  SELECT doc_id, 'assign' AS kind, 0 AS no, 12 AS least, 0 AS whole,
         regexp_replace(x, '@ASSIGN@', chr(1) || '\1' || chr(2) || '\2' || chr(3), 'g') AS m FROM t
  UNION ALL SELECT doc_id, 'access', 1, 18, 1, regexp_replace(x, '(AKIA)([A-Z0-9]+)', chr(1) || '\1' || chr(2) || '\2' || chr(3), 'g') FROM t
  UNION ALL SELECT doc_id, 'hex', 2, 16, 1, regexp_replace(x, '()([0-9a-f]+)', chr(1) || '\1' || chr(2) || '\2' || chr(3), 'g') FROM t),
p AS (SELECT doc_id, kind, no, least, whole, unnest(list_transform(string_split_regex(m, '[\x01\x02\x03]'), lambda s: length(s))) AS n, generate_subscripts(string_split_regex(m, '[\x01\x02\x03]'), 1) AS k FROM r),
q AS (SELECT *, sum(n) OVER w AS upto, lag(n) OVER w AS lead_n FROM p WINDOW w AS (PARTITION BY doc_id, kind ORDER BY k)),
s AS (SELECT doc_id, kind, no, (upto - n - lead_n)::BIGINT AS b, upto::BIGINT AS e FROM q WHERE k % 3 = 0 AND n + whole * lead_n >= least),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
             string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, no) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
""".replace("@ASSIGN@", ASSIGN.replace("'", "''"))
