"""Removal of passages of 35 words or more that repeat anywhere, by the compacted graph of ``windows``.

Defined cases: null text has no words; a text under 35 words keeps all; repeated rows remove each other; an empty table
gives an empty table; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table
from .windows import Shape, cut

SHAPE = Shape("word", 35, 16)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cut(spark, table(spark, sf_dir, "documents"), SHAPE)
    return c.select("doc_id", F.col("n").alias("n_words"), "n_removed", "kept_sha256")


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
h AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 34], ' ')) AS k FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM h) WHERE c > 1),
g AS (SELECT doc_id, list(i ORDER BY i) AS starts FROM r GROUP BY doc_id),
u AS (SELECT w.doc_id, w.ws, unnest(range(1, len(ws) + 1)) AS j FROM w),
c AS (SELECT DISTINCT doc_id, i + o AS j FROM r, (SELECT unnest(range(0, 35)) AS o)),
k AS (SELECT u.doc_id, string_agg(u.ws[u.j], ' ' ORDER BY u.j) AS kept, count(*) AS n FROM u LEFT JOIN c ON u.doc_id = c.doc_id AND u.j = c.j WHERE c.j IS NULL GROUP BY u.doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, (len(w.ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
