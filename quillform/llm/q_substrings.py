"""Query op2_substring_dedup and its SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import substrings
from .common import table


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses, and a digest of the rest."""
    out = substrings.dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * substrings.WINDOW}) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {substrings.WINDOW - 1})) AS i FROM d WHERE length(h) >= {2 * substrings.WINDOW})),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM w),
s AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM m WHERE first < doc_id),
n AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + {substrings.WINDOW} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + {substrings.WINDOW} AS z FROM n GROUP BY doc_id, run),
p AS (SELECT doc_id, run, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY run), 0) AS y FROM r),
k AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * y + 1, 2 * (a - y)), '' ORDER BY run) || substr(any_value(h), 2 * max(z) + 1) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLES = {"op2_substring_dedup": SQL}
