"""Query op3_warc_archive and its SQL."""

from pyspark.sql import DataFrame, SparkSession

from . import warc
from .common import scratch, table


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as WARC records and read back."""
    out = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), out)
    return warc.read(spark, out, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= {warc.REVISIT_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {warc.REVISIT_BYTES} AND page_id <> first THEN first END AS refers_to
FROM g
"""

QUERIES = {"op3_warc_archive": op3_warc_archive}
ORACLES = {"op3_warc_archive": SQL}
