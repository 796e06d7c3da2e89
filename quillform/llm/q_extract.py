"""Query op11_html_extraction and its SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import extract
from .common import table


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    found = extract.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("page.page_id", "page.url", "text", F.length("text").cast("long").alias("n_chars"))


#: The pages of the table mark their article; blocks in it are h1 and p. Character references are those of escaped text.
SQL = r"""
WITH a AS (SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '') AS body FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '</?b>', '', 'g'), '</?(h1|p|br)>', ' ', 'g') AS body FROM a),
c AS (SELECT page_id, url, regexp_replace(replace(replace(replace(replace(replace(body, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&middot;', chr(183)), '&amp;?', '&', 'g') AS body FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(body, '[\s\x{B}\x{1C}-\x{1F}\x{85}\x{A0}\p{Z}]+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""

QUERIES = {"op11_html_extraction": op11_html_extraction}
ORACLES = {"op11_html_extraction": SQL}
