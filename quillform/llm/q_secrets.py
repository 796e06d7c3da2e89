"""Query op6_secret_scan."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import secrets
from .common import table


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with the forest's verdict; the candidate itself is returned as a digest."""
    out = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    # Outer: for a plain explode the optimizer infers a filter that repeats the whole scan.
    rows = out.select("doc_id", F.explode_outer("s_findings").alias("f")).filter(F.col("f").isNotNull())
    return rows.select("doc_id", F.col("f.start"), F.col("f.end"), F.sha2("f.candidate", 256).alias("candidate_sha256"), F.round("f.probability", 9).alias("probability"), F.col("f.secret"))


QUERIES = {"op6_secret_scan": op6_secret_scan}
ORACLES: dict[str, str] = {}  # no forest is trained in SQL
