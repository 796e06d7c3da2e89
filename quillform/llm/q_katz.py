"""Query op5_katz_scores."""

from pyspark.sql import DataFrame, SparkSession

from . import katz
from .common import table


def op5_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document."""
    return katz.score(table(spark, sf_dir, "documents"))


QUERIES = {"op5_katz_scores": op5_katz_scores}
ORACLES: dict[str, str] = {}
