"""Query op13_tokenizer_alignment."""

from pyspark.sql import DataFrame, SparkSession

from . import crosstoken
from .common import table


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, aligned between both tokenizers."""
    found = crosstoken.align(table(spark, sf_dir, "documents"), keep=["doc_id"], digest=True)
    return found.selectExpr("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups AS groups_sha256")


QUERIES = {"op13_tokenizer_alignment": op13_tokenizer_alignment}
ORACLES: dict[str, str] = {}  # no tokenizer in SQL
