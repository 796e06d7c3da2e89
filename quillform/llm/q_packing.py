"""Query op4_mixture_packing."""

from pyspark.sql import DataFrame, SparkSession

from . import packing
from .common import table

COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document's tokens."""
    return packing.pack(table(spark, sf_dir, "documents")).select(*COLUMNS)


QUERIES = {"op4_mixture_packing": op4_mixture_packing}
ORACLES: dict[str, str] = {}  # no tokenizer in SQL
