"""Histories, sequences, progress and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

RECENT_CAP, AUDIT_CAP, BACKUPS_KEPT = 250, 2000, 7


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last record of each key, by an aggregation with partial maxima (no sort of the groups)."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("b"))
    return best.select(*keys, "b.*")


def newest(df: DataFrame, order: list[Column], cap: int) -> DataFrame:
    """The newest ``cap`` records: a history's cap is its feature."""
    return df.orderBy(*order).limit(cap)


def beyond(df: DataFrame, keys: list[str], order: list[Column], keep: int) -> DataFrame:
    """Records that a retention of ``keep`` per key removes."""
    return df.withColumn("r_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("r_rank") > keep).drop("r_rank")


def sequences(df: DataFrame, keys: list[Column], order: list[str], padding: int = 4) -> DataFrame:
    """Add ``sequence`` and its padded ``number`` within the keys."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("sequence", n).withColumn("number", F.lpad(F.col("sequence").cast("string"), padding, "0"))


def progress(df: DataFrame, key: str, answered: Column, required: Column) -> DataFrame:
    """Answered and open required fields per key, and the share in whole per cent."""
    g = df.groupBy(key).agg(F.count("*").alias("fields"), F.count_if(answered).alias("answered"), F.count_if(required & ~answered).alias("missing"))
    return g.withColumn("percent", F.floor(100 * F.col("answered") / F.col("fields")).cast("long"))


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: list[Column], deleted: str = "deleted") -> DataFrame:
    """``base`` with the last change of each key applied; a change marked deleted removes its key."""
    last = latest(changes, keys, order)
    kept = base.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last.filter(~F.col(deleted)).select(*base.columns))
