"""Keyed stores: merging scans into what exists, favorites, free names, libraries, snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import is_empty
from .records import unique_ids

#: Where a label or type comes from that a person has set.
MANUAL = ("manual", "user")
#: Authority of a candidate's source when two overlap.
AUTHORITY = {"native": 40, "explicit": 30, "assisted": 10}


def merge_scanned(existing: DataFrame, scanned: DataFrame, keys: list[str]) -> DataFrame:
    """Fields of a new scan with what a person set before: a manual label or type stays, derived ones are refreshed.

    ``existing`` has label, label_source, type, type_source; ``scanned`` has label, type and pos. Fields that the scan
    doesn't have any more are dropped, new ones come with their scanned values.
    """
    e = existing.select(*keys, F.col("label").alias("e_label"), "label_source", F.col("type").alias("e_type"), "type_source")
    rows = scanned.join(e, keys, "left")
    keep = lambda source, old: F.col(source).isin(*MANUAL) & ~is_empty(F.col(old))
    return rows.select(
        *keys, "pos", F.when(keep("label_source", "e_label"), F.col("e_label")).otherwise(F.col("label")).alias("label"), F.when(keep("type_source", "e_type"), F.col("e_type")).otherwise(F.col("type")).alias("type"),
        F.col("e_type").isNull().alias("is_new"),
    )


def suppress_overlaps(candidates: DataFrame, keys: list[str], authority: Column) -> DataFrame:
    """Of candidates (start, span, cand) of a row whose columns overlap, those with less authority go; ties keep the earlier.

    Candidates meet in the grid columns they cover, an aggregation per column, so no pairs are built.
    """
    c = candidates.withColumn("o_key", F.struct((-authority).alias("a"), "start", "cand"))
    cover = c.withColumn("o_at", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("span") - 1)))
    best = cover.groupBy(*keys, "o_at").agg(F.min("o_key").alias("o_best"))
    beaten = cover.join(best, [*keys, "o_at"]).filter(F.col("o_key") > F.col("o_best")).select(*keys, "cand").distinct()
    return c.drop("o_key").join(beaten, [*keys, "cand"], "left_anti")


def free_names(wanted: DataFrame, taken: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Add ``free``: the name, or the first of name_2, name_3... that is neither in ``taken`` (column ``name``) nor given before."""
    return unique_ids(wanted, name, order, taken=taken.select(F.col("name").alias(name)), name="free")


def toggle(favorites: Column, item: Column) -> Column:
    """An ordered set with an item taken out, or put at its end."""
    clean = F.array_distinct(F.filter(favorites, lambda x: ~is_empty(x)))
    return F.when(F.array_contains(clean, item), F.array_remove(clean, item)).otherwise(F.concat(clean, F.array(item)))


def library(*groups: DataFrame) -> DataFrame:
    """Built-in and custom groups; a custom group replaces a built-in of the same id (later frames win)."""
    ranked = reduce(DataFrame.unionByName, [g.withColumn("l_rank", F.lit(i)) for i, g in enumerate(groups)])
    best = F.max("l_rank").over(W.partitionBy("id"))
    return ranked.withColumn("l_best", best).filter("l_rank = l_best").drop("l_rank", "l_best")


def snapshots(df: DataFrame, key: str, order: list[str], state: str, cap: int = 80) -> DataFrame:
    """The newest ``cap`` snapshots of each key that differ from the one before."""
    w = W.partitionBy(key).orderBy(*order)
    changed = df.withColumn("u_before", F.lag(state).over(w)).filter(F.col("u_before").isNull() | ~F.col("u_before").eqNullSafe(F.col(state))).drop("u_before")
    back = W.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return changed.withColumn("u_n", F.row_number().over(back)).filter(F.col("u_n") <= cap).drop("u_n")
