"""Sections, grids and groups of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MAX_GRID = 12


def sections(fields: DataFrame, key: str = "template_id") -> DataFrame:
    """Add ``section_rank``: sections in the order in which they first appear."""
    first = F.min("pos").over(W.partitionBy(key, "section"))
    return fields.withColumn("l_first", first).withColumn("section_rank", F.dense_rank().over(W.partitionBy(key).orderBy("l_first")).cast("int")).drop("l_first")


def swap_sections(fields: DataFrame, a: int, b: int, key: str = "template_id") -> DataFrame:
    """New ``pos`` (from 0) after sections of ranks a and b have changed places."""
    r = sections(fields, key)
    to = F.when(F.col("section_rank") == a, b).when(F.col("section_rank") == b, a).otherwise(F.col("section_rank"))
    return r.withColumn("new_pos", F.row_number().over(W.partitionBy(key).orderBy(to, "pos")) - 1).drop("section_rank")


def normalize_sections(explicit: DataFrame, fields: DataFrame, key: str = "template_id") -> DataFrame:
    """(key, field_id, section): each field once, by an explicit list first, then its own section, then the rest."""
    ranked = explicit.select(key, "field_id", "section", F.lit(1).alias("by"), "pos").unionByName(
        fields.select(key, "field_id", F.coalesce("section", F.lit("Outros")).alias("section"), F.when(F.col("section").isNull(), 3).otherwise(2).alias("by"), "pos")
    )
    known = fields.select(key, "field_id").distinct()
    best = ranked.groupBy(key, "field_id").agg(F.min(F.struct("by", "pos", "section")).alias("b"))
    return best.join(known, [key, "field_id"], "left_semi").select(key, "field_id", F.col("b.section").alias("section"))


def static_rows(cells: DataFrame, *keys: str) -> DataFrame:
    """Rows of static texts: cells by column, joined, with their smallest order."""
    ordered = F.array_sort(F.collect_list(F.struct("column", "text")))
    return cells.groupBy(*keys).agg(F.min("order").alias("order"), F.array_join(F.transform(ordered, lambda x: x["text"]), " | ").alias("texts"))


def normalize_grid(fields: DataFrame, *group: str) -> DataFrame:
    """Clamp start, span and columns of fields to their group's grid (1 to 12 columns); a row of one field takes its whole width."""
    grid = F.least(F.lit(MAX_GRID), F.greatest(F.lit(1), F.max(F.greatest("columns", F.col("start") + F.col("span"))).over(W.partitionBy(*group))))
    alone = F.count("*").over(W.partitionBy(*group, "row")) == 1
    f = fields.withColumn("grid", grid.cast("int")).withColumn("alone", alone)
    start = F.when(F.col("alone"), 0).otherwise(F.greatest(F.lit(0), F.least("start", F.col("grid") - 1)))
    f = f.withColumn("new_start", start.cast("int"))
    span = F.when(F.col("alone"), F.col("grid")).otherwise(F.greatest(F.lit(1), F.least("span", F.col("grid") - F.col("new_start"))))
    return f.withColumn("new_span", span.cast("int")).drop("alone")


def distinct_labels(columns: DataFrame, key: str) -> DataFrame:
    """Repeated labels of a table's columns give way to labels from their ids, if those are all distinct."""
    repeated = F.count("*").over(W.partitionBy(key, "label")) > 1
    wanted = F.when(F.col("repeated"), F.col("id_label")).otherwise(F.col("label"))
    f = columns.withColumn("repeated", repeated).withColumn("wanted", wanted)
    # Counted by label, then by table: no row carries the labels of its table.
    fits = f.groupBy(key, "wanted").agg(F.count("wanted").alias("n")).groupBy(F.col(key).alias("d_key")).agg(F.every(F.col("n") == 1).alias("fits"))
    return f.join(fits, F.col(key).eqNullSafe(F.col("d_key")), "left").select(*columns.columns, F.when(F.col("fits"), F.col("wanted")).otherwise(F.col("label")).alias("shown"))


def common_prefix(labels: Column) -> Column:
    """The leading words that all labels of an array share."""
    words = F.transform(labels, lambda x: F.split(F.trim(x), r"\s+"))
    first = F.get(words, F.lit(0))
    upto = F.aggregate(F.sequence(F.lit(1), F.size(first)), F.lit(0), lambda n, i: F.when((n == i - 1) & F.forall(words, lambda w: F.get(w, i - 1) == F.get(first, i - 1)), i).otherwise(n))
    return F.when(F.size(labels) > 0, F.array_join(F.slice(first, F.lit(1), upto), " ")).otherwise("")


def sample_rows(fields: DataFrame, key: str, value: Column) -> DataFrame:
    """Sample values per field; of an exclusive group the first is true and the rest false."""
    n = F.row_number().over(W.partitionBy(key, "group").orderBy("pos"))
    return fields.withColumn("sample", F.when(F.col("group").isNotNull(), (n == 1).cast("string")).otherwise(value))


def choice_groups(boxes: DataFrame, *cell: str) -> DataFrame:
    """Cells of two to six boxes with exclusive labels: sim and não, or labels that share a word."""
    low = F.transform("labels", lambda x: F.lower(F.trim(x)))
    g = boxes.groupBy(*cell).agg(F.array_sort(F.collect_list("label")).alias("labels"))
    words = F.transform(low, lambda x: F.split(x, r"\s+"))
    shared = F.aggregate(words, F.get(words, F.lit(0)), lambda a, x: F.array_intersect(a, x))
    yes_no = F.forall(low, lambda x: x.isin("sim", "não", "nao", "não se aplica"))
    return g.filter(F.size("labels").between(2, 6) & (yes_no | (F.size(shared) > 0)))
