"""Saved answers as profiles, and their use in other templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import identity_text, is_empty
from . import matching


def payload(fields: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """(key, name, value): every field's answer under its id, and under its profile key.

    ``fields`` has field_id, profile_key and pos, ``answers`` field_id and value. An id wins over a profile key of the
    same name, unless its answer is empty; of several fields with one profile key the first with an answer wins.
    """
    rows = fields.filter(F.trim(F.coalesce("field_id", F.lit(""))) != "").join(answers.select(key, "field_id", "value"), [key, "field_id"], "left")
    own = rows.select(key, F.col("field_id").alias("name"), "value", F.lit(0).alias("by"), "pos")
    alias = rows.filter("profile_key <> '' AND profile_key <> field_id").select(key, F.col("profile_key").alias("name"), "value", F.lit(1).alias("by"), "pos")
    ranked = own.unionByName(alias).withColumn("p_empty", is_empty(F.col("value")))
    # An empty id gives way to an alias with an answer; without any answer the first stays.
    best = ranked.groupBy(key, "name").agg(F.min(F.struct(F.col("p_empty"), "by", "pos", "value")).alias("b"))
    return best.select(key, "name", F.col("b.value").alias("value"))


def identities(fields: DataFrame, key: str) -> DataFrame:
    """The descriptors by which answers find equivalent fields: normalised label, section, type, meaning and context."""
    col = lambda c, d="": F.coalesce(F.col(c), F.lit(d)) if c in fields.columns else F.lit(d)
    return fields.select(key, "field_id", identity_text(col("label")).alias("label_norm"), col("type", "text").alias("type"), identity_text(col("section")).alias("section_norm"), matching.semantic_identity(col("label"), F.col("field_id")).alias("semantic"), col("profile_identity").alias("context"))


def resolve(fields: DataFrame, answers: DataFrame, described: DataFrame, key: str) -> DataFrame:
    """``fields`` with the saved value and the stage that found it: 1 id, 2 profile key, 3 identity, 4 ending of an old key.

    ``answers`` is (key, name, value), ``described`` the identities of the fields that they were saved for. Each stage
    sees only what those before have left; a saved value may be empty and still settles its field.
    """
    saved = answers.select(key, "name", "value")
    take = lambda df, on, stage: df.join(saved.withColumnRenamed("name", on), [key, on]).select(key, "field_id", "value", F.lit(stage).alias("stage"))
    first = take(fields, "field_id", 1)
    rest = fields.join(first.select(key, "field_id"), [key, "field_id"], "left_anti")
    second = take(rest.filter("profile_key <> ''"), "profile_key", 2)
    rest = rest.join(second.select(key, "field_id"), [key, "field_id"], "left_anti")
    pairs = matching.identity_matches(described, identities(rest, key), key).select(key, F.col("target_id").alias("field_id"), F.col("source_id").alias("name"))
    third = pairs.join(saved, [key, "name"]).select(key, "field_id", "value", F.lit(3).alias("stage"))
    rest = rest.join(third.select(key, "field_id"), [key, "field_id"], "left_anti")
    endings = matching.suffix_matches(saved.withColumnRenamed("name", "answer_key"), rest, key)
    fourth = endings.join(saved.withColumnRenamed("name", "answer_key"), [key, "answer_key"]).select(key, "field_id", "value", F.lit(4).alias("stage"))
    found = first.unionByName(second).unionByName(third).unionByName(fourth)
    return fields.join(found, [key, "field_id"], "left")


def history_values(resolved: DataFrame, today: str) -> DataFrame:
    """Resolved fields for a new document of another template: what wasn't found is false, today or an empty text by type."""
    default = F.when(F.col("type") == "checkbox", "false").when(F.col("type") == "date", today).otherwise("")
    return resolved.withColumn("value", F.when(F.col("stage").isNotNull(), F.col("value")).otherwise(default))
