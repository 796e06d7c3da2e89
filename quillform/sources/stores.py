"""Versioned JSON stores ``{schema_version, kind, data}``, and template folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def read_store(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(path, data, schema_version, status) of JSON files: the data as text; an un-enveloped file is version 0.

    Files of a later version or another kind, and broken ones, keep their row and say so in ``status``.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    version = F.get_json_object("value", "$.schema_version").try_cast("int")
    found = F.get_json_object("value", "$.kind")
    enveloped = version.isNotNull() & found.isNotNull()
    status = F.when(F.try_parse_json("value").isNull(), "broken").when(~enveloped, "migrated").when(version > VERSION, "too new").when(found != kind, "wrong kind").otherwise("ok")
    data = F.when(enveloped, F.get_json_object("value", "$.data")).otherwise(F.col("value"))
    return raw.select("path", status.alias("status"), F.coalesce(version, F.lit(0)).alias("schema_version"), F.when(status.isin("ok", "migrated"), data).alias("data"))


def envelope(df: DataFrame, kind: str, data: str = "data") -> DataFrame:
    """Rows of JSON text in envelopes."""
    return df.select(F.concat(F.lit(f'{{"schema_version":{VERSION},"kind":"{kind}","data":'), F.col(data), F.lit("}")).alias("value"))


def list_templates(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, version, category, path) of all ``template.json`` below a path, sorted by folded name and id."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "template.json").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    get = lambda *names: F.coalesce(*[F.get_json_object("value", f"$.{n}") for n in names])
    folder = F.element_at(F.split("path", "/"), -2)
    rows = raw.filter(F.try_parse_json("value").isNotNull() & ~folder.rlike("^[_.]"))
    out = rows.select(F.coalesce(get("id", "template.id"), folder).alias("id"), F.coalesce(get("name", "template.name"), folder).alias("name"), get("version", "template.version").alias("version"), get("category", "template.category").alias("category"), "path")
    return out.orderBy(F.lower("name"), F.lower("id"))


def paste_tsv(df: DataFrame, key: str, text: str, columns: list[str]) -> DataFrame:
    """(key, row, columns...) of tab-separated lines: blank lines are skipped, more cells than columns are dropped."""
    rows = df.select(key, F.filter(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1), lambda x: F.trim(x) != "").alias("t"))
    cells = rows.select(key, F.posexplode("t").alias("row", "line")).select(key, "row", F.split("line", "\t", -1).alias("c"))
    return cells.select(key, "row", *[F.trim(F.coalesce(F.get("c", F.lit(i)), F.lit(""))).alias(c) for i, c in enumerate(columns)])
