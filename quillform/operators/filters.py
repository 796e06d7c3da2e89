"""Filters of lists, and which rows and answers count as filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import casefold, text


def _holds(query: str, *columns: str) -> Column:
    """Whether the folded query is in the folded texts of the columns, joined by blanks; an empty query is in all."""
    needle = query.strip()
    return F.lit(True) if not needle else F.contains(casefold(F.concat_ws(" ", *[text(F.col(c)) for c in columns])), casefold(F.lit(needle)))


def _chosen(column: str, value: str) -> Column:
    return F.lit(True) if value == "all" else F.col(column) == value


def fields(df: DataFrame, query: str = "", kind: str = "all", status: str = "all") -> DataFrame:
    """Fields by text in id, label or section, by type and by status."""
    return df.filter(_holds(query, "id", "label", "section") & _chosen("type", kind) & _chosen("status", status))


def candidates(df: DataFrame, query: str = "", band: str = "all", priority: str = "all", kind: str = "all") -> DataFrame:
    """Candidates by text in id, label, preview or source, by confidence band, review priority and type."""
    return df.filter(_holds(query, "field_id", "label", "preview", "source") & _chosen("band", band) & _chosen("priority", priority) & _chosen("type", kind))


def anywhere(df: DataFrame, query: str) -> DataFrame:
    """Rows with the query in any column's text."""
    return df.filter(_holds(query, *df.columns))


def options(column: str, query: str) -> Column:
    """The options (ARRAY<STRUCT<label, value>>) that hold the query, its blanks squeezed."""
    needle = " ".join(query.casefold().split())
    return F.col(column) if not needle else F.filter(column, lambda o: F.contains(casefold(F.concat_ws(" ", o["label"], o["value"])), F.lit(needle)))


def search(query: str, **tables: DataFrame) -> DataFrame:
    """(kind, id) of rows in several tables whose texts hold the query; each table's first column is its id."""
    out = None
    for kind, df in tables.items():
        rows = df.filter(_holds(query, *df.columns[1:])).select(F.lit(kind).alias("kind"), F.col(df.columns[0]).cast("long").alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return out


def overview(**tables: DataFrame) -> DataFrame:
    """(kind, n): the rows of each table."""
    out = None
    for kind, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def neutral(value: Column, kind: Column, visible: Column) -> Column:
    """A collected answer as text: an invisible field's is false, an empty list or an empty text."""
    return F.when(visible, value).when(kind == "checkbox", "false").when(kind == "repeatable_table", "[]").otherwise("")


def meaningful_row(row: Column) -> Column:
    """Whether a table row (MAP<column, text>) has a cell that isn't blank or false; columns with two underscores in front don't count."""
    return F.exists(F.map_entries(row), lambda e: ~F.startswith(e["key"], F.lit("__")) & ~F.lower(F.trim(text(e["value"]))).isin("", "false"))


def meaningful_forms(answers: DataFrame, key: str) -> DataFrame:
    """Keys with an answer worth keeping: (key, type, value, rows, automatic), automatic dates left out."""
    filled = F.when(F.col("type") == "checkbox", F.lower(F.trim(text(F.col("value")))) == "true").when(F.col("type") == "repeatable_table", F.exists("rows", meaningful_row)).otherwise(F.trim(text(F.col("value"))) != "")
    return answers.filter(~((F.col("type") == "date") & F.coalesce("automatic", F.lit(False)))).filter(F.coalesce(filled, F.lit(False))).select(key).distinct()
