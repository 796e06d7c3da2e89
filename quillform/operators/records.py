"""Documents as ordered records: lines, sections, labels, islands, grids, candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import squeeze


def lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, ordinal, line): each line of each text."""
    return df.select(F.col(key), F.posexplode(F.split(text, "\n", -1)).alias("ordinal", "line"))


def forward_fill(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The latest non-null value at or before each record."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def previous(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The latest non-null value before each record."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def islands(df: DataFrame, keys: list[str], order: list[str], kind: str) -> DataFrame:
    """Add ``island``: runs of neighbours with equal ``kind`` within ``keys``, numbered from 0."""
    w = W.partitionBy(*keys).orderBy(*order)
    new = F.when(F.lag(kind).over(w).eqNullSafe(F.col(kind)), 0).otherwise(1)
    return df.withColumn("i_new", new).withColumn("island", (F.sum("i_new").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).cast("int")).drop("i_new")


def starts(df: DataFrame, keys: list[str], order: list[str], span: str) -> DataFrame:
    """Add ``start``: the grid position of each cell, from the spans before it in its row."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("start", F.coalesce(F.sum(span).over(w), F.lit(0)).cast("int"))


def overlap_headers(cells: DataFrame, headers: DataFrame, keys: list[str], columns: int) -> DataFrame:
    """(keys, start, header): texts of header cells that overlap each cell, left to right, joined by `` / ``.

    Both sides have ``start`` and ``span``. Header cells over the full width are titles, not headers. Cells meet through
    the grid columns that they cover, an equi-join, not by comparing all intervals.
    """
    cover = lambda df: df.withColumn("at", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("span") - 1)))
    h = cover(headers.filter(F.col("span") < columns).select(*keys, "start", "span", F.col("text").alias("header"))).select(*keys, "at", F.col("start").alias("h_start"), "header")
    pairs = cover(cells.select(*keys, "start", "span")).join(h, [*keys, "at"]).select(*keys, "start", "h_start", "header").distinct()
    ordered = F.array_sort(F.collect_list(F.struct("h_start", "header")))
    return pairs.groupBy(*keys, "start").agg(F.array_join(F.transform(ordered, lambda x: x["header"]), " / ").alias("header"))


def overlapping(df: DataFrame, keys: list[str], start: str, end: str, tie: str) -> DataFrame:
    """Rows that begin before an earlier row of their group has ended (sorted by start, end, tie)."""
    w = W.partitionBy(*keys).orderBy(start, end, tie).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("o_end", F.max(end).over(w)).filter(F.col(start) < F.col("o_end")).drop("o_end")


def header_asof(rows: DataFrame, headers: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each row with the header at its place or the nearest before it.

    One union and one window: headers and rows are sorted together, so a row reads its header by forward fill, and no
    pair is built.
    """
    both = headers.select(key, F.col(at).alias("h_at"), F.lit(0).alias("h_row"), F.struct(F.col(value).alias("v")).alias("h_value"), F.lit(None).cast(rows.select(F.struct(*rows.columns)).schema[0].dataType).alias("h_rest"))
    mine = rows.select(key, F.col(at).alias("h_at"), F.lit(1).alias("h_row"), F.lit(None).cast(both.schema["h_value"].dataType).alias("h_value"), F.struct(*rows.columns).alias("h_rest"))
    w = W.partitionBy(key).orderBy("h_at", "h_row").rowsBetween(W.unboundedPreceding, 0)
    return both.union(mine).withColumn("h_last", F.last("h_value", ignorenulls=True).over(w)).filter("h_row = 1").select("h_rest.*", F.col("h_last.v").alias(value))


def dedupe(candidates: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The best candidate of each key: first by ``order``, which must be total."""
    return candidates.withColumn("d_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("d_rank = 1").drop("d_rank")


def suppress_owned(candidates: DataFrame, key: str) -> DataFrame:
    """Drop candidates (key, cand, kind, places) all of whose places lie in one table of the same document.

    Tables add ``suppressed``, how many they took; a candidate counts for the first table (by cand) that holds it. A
    candidate meets only the tables that own its first place.
    """
    c = candidates.withColumn("s_id", F.struct(key, "cand"))
    tables = c.filter("kind = 'table'").select(F.col(key).alias("t_key"), F.col("cand").alias("t_cand"), F.col("places").alias("t_places"), F.explode("places").alias("t_at"))
    inner = c.filter("kind <> 'table' AND size(places) > 0").select(key, "cand", "places", F.array_min("places").alias("at"))
    held = inner.join(tables, (F.col(key) == F.col("t_key")) & (F.col("at") == F.col("t_at"))).filter(F.size(F.array_except("places", "t_places")) == 0)
    first = held.groupBy(key, "cand").agg(F.min("t_cand").alias("t_cand"))
    took = first.groupBy(key, F.col("t_cand").alias("cand")).agg(F.count("*").alias("suppressed"))
    left = candidates.join(first.select(key, "cand"), [key, "cand"], "left_anti")
    return left.join(took, [key, "cand"], "left").select(*candidates.columns, F.coalesce("suppressed", F.lit(0)).alias("suppressed"))


def numbered_table(cells: DataFrame, key: str, number: str) -> DataFrame:
    """Keys whose row numbers are 1..n without a gap, with n."""
    g = cells.groupBy(key).agg(F.min(number).alias("lo"), F.max(number).alias("hi"), F.count_distinct(number).alias("n"), F.count("*").alias("rows"))
    return g.filter("lo = 1 AND hi = n AND rows = n AND n >= 2").select(key, F.col("n").cast("long").alias("n_rows"))


def options(raw: Column) -> Column:
    """ARRAY<STRUCT<label, value>> of option texts: ``label => value`` or one text for both; the first of a value stays."""
    trimmed = F.filter(F.transform(raw, lambda x: F.trim(x)), lambda x: x != "")
    at = lambda x: F.instr(x, "=>")
    made = F.transform(trimmed, lambda x: F.when(at(x) > 0, F.struct(F.trim(F.left(x, at(x) - 1)).alias("label"), F.trim(F.substring(x, at(x) + 2, F.length(x))).alias("value"))).otherwise(F.struct(x.alias("label"), x.alias("value"))))
    return F.aggregate(made, F.expr("cast(array() as array<struct<label:string,value:string>>)"), lambda acc, x: F.when(F.exists(acc, lambda y: y["value"] == x["value"]), acc).otherwise(F.concat(acc, F.array(x))))


def field_id(label: Column) -> Column:
    """``auto.`` and the label's slug, 72 characters at most; a leading digit gets a prefix."""
    slug = F.left(squeeze(F.lower(label), "_"), F.lit(72))
    return F.concat(F.lit("auto."), F.when(slug.rlike("^[0-9]"), F.concat(F.lit("campo_"), slug)).otherwise(slug))


def unique_ids(df: DataFrame, base: str, order: list[str], *keys: str, taken: DataFrame | None = None, name: str = "unique_id") -> DataFrame:
    """Add ``name``: base, or the first of base_2, base_3... that no row before (in ``order``) and no row of ``taken`` has.

    ``taken`` has the keys and ``base``. Names can clash only if they are equal without their numbers at the end, so each
    such stem is settled by itself: where it has one base, the n-th row gets the n-th name that isn't taken, by a window; else row by
    row.
    """
    stem = F.regexp_replace(F.col(base), r"(?:_[0-9]+)+$", "")
    # The row goes along whole, so that both branches below read the same exchange and what is before it runs once.
    rows = df.select(*dict.fromkeys((*keys, *order, base)), F.array(F.struct(*df.columns)).alias("u_rows")).withColumn("u_stem", stem)
    whole = F.element_at("u_rows", 1)
    by = W.partitionBy(*keys, "u_stem")
    rows = rows.withColumn("u_n", F.row_number().over(by.orderBy(*order))).withColumn("u_single", F.min(base).over(by) == F.max(base).over(by))
    if taken is not None:
        had = taken.select(*keys, F.col(base).alias("u_had")).withColumn("u_stem", F.regexp_replace("u_had", r"(?:_[0-9]+)+$", "")).groupBy(*keys, "u_stem").agg(F.collect_set("u_had").alias("u_taken"))
        rows = rows.join(had, [*keys, "u_stem"], "left")
    else:
        rows = rows.withColumn("u_taken", F.lit(None).cast("array<string>"))
    alone = F.col("u_single")
    # The numbers of the base's names that are taken, in order; each that isn't above a row's number raises it by one.
    number = lambda x: F.when(x == F.col(base), 1).otherwise(F.substring(x, F.char_length(base) + 2, F.lit(1 << 20)).try_cast("long"))
    own = lambda x: (x == F.col(base)) | (x == F.concat_ws("_", base, number(x).cast("string"))) & (number(x) > 1)
    gone = F.array_sort(F.transform(F.filter(F.coalesce("u_taken", F.expr("cast(array() as array<string>)")), own), number))
    rows = rows.withColumn("u_at", F.when(F.col("u_single"), F.aggregate(gone, F.col("u_n").cast("long"), lambda m, k: F.when(k <= m, m + 1).otherwise(m))).otherwise(F.col("u_n").cast("long")))
    simple = F.when(F.col("u_at") == 1, F.col(base)).otherwise(F.concat_ws("_", base, F.col("u_at").cast("string")))
    given = rows.filter(F.coalesce(alone, F.lit(True))).select(*[whole[c].alias(c) for c in df.columns], simple.alias(name))
    slim = rows.filter(~alone).select(whole.alias("u_row"), *[F.col(k).alias(f"u_k{i}") for i, k in enumerate(keys)], "u_stem", "u_n", F.col(base).alias("u_base"), "u_taken")
    schema = slim.select("u_row", F.col("u_base").alias("u_made")).schema

    def settle(t: pa.Table) -> pa.Table:
        turn = np.argsort(t.column("u_n").to_numpy(), kind="stable")
        had, bases, following = t.column("u_taken")[0].as_py(), t.column("u_base").to_pylist(), {}
        used, made = set(had or ()), [None] * len(bases)
        for i in turn.tolist():
            b = bases[i]
            out = b
            if b in used:
                n = following.get(b, 2)
                while f"{b}_{n}" in used:
                    n += 1
                out, following[b] = f"{b}_{n}", n + 1
            used.add(out)
            made[i] = out
        return pa.table([t.column("u_row"), pa.array(made, pa.string())], ["u_row", "u_made"])

    settled = slim.groupBy(*[f"u_k{i}" for i in range(len(keys))], "u_stem").applyInArrow(settle, schema)
    return given.unionByName(settled.select(*[F.col(f"u_row.`{c}`") for c in df.columns], F.col("u_made").alias(name)))
