"""Unfilled areas and their labels in paragraph and cell records (doc, table, row, cell, ordinal, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import labels
from ..functions.text import fold

#: Mask kinds, what they look like, and the confidence with a label before them and without.
MASKS = (
    ("currency", labels.CURRENCY_MASK, 0.91, 0.74),
    ("letters", labels.X_MASK, 0.91, 0.74),
    ("underscores", labels.UNDERSCORE_MASK, 0.91, 0.74),
    ("phone", labels.PHONE_MASK, 0.91, 0.74),
    ("cpf", labels.CPF_MASK, 0.91, 0.74),
    ("email", labels.EMAIL_MASK, 0.91, 0.74),
    ("braces", labels.BRACE_MASK, 0.98, 0.82),
)
BOX = labels.BOX
SEPARATOR = r"(?i)^\s*ou\s*$"
NUMBERED = r"^\s*\d+(?:\.\d+)*\.?\s+\S"
LABEL_TAIL = labels.LABEL_TAIL


def spans(text: Column, pattern: str) -> Column:
    """ARRAY<STRUCT<start, end>> of a pattern's matches, from what stands between them."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    size = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))
    return F.transform(found, lambda m, i: F.struct((size(between, i + 1) + size(found, i)).alias("start"), (size(between, i + 1) + size(found, i) + F.length(m)).alias("end")))


def masks(text: Column) -> Column:
    """ARRAY<STRUCT<start, end, kind, confidence>>: visual masks, earliest first, the widest of those that begin together, none overlapping."""
    every = []
    for rank, (kind, pattern, labelled, bare) in enumerate(MASKS):
        every.append(
            F.transform(
                spans(text, pattern),
                lambda s: F.struct(
                    s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),  # noqa: B023
                    F.when(F.substring(text, F.lit(1), s["start"]).rlike(LABEL_TAIL), labelled).otherwise(bare).alias("confidence"),  # noqa: B023
                ),
            )
        )
    ordered = F.array_sort(F.concat(*every))
    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:string,confidence:double>>)")
    step = lambda acc, s: F.when((F.size(acc) == 0) | (F.element_at(acc, -1)["end"] <= s["start"]), F.concat(acc, F.array(F.struct(s["start"].alias("start"), (-s["back"]).alias("end"), s["kind"].alias("kind"), s["confidence"].alias("confidence"))))).otherwise(acc)
    return F.aggregate(ordered, none, step)


def inline_options(text: Column) -> Column:
    """Options of a text with 2 to 8 check boxes, each of 1 to 220 characters; null if one isn't."""
    parts = F.transform(F.slice(F.split(text, BOX, -1), 2, 100), lambda x: F.trim(x))
    good = F.size(parts).between(2, 8) & F.forall(parts, lambda x: F.length(x).between(1, 220))
    return F.when(good, parts)


def label_tail(text: Column) -> Column:
    """The label that ends a text with a colon, or null."""
    got = F.trim(F.regexp_extract(text, LABEL_TAIL, 1))
    return F.when(got != "", got)


def reasonable_label(x: Column) -> Column:
    """Short, with a letter, and no sentence."""
    return (F.length(F.trim(x)).between(2, 100)) & x.rlike("(?U)\\p{L}") & (F.size(F.split(F.trim(x), r"\s+")) <= 12) & ~x.rlike(r"\.\s*$")


def fill_area(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^[\s_.Xx…-]*$"), F.lit(True))


def role(x: Column) -> Column:
    return F.when(F.trim(x) == "", "blank").when(x.rlike(NUMBERED) & (F.length(x) <= 190), "section").when(fill_area(x), "fill_area").when(label_tail(x).isNotNull(), "label").otherwise("content")


def annotate(records: DataFrame) -> DataFrame:
    """Add section, label, label_source, label_confidence, role to records (doc, ordinal, table_index, row_index, cell_index, text).

    The first of the surest attempts wins: a label in the same text .98, the cell at the left .97, the one above .80,
    the nearest paragraph before .58, the section .35. Windows run within a document, row or column.
    """
    w_doc = W.partitionBy("doc").orderBy("ordinal")
    w_row = W.partitionBy("doc", "table_index", "row_index").orderBy("cell_index", "ordinal").rowsBetween(W.unboundedPreceding, -1)
    w_col = W.partitionBy("doc", "table_index", "cell_index").orderBy("row_index", "ordinal").rowsBetween(W.unboundedPreceding, -1)
    in_cell = F.col("table_index").isNotNull()
    usable = F.when(reasonable_label(F.col("text")) & ~fill_area(F.col("text")), F.trim(F.regexp_replace("text", r"\s*:\s*$", "")))
    rows = records.withColumn("role", role(F.col("text")))
    rows = rows.withColumn("section", F.last(F.when(F.col("role") == "section", F.col("text")), ignorenulls=True).over(w_doc.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("a_left", F.when(in_cell, F.last(usable, ignorenulls=True).over(w_row))).withColumn("a_above", F.when(in_cell, F.last(usable, ignorenulls=True).over(w_col)))
    rows = rows.withColumn("a_before", F.last(usable, ignorenulls=True).over(w_doc.rowsBetween(W.unboundedPreceding, -1)))
    tries = [(label_tail(F.regexp_replace("text", r"[_Xx.…/\s-]+$", "")), "same_text", 0.98), (F.col("a_left"), "left", 0.97), (F.col("a_above"), "column", 0.80), (F.col("a_before"), "nearby", 0.58), (F.col("section"), "section", 0.35)]
    best = F.coalesce(*[F.when(v.isNotNull(), F.struct(v.alias("label"), F.lit(s).alias("source"), F.lit(c).alias("confidence"))) for v, s, c in tries])
    return rows.withColumn("a", best).select(*records.columns, "role", "section", F.col("a.label").alias("label"), F.col("a.source").alias("label_source"), F.col("a.confidence").alias("label_confidence"))


def empty_cells(cells: DataFrame, *keep: str) -> DataFrame:
    """Blank cells with a label at their left: .84 next to it, .68 further away; with their columns ``keep``."""
    w = W.partitionBy("doc", "table_index", "row_index").orderBy("cell_index")
    named = F.when(reasonable_label(F.col("text")), F.struct(F.trim("text").alias("label"), F.col("cell_index").alias("at")))
    rows = cells.withColumn("e", F.last(named, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    sure = F.when(F.col("cell_index") - F.col("e.at") == 1, 0.84).otherwise(0.68)
    return rows.filter((F.trim("text") == "") & F.col("e").isNotNull()).select("doc", "table_index", "row_index", "cell_index", F.col("e.label").alias("label"), sure.alias("confidence"), *keep)


def checkbox_groups(rows: DataFrame, least: int = 2) -> DataFrame:
    """Runs of consecutive rows (doc, row_index, text) that begin with one check box: first row, count, options."""
    one = rows.filter((F.size(F.regexp_extract_all("text", F.lit(BOX), F.lit(0))) == 1) & F.col("text").rlike(rf"^\s*(?:{BOX})\s*\S"))
    island = F.col("row_index") - F.row_number().over(W.partitionBy("doc").orderBy("row_index"))
    option = F.trim(F.regexp_replace("text", rf"^\s*(?:{BOX})", ""))
    g = one.withColumn("g", island).groupBy("doc", "g").agg(F.min("row_index").alias("first_row"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("row_index", option.alias("o")))).alias("o"))
    return g.filter(F.col("n") >= least).select("doc", "first_row", "n", F.transform("o", lambda x: x["o"]).alias("options"))


def long_choices(records: DataFrame, key: str, order: str) -> DataFrame:
    """Alternatives between lines ``OU``: keys with two separators at least and 3 to 10 alternatives, with their texts."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    sep = F.col("text").rlike(SEPARATOR)
    rows = records.withColumn("part", F.sum(sep.cast("int")).over(w)).filter(~sep & (F.trim("text") != ""))
    parts = rows.groupBy(key, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "\n").alias("t"))
    g = parts.groupBy(key).agg(F.count("*").alias("n"), F.max("part").alias("seps"), F.transform(F.array_sort(F.collect_list(F.struct("part", "t"))), lambda x: x["t"]).alias("options"))
    return g.filter((F.col("seps") >= 2) & F.col("n").between(3, 10)).select(key, "n", "options")


def editable_sheets(rows: DataFrame) -> DataFrame:
    """Rows (doc, table_index, row_index, n_cells, text) of three cells or more before one merged row with fill or 55 characters."""
    w = W.partitionBy("doc", "table_index").orderBy("row_index")
    nxt, text = F.lead("n_cells").over(w), F.lead("text").over(w)
    return rows.withColumn("hit", (F.col("n_cells") >= 3) & (nxt == 1) & (fill_area(text) | (F.length(text) >= 55))).filter("hit").drop("hit")


def consistency_repairs(cells: DataFrame, least: float = 0.74) -> DataFrame:
    """Blank cells in columns that are editable in two other rows at least; cells have ``editable`` and ``label_confidence``."""
    keys = ["doc", "table_index", "cell_index"]
    wide = cells.filter("editable").groupBy(*keys).agg(F.count_distinct("row_index").alias("rows")).filter("rows >= 2")
    return cells.filter((F.trim("text") == "") & ~F.col("editable") & (F.col("label_confidence") >= least)).join(wide, keys, "left_semi").withColumn("confidence", F.lit(0.68))


#: Evidence codes and what they add to a candidate's confidence or take from it.
WEIGHTS = {
    "label_agreement": 0.10,
    "label_repaired": 0.08,
    "label_disagreement": -0.06,
    "local_context": 0.07,
    "section_only": -0.18,
    "type_support": 0.05,
    "group_structure": 0.06,
    "region_ownership": 0.04,
    "spatial_structure": 0.05,
    "poor_label": -0.30,
    "pdf_reconstruction": -0.02,
}
POOR_CAP = 0.54


def rescore(base: Column, evidence: Column) -> Column:
    """STRUCT<confidence, band, priority, selected>: base plus the weights of an array of evidence codes, a poor label capped."""
    weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    total = F.aggregate(evidence, base.cast("double"), lambda a, c: a + F.coalesce(weight[c], F.lit(0.0)))
    clamped = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4)
    c = F.when(F.array_contains(evidence, "poor_label"), F.least(clamped, F.lit(POOR_CAP))).otherwise(clamped)
    band = F.when(c >= 0.85, "high").when(c >= 0.65, "medium").otherwise("low")
    # A detector that is less sure than even is evidence against, too.
    negative = F.exists(evidence, lambda x: weight[x] < 0) | (base < 0.5)
    priority = F.when(band == "low", "required").when((band == "medium") | negative, "recommended").otherwise("ready")
    return F.struct(c.alias("confidence"), band.alias("band"), priority.alias("priority"), (c >= 0.80).alias("selected"))


def final_ids(candidates: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``candidate_0001``... per key in a total order."""
    n = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return candidates.withColumn("candidate_id", F.concat(F.lit("candidate_"), F.lpad(n.cast("string"), 4, "0")))


def declares(x: Column) -> Column:
    """Whether options are declarations, of which several may hold."""
    return fold(x).rlike(r"\b(?:declar|concord|autoriz|ciente|aceit)")
