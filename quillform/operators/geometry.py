"""Words, boxes and blocks on pages: labels beside widgets, rows of choices, reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Widest gap in a run of words, farthest reach of a label, height of a line, drift and distance of choice rows.
GAP, REACH, LINE, DRIFT, ROW_GAP = 18, 220, 3, 12, 65


def right_labels(widgets: DataFrame, words: DataFrame, gap: int = GAP, reach: int = REACH, line: int = LINE) -> DataFrame:
    """(doc, widget, label): the words right of each widget on its line, up to the first gap wider than ``gap``.

    Widgets are (doc, widget, x1, y), words (doc, x0, x1, y, text). Both meet in strips of two line heights, a widget in
    its strip and the two beside it, so the join is on equal keys and no page is compared word by word.
    """
    strip = lambda y: F.floor(y / (2 * line)).cast("long")
    at = widgets.select("doc", "widget", F.col("x1").alias("w_x"), F.col("y").alias("w_y"), F.explode(F.array(strip(F.col("y")) - 1, strip(F.col("y")), strip(F.col("y")) + 1)).alias("strip"))
    near = at.join(words.withColumn("strip", strip(F.col("y"))), ["doc", "strip"]).filter((F.abs(F.col("y") - F.col("w_y")) <= line) & (F.col("x0") >= F.col("w_x")) & (F.col("x0") - F.col("w_x") <= reach))
    w = W.partitionBy("doc", "widget").orderBy("x0", "x1", "text")
    end = F.coalesce(F.max("x1").over(w.rowsBetween(W.unboundedPreceding, -1)), F.col("w_x"))
    run = near.withColumn("g_wide", (F.col("x0") - end > gap).cast("int"))
    run = run.withColumn("g_breaks", F.sum("g_wide").over(w.rowsBetween(W.unboundedPreceding, 0))).filter("g_breaks = 0")
    words_ = F.array_sort(F.collect_list(F.struct("x0", "x1", "text")))
    return run.groupBy("doc", "widget").agg(F.array_join(F.transform(words_, lambda x: x["text"]), " ").alias("label"))


def matrices(rows: DataFrame, drift: int = DRIFT, gap: int = ROW_GAP) -> DataFrame:
    """(doc, first_y, n_rows, options): runs of two or more rows (doc, y, x, options) of as many options at nearly the same place.

    Rows at one place are taken by their options, and equal rows are in one run, so that results don't depend on the order of rows.
    A row without a place or options comes last at its place, is in no run and ends the one before it.
    """
    w = W.partitionBy("doc").orderBy(*[F.asc_nulls_last(c) for c in ("y", "x", "options")])
    same = (F.col("options") == F.lag("options").over(w)) & (F.abs(F.col("x") - F.lag("x").over(w)) <= drift) & (F.col("y") - F.lag("y").over(w) <= gap)
    r = rows.withColumn("m_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    r = r.withColumn("m_id", F.sum("m_new").over(w.rangeBetween(W.unboundedPreceding, 0))).dropna(subset=["y", "x", "options"])
    return r.groupBy("doc", "m_id").agg(F.min("y").alias("first_y"), F.count("*").alias("n_rows"), F.first("options").alias("options")).filter("n_rows >= 2").drop("m_id")


def reading_order(blocks: DataFrame, boxes: DataFrame) -> DataFrame:
    """Blocks (doc, block, x0, y0, x1, y1) outside of all boxes (doc, x0, y0, x1, y1) by their centres, numbered by (y, x)."""
    t = boxes.select("doc", *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = (blocks["doc"] == t["doc"]) & cx.between(F.col("b_x0"), F.col("b_x1")) & cy.between(F.col("b_y0"), F.col("b_y1"))
    return blocks.join(t, inside, "left_anti").withColumn("n", F.row_number().over(W.partitionBy("doc").orderBy("y0", "x0", "block")))
