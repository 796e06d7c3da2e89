"""Fields that a document holds: repeated rows with their columns, native controls, tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import labels
from ..functions.text import casefold
from ..functions.types import guess
from . import tags

#: The id and label of a column of row numbers.
NUMBER_COLUMN = ("item", "Item")


def _distinct_texts(pairs) -> F.Column:
    """Texts of an array of (order, text) by order, each once."""
    return F.array_distinct(F.transform(F.array_sort(pairs), lambda x: x["text"]))


def header_labels(cells: DataFrame, headers: DataFrame, columns: str = "columns") -> DataFrame:
    """(doc, table_index, row_index, cell_index, header): the texts above each cell.

    ``cells`` and ``headers`` have start and span, ``headers`` also text and the table's number of ``columns``; cells over
    the full width are titles. Texts of a row that overlap a cell are joined by `` / ``, the last two different rows by `` — ``.
    Cells meet those above them in the grid columns that both cover.
    """
    cover = lambda df: df.withColumn("at", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("span") - 1)))
    key = ["doc", "table_index"]
    text = labels.space(F.col("text"))
    above = cover(headers.filter((F.col("span") < F.col(columns)) & (text != ""))).select(*key, "at", F.col("row_index").alias("h_row"), F.col("start").alias("h_start"), text.alias("h_text"))
    pairs = cover(cells).join(above, [*key, "at"]).filter("h_row < row_index")
    rows = pairs.groupBy(*key, "row_index", "cell_index", "h_row").agg(F.array_join(_distinct_texts(F.collect_set(F.struct(F.col("h_start").alias("order"), F.col("h_text").alias("text")))), " / ").alias("said"))
    every = rows.groupBy(*key, "row_index", "cell_index").agg(_distinct_texts(F.collect_list(F.struct(F.col("h_row").alias("order"), F.col("said").alias("text")))).alias("said"))
    last = F.slice("said", F.greatest(F.lit(1), F.size("said") - 1), F.lit(2))
    return every.select(*key, "row_index", "cell_index", F.array_join(last, " — ").alias("header"))


def repeat_rows(cells: DataFrame) -> DataFrame:
    """(doc, table_id, problem, columns): rows with a repeat tag as table fields, or what is wrong with them.

    ``cells`` is (doc, table_index, row_index, cell_index, start, span, v_merge, text). A row repeats by one id; its cells
    aren't merged downwards; its tags are ``id.column`` without further dots, each once; one column at least. A column's
    label is the text before its tag, else the headers above, else made from its id; its type is typed by its tag or
    guessed from itself.
    """
    key = ["doc", "table_index", "row_index"]
    low = casefold(F.col("text"))
    grid = cells.withColumn("columns", F.max(F.col("start") + F.col("span")).over(W.partitionBy("doc", "table_index")))
    grid = grid.withColumn("repeats", F.filter(F.regexp_extract_all("text", F.lit(labels.TAG), F.lit(1)), lambda t: F.startswith(casefold(F.trim(t)), F.lit("repeat:"))))
    ids = F.transform("repeats", lambda t: F.trim(F.substring(F.trim(t), 8, 1 << 20)))
    rows = grid.groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_list(ids))).alias("ids"), F.bool_or(F.col("v_merge").isNotNull()).alias("merged")).filter("size(ids) > 0")
    marked = grid.join(rows, key)
    head = header_labels(marked.drop("ids", "merged"), grid)
    tokens = marked.select(*key, "cell_index", "text", "ids", F.posexplode(F.regexp_extract_all("text", F.lit(labels.TAG), F.lit(1))).alias("i", "token")).withColumn("p", tags.parse(F.col("token"))).filter("p.kind <> 'repeat'")
    tokens = tokens.join(head, [*key, "cell_index"], "left")
    table_id, number = F.get("ids", F.lit(0)), F.col("p.kind") == "row_number"
    tokens = tokens.withColumn("inside", F.startswith("p.field_id", F.concat(table_id, F.lit(".")))).withColumn("name", F.when(number, NUMBER_COLUMN[0]).otherwise(F.trim(F.substring(F.col("p.field_id"), F.char_length(table_id) + 2, F.lit(1 << 20)))))
    # A row number counts once however often it stands.
    tokens = tokens.withColumn("n", F.row_number().over(W.partitionBy(*key, "name").orderBy("cell_index", "i"))).filter(~number | (F.col("n") == 1))
    problem = F.when(~number & ~F.col("inside"), "outside the table").when(~number & ((F.col("name") == "") | F.contains("name", F.lit("."))), "not a plain column").when(F.col("n") > 1, "repeated column")
    before = labels.before_tag(F.left("text", F.position(F.concat(F.lit("{{"), F.col("token"), F.lit("}}")), F.col("text")) - 1))
    tokens = tokens.withColumn("problem", problem).withColumn("before", before)
    label = F.when(number, F.coalesce("header", F.lit(NUMBER_COLUMN[1]))).when(F.col("before") != "", F.col("before")).otherwise(F.coalesce("header", labels.from_id(F.col("name"))))
    tokens = tokens.withColumn("label", label)
    kind = F.when(number, "auto_number").when(F.col("p.tag_type").isin(*tags.PREFIXES), F.col("p.type")).otherwise(guess(F.concat_ws(" ", "name", "label")))
    tokens = tokens.withColumn("type", kind)
    column = F.struct("cell_index", "i", F.struct(F.col("name").alias("id"), "label", "type", (~F.col("type").isin("auto_number", "checkbox")).alias("required"), F.when(number, F.trim("token")).otherwise(F.col("p.field_id")).alias("marker"), F.col("p.options").alias("options")).alias("c"))
    first = F.min(F.when(F.col("problem").isNotNull(), F.struct("cell_index", "i", "problem")))
    made = tokens.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(column)), lambda x: x["c"]).alias("columns"), first.alias("first"))
    out = rows.join(made, key, "left")
    wrong = F.when(F.col("merged"), "merged cell").when(F.size("ids") > 1, "several tables").when(F.col("first").isNotNull(), F.col("first.problem")).when(F.col("columns").isNull(), "no columns")
    return out.select("doc", F.get("ids", F.lit(0)).alias("table_id"), wrong.alias("problem"), F.when(wrong.isNull(), F.col("columns")).alias("columns"))


def control_fields(records: DataFrame) -> DataFrame:
    """(doc, field_id, type, options, needs_review, ordinal): native controls and named legacy boxes as fields, each id once.

    ``records`` has control_id, control_kind, control_options and legacy_box. A control's id may be a tag's inside. Lists
    without options, and controls without any id, are for a person to look at.
    """
    kind = F.coalesce("control_kind", F.when(F.col("legacy_box").isNotNull(), "checkbox"))
    name = F.coalesce(F.col("control_id"), F.col("legacy_box"), F.lit(""))
    rows = records.withColumn("k", kind).filter(F.col("k").isNotNull()).withColumn("field_id", tags.parse(name)["field_id"])
    usable = F.filter(F.coalesce("control_options", F.expr("cast(array() as array<string>)")), lambda x: ~x.rlike(labels.WHOLE_PROMPT))
    rows = rows.withColumn("options", F.when(F.col("k") == "dropdown", usable).otherwise(F.expr("cast(array() as array<string>)")))
    first = F.row_number().over(W.partitionBy("doc", "field_id").orderBy("ordinal"))
    rows = rows.withColumn("n", first).filter((F.col("n") == 1) | (F.col("field_id") == ""))
    review = (F.col("field_id") == "") | ((F.col("k") == "dropdown") & (F.size("options") == 0))
    return rows.select("doc", "field_id", F.col("k").alias("type"), "options", review.alias("needs_review"), "ordinal")


def tag_places(records: DataFrame) -> DataFrame:
    """(doc, field_id, parts): in which parts each tag or control of a document stands, by display name."""
    found = tags.tokens(records.select("doc", "story", "text")).select("doc", "story", tags.parse(F.col("token"))["field_id"].alias("field_id"))
    native = records.filter("control_id IS NOT NULL").select("doc", "story", tags.parse(F.col("control_id"))["field_id"].alias("field_id"))
    named = found.union(native).filter("field_id <> ''").withColumn("part", labels.part_name(F.concat("story", F.lit(".xml"))))
    return named.groupBy("doc", "field_id").agg(F.array_sort(F.collect_set("part")).alias("parts"))
