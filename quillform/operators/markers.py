"""Check boxes that stand alone in a narrow cell, with their option in the next cell.

``records``: one row per paragraph, doc, block, table_index (null outside tables), row_index, start, k (its place in the cell),
text, width (declared, or null), runs, bold_runs, is_numbered, named_boxes, bare_boxes, named_legacy, bare_legacy, glyph, has_field
and has_object, as the package reader tells them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import labels
from ..functions.text import bound, casefold

#: Check marks, widths of marker cells, limits of options and groups, confidences, prompts and their labels.
CHECKS = "✓|✔|√"
WIDTH_MOST, WIDTH_SHARE = 1800, 3
OPTION_MOST, GROUP_MOST, LEAD_MOST, PROMPT_MOST, SECTION_MOST = 360, 8, 180, 110, 190
STRUCTURAL, INFERRED = 0.93, 0.89
PROMPT = r"(?i)(?:seguinte|seguintes)\s+(ocorr[eê]ncias?|situa[cç][aã]o(?:ões)?|condi[cç][aã]o(?:ões)?|alternativas?|op[cç][aã]o(?:ões)?)\s*:?\s*$"
PROMPTS = {
    "ocorrência": "Ocorrência verificada", "ocorrências": "Ocorrências verificadas", "situacao": "Situação verificada", "situação": "Situação verificada", "situações": "Situações verificadas",
    "condição": "Condição verificada", "condições": "Condições verificadas", "alternativa": "Alternativa", "alternativas": "Alternativas", "opção": "Opção", "opções": "Opções",
}
NO_PROMPT = "Ocorrência verificada"

_CELL = ["doc", "table_index", "row_index", "start"]


def alone(text: Column, pattern: str) -> Column:
    """Whether a text is one match of a pattern and white space."""
    return text.rlike(rf"(?U)^\s*(?:{pattern})\s*$") & (F.regexp_count(text, F.lit(pattern)) == 1)


def option_text(lines: Column) -> Column:
    """The option that a cell's paragraphs spell: joined by dashes up to a follow-up prompt, without places to fill in, cut at 360."""
    said = F.filter(F.transform(lines, labels.space), lambda x: x != "")
    upto = lambda s: F.array_position(F.transform(s, lambda x: x.rlike(labels.FOLLOW_UP)), True).cast("int")
    before = bound(said, lambda s: bound(upto(s), lambda n: F.slice(s, F.lit(1), F.when(n > 0, n - 1).otherwise(F.size(s)))))
    whole = F.array_join(F.filter(before, lambda x: ~labels.has_fill(x)), " — ")
    return bound(whole, lambda x: F.when(F.char_length(x) > OPTION_MOST, F.concat(F.rtrim(F.left(x, F.lit(OPTION_MOST - 3)), F.lit(" ,;:-")), F.lit("…"))).otherwise(x))


def marker_cells(records: DataFrame) -> DataFrame:
    """One row per cell: the paragraph ``at`` which a lone marker stands, its ``mode`` (paragraph or text_span) and its span in the
    text, or nulls; whether the cell is ``blank`` (no text, no object); its ``lines``, and whether they look like an option.

    The first paragraph with a check box control decides: a named one is a field already and no marker. Then the only text counts,
    a box or a check mark; then the first symbol or drawing of a paragraph without text.
    """
    said = labels.space(F.col("text"))
    r = records.filter("table_index IS NOT NULL").withColumn("said", said)
    named = (F.col("named_boxes") > 0) | ((F.col("bare_boxes") != 1) & (F.col("named_legacy") > 0))
    decides = named | (F.col("bare_boxes") == 1) | (F.col("bare_legacy") == 1)
    first = lambda when, *what: F.min(F.when(when, F.struct("k", *what)))
    wide = F.char_length(F.regexp_extract("lead.text", f"({labels.BOX}|{CHECKS})", 1))
    lead = first(F.col("said") != "", "said", "is_numbered", "runs", "bold_runs", "text", "has_field")
    c = r.groupBy(*_CELL).agg(
        F.min("block").alias("block"), first(decides, named.alias("named")).alias("control"), F.count(F.when(F.col("said") != "", 1)).alias("filled"),
        first((F.col("said") == "") & F.col("glyph").isNotNull(), "glyph").alias("drawn"), (~F.bool_or(F.col("has_object") | (F.col("said") != ""))).alias("blank"), F.min_by("width", "k").alias("width"), F.min("k").alias("first"),
        F.transform(F.sort_array(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]).alias("lines"), lead.alias("lead"),
    )
    # A single text with a tag or a control in it settles the cell; one that is a box or a check mark is a marker.
    lone = F.col("filled") == 1
    settled = lone & (F.col("lead.text").rlike(labels.TAG) | F.col("lead.has_field"))
    spot = lambda p: F.when(alone(F.col("lead.text"), p), F.regexp_instr("lead.text", F.lit(p)))
    at = F.when(lone & ~settled, F.coalesce(spot(labels.BOX), spot(CHECKS)) - 1)
    none = F.lit(None).cast("int")
    place = lambda at, mode, begin, end: F.struct(at.alias("at"), F.lit(mode).alias("mode"), begin.alias("begin"), end.alias("end"))
    drawn = F.when(~settled & F.col("drawn").isNotNull(), place(F.col("drawn.k"), "paragraph", none, none))
    text = bound(at, lambda begin: F.when(begin.isNotNull(), place(F.col("lead.k"), "text_span", begin, begin + wide)).otherwise(drawn))
    mark = F.when(F.col("control").isNotNull(), F.when(~F.col("control.named"), place(F.col("control.k"), "paragraph", none, none))).otherwise(text)
    bold = (F.char_length("lead.said") <= LEAD_MOST) & (F.col("lead.runs") > 0) & (F.col("lead.bold_runs") == F.col("lead.runs"))
    like = F.coalesce(F.col("lead.said").rlike(r"^\d{1,3}[.)]\s*\S") | F.col("lead.is_numbered") | bold, F.lit(False))
    return c.select(*_CELL, "block", mark.alias("mark"), "blank", "width", "first", "lines", like.alias("like"))


def marked_rows(records: DataFrame) -> DataFrame:
    """One row per table row with a marker and an option in the cell next to it: at, mode, begin, end, option.

    Where another row of the table has a marker, an empty cell of that column counts as one (``inferred_blank``), if it is narrow
    (1,800 units and a third of its neighbour at most, where both widths are known) and what stands beside it looks like an option.
    """
    row = W.partitionBy("doc", "table_index", "row_index").orderBy("start")
    c = marker_cells(records)
    beside = lambda n: F.when(F.lead("start").over(row) == F.col("start") + 1, F.lead(n).over(row))
    c = c.withColumn("beside", beside("lines")).withColumn("looks", beside("like")).withColumn("room", beside("width"))
    # Only a marker or a blank cell can have an option beside it; its text is made once for each of these.
    c = c.filter("beside IS NOT NULL AND (mark IS NOT NULL OR blank)").withColumn("says", F.explode(F.array(option_text(F.col("beside"))))).filter("says <> ''").drop("beside", "lines")
    structural = F.col("mark").isNotNull()
    least = F.min(F.when(structural, F.col("start"))).over(W.partitionBy("doc", "table_index", "row_index"))
    c = c.withColumn("chosen", least)
    # Columns in which some row has its marker: at most as many as the grid has.
    c = c.withColumn("columns", F.collect_set(F.when(F.col("start") == F.col("chosen"), F.col("start"))).over(W.partitionBy("doc", "table_index")))
    narrow = ~F.coalesce((F.col("width") > WIDTH_MOST) | (F.col("width") * WIDTH_SHARE > F.col("room")), F.lit(False)) | F.col("room").isNull()
    guessed = F.col("chosen").isNull() & F.col("blank") & F.array_contains("columns", F.col("start")) & F.col("looks") & narrow
    none = F.lit(None).cast("int")
    found = F.when(F.col("start") == F.col("chosen"), F.col("mark")).when(guessed, F.struct(F.col("first").alias("at"), F.lit("inferred_blank").alias("mode"), none.alias("begin"), none.alias("end")))
    c = c.withColumn("found", found).filter("found IS NOT NULL")
    c = c.withColumn("n", F.row_number().over(row)).filter("n = 1")
    return c.select("doc", "block", "table_index", "row_index", "start", "found.at", "found.mode", "found.begin", "found.end", F.col("says").alias("option"))


def prompts(records: DataFrame, groups: DataFrame) -> DataFrame:
    """``groups`` (doc, block and more) with ``prompt``: what a group of boxes in a block is asked about, by the blocks before it.

    The nearest text before that asks for one of known things, has a number or ends in a colon names it; prose of more than 110
    characters ends the search, and then the latest numbered or colon title holds; null where nothing is found.
    """
    said = F.col("said")
    known = F.create_map(*[F.lit(x) for pair in PROMPTS.items() for x in pair])
    # The pattern runs on texts that hold its first word; a section's title is any short text with a number in front or a colon behind.
    asked = F.when(F.contains(F.lower(said), F.lit("seguinte")), F.regexp_extract(said, PROMPT, 1)).otherwise("")
    number = said.rlike(r"^\d") & (F.char_length(said) <= SECTION_MOST)
    told = lambda a: F.when(a != "", F.coalesce(known[F.replace(casefold(a), F.lit("ocorrencia"), F.lit("ocorrência"))], labels.clean(a)))
    label = bound(asked, told)
    label = F.when(asked != "", label).when(number, labels.clean(said)).when(said.rlike("[:：]$") & (F.char_length(said) <= PROMPT_MOST), labels.clean(said)).when(F.char_length(said) > PROMPT_MOST, "")
    title = F.when(number | ((said.rlike(r"^\d") | said.endswith(":")) & labels.is_section(said)), labels.clean(said))
    place = F.struct(F.coalesce("row_index", F.lit(-1)).alias("r"), F.coalesce("start", F.lit(-1)).alias("s"), "k")
    # Few texts name or title anything; only these are gathered, and the groups stand among them in the order of blocks.
    r = records.withColumn("said", F.explode(F.array(labels.space(F.col("text")))))
    r = r.filter(said.rlike("^\\d|[:：]$") | (F.char_length(said) > PROMPT_MOST) | F.contains(F.lower(said), F.lit("seguinte")))
    blocks = r.select("doc", "block", place.alias("p"), label.alias("l"), title.alias("t")).groupBy("doc", "block").agg(F.max(F.when(F.col("l").isNotNull(), F.struct("p", "l")))["l"].alias("label"), F.max(F.when(F.col("t").isNotNull(), F.struct("p", "t")))["t"].alias("title"))
    of = blocks.select("doc", "block", "label", "title").unionByName(groups.select("doc", "block", F.struct(*groups.columns).alias("group")), allowMissingColumns=True)
    before = W.partitionBy("doc").orderBy("block").rangeBetween(W.unboundedPreceding, -1)
    last = lambda n: F.last(n, ignorenulls=True).over(before)
    return of.withColumn("prompt", F.coalesce(F.nullif(last("label"), F.lit("")), F.nullif(last("title"), F.lit("")))).filter("group IS NOT NULL").select("group.*", "prompt")


def marker_groups(records: DataFrame) -> DataFrame:
    """Groups of two or more rows after each other with markers: label, options, modes, places and confidence.

    A group takes its first eight rows. ``inferred`` counts the blank markers; with one the group is less sure.
    """
    island = F.col("row_index") - F.row_number().over(W.partitionBy("doc", "table_index").orderBy("row_index"))
    rows = marked_rows(records).withColumn("island", island)
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("doc", "table_index", "island").orderBy("row_index"))).filter(F.col("n") <= GROUP_MOST)
    place = F.struct("row_index", "start", "at", "mode", "begin", "end", "option")
    g = rows.groupBy("doc", "block", "table_index", "island").agg(F.array_sort(F.collect_list(place)).alias("places")).filter(F.size("places") >= 2)
    g = prompts(records, g)
    inferred = F.size(F.filter("places", lambda p: p["mode"] == "inferred_blank"))
    return g.select(
        "doc", "table_index", F.get("places", F.lit(0))["row_index"].alias("first_row"), F.coalesce("prompt", F.lit(NO_PROMPT)).alias("label"), F.transform("places", lambda p: p["option"]).alias("options"),
        F.transform("places", lambda p: p["mode"]).alias("modes"), "places", inferred.alias("inferred"), F.when(inferred > 0, INFERRED).otherwise(STRUCTURAL).alias("confidence"),
    )
