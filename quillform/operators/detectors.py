"""The detectors that propose fields for single records, and their order.

Records are rows (doc, ordinal, text) with, where the table has them, story, table_index, row_index, cell_index, section,
context (a label worked out from the surroundings), is_red and has_marker (a tag or a control, which no detector touches).
Every detector gives rows of ``COLUMNS``; start and end are null where the whole record is meant.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import labels
from ..functions.text import detection_slug
from ..functions.types import suggest
from . import detect

COLUMNS = ("doc", "ordinal", "label", "type", "confidence", "source", "preview", "start", "end")
_KINDS = {"story": ("string", "body"), "table_index": ("int", None), "row_index": ("int", None), "cell_index": ("int", None), "section": ("string", None), "context": ("string", None), "is_red": ("boolean", False), "has_marker": ("boolean", False)}
#: Labels (as slugs) whose values are examples; of neighbours too, by what the value must look like.
SAMPLES = ("pais", "nacionalidade", "placa", "setor_responsavel")
EMAILS, PHONES = ("email", "e_mail", "correio_eletronico"), ("telefone", "celular", "fone")
PLAIN_SAMPLES = ("unidade", "lotacao", "setor", "municipio", "cidade", "pais", "nacionalidade")
#: What every mask holds: texts without it need none of their patterns.
MASK_SIGN = r"[{_@$]|[Xx]{4}|000"
#: Sections whose prose is an answer, and beginnings of prose that is none.
RESPONSE = r"(?i)\b(?:justificativa|fundamenta[cç][aã]o|descri[cç][aã]o|detalhamento|necessidade|motiva[cç][aã]o|objeto|especifica[cç][aã]o|observa[cç][aã]o|provid[eê]ncia|parecer|an[aá]lise|considera[cç][oõ]es|informa[cç][oõ]es)\b"
STATIC = r"(?i)^\s*(?:texto\s+fixo|nota|aten[cç][aã]o|aviso|instru[cç][aã]o|orienta[cç][aã]o|observa[cç][aã]o\s+fixa|rodap[eé])\s*[:\-]"


def whole(records: DataFrame) -> DataFrame:
    """Records with all columns that detectors read, and ``t``, their text with single blanks."""
    rows = records
    for name, (kind, value) in _KINDS.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(value).cast(kind))
    return rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("t", labels.space(F.col("text")))


def _once(rows: DataFrame, **values: Column) -> DataFrame:
    """Rows with values that are worked out once a row: they come out of a generator, which filters and projections aren't merged through."""
    return rows.select(*[c for c in rows.columns if c not in values], F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))


def _out(rows: DataFrame, label: Column, kind: Column, confidence: Column, source: str, preview: Column, start: Column | None = None, end: Column | None = None) -> DataFrame:
    place = lambda x: (x if x is not None else F.lit(None)).cast("int")
    return rows.select("doc", "ordinal", label.alias("label"), kind.alias("type"), confidence.cast("double").alias("confidence"), F.lit(source).alias("source"), preview.alias("preview"), place(start).alias("start"), place(end).alias("end"))


def _free(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.coalesce("has_marker", F.lit(False)) & ~F.col("text").rlike(labels.TAG))


def standalone_boxes(records: DataFrame) -> DataFrame:
    """One box in a line with words: what stands before and behind it is the label."""
    rows = _free(whole(records).filter(F.col("text").rlike(labels.BOX))).filter(F.regexp_count("text", F.lit(labels.BOX)) == 1)
    found = F.regexp_extract("text", labels.BOX, 0)
    side = lambda k: F.btrim(labels.space(F.element_at(F.split("text", labels.BOX, -1), k)), F.lit(" :：;|–—-"))
    rows = _once(rows, b=side(1), a=side(2)).filter((F.char_length("b") <= 240) & (F.char_length("a") <= 160) & (F.char_length(F.when(F.col("a") != "", F.col("a")).otherwise(F.col("b"))) >= 2))
    both = F.concat(F.rtrim("b", F.lit(".;:")), F.lit(" — "), F.col("a"))
    label = labels.clean(F.when((F.col("b") != "") & (F.col("a") != ""), both).when(F.col("a") != "", F.col("a")).otherwise(F.col("b")))
    start = F.char_length(F.element_at(F.split("text", labels.BOX, -1), 1))
    return _out(_once(rows, l=label).filter("l <> ''"), F.col("l"), F.lit("checkbox"), F.lit(0.92), "checkbox_single", F.col("t"), start, start + F.char_length(found))


def blank_follow_ups(records: DataFrame) -> DataFrame:
    """The blank paragraph right after a prompt for observations in the same cell."""
    cell = W.partitionBy("doc", "table_index", "row_index", "cell_index").orderBy("ordinal")
    rows = whole(records).filter("story = 'body' AND table_index IS NOT NULL")
    rows = rows.withColumn("prompt", F.lag("text").over(cell)).filter((F.col("t") == "") & F.col("prompt").rlike(labels.FOLLOW_UP))
    return _out(rows, labels.clean(F.col("prompt")), F.lit("multiline"), F.lit(0.82), "empty_cell", labels.space(F.col("prompt")))


def dropdown_prompts(records: DataFrame) -> DataFrame:
    """A prompt to choose at the end of a text."""
    prompt = F.regexp_extract("text", labels.PROMPT, 0)
    rows = _free(whole(records)).filter(F.col("text").rlike(labels.PROMPT))
    start = F.char_length("text") - F.char_length(prompt)
    rows = rows.withColumn("near", labels.local(F.left("text", start)))
    rows = rows.withColumn("l", F.when(F.col("near") != "", F.col("near")).otherwise(F.coalesce("context", F.lit(""))))
    return _out(rows, F.when(F.col("l") != "", F.col("l")).otherwise("Selecione uma opção"), F.lit("dropdown"), F.when(F.col("l") != "", 0.82).otherwise(0.70), "dropdown_prompt", prompt, start, F.char_length("text"))


def _after_colon(rows: DataFrame) -> DataFrame:
    """Texts with a colon: ``l`` before it, ``v`` behind it without blanks in front, ``v_start`` where that begins."""
    rows = _free(rows.filter(F.contains("text", F.lit(":"))))
    at = F.instr("text", ":")
    tail = F.substring("text", at + 1, 1 << 20)
    bare = F.regexp_replace(tail, r"(?U)^\s+", "")
    rows = _once(rows, l=labels.clean(F.left("text", at - 1)), v=bare)
    return rows.withColumn("v_start", F.char_length("text") - F.char_length("v"))


def labelled_samples(records: DataFrame) -> DataFrame:
    """Short example values behind a few labels."""
    value = F.col("value")
    rows = _after_colon(whole(records)).filter(detection_slug(F.col("l")).isin(*SAMPLES))
    rows = _once(rows, value=labels.space(F.col("v"))).filter(F.char_length(value).between(1, 80))
    rows = rows.filter(~value.rlike(labels.INSTRUCTION) & ~value.rlike(labels.WHOLE_PROMPT) & ~reduce(lambda a, b: a | b, [value.rlike(p) for p in (labels.BOX, labels.X_MASK, labels.UNDERSCORE_MASK, labels.PHONE_MASK, labels.CPF_MASK, labels.CURRENCY_MASK, labels.EMAIL_MASK)]))
    return _out(rows, F.col("l"), suggest(F.col("l")), F.lit(0.86), "sample_value", value, F.col("v_start"), F.char_length("text"))


def labelled_instructions(records: DataFrame) -> DataFrame:
    """An instruction of 12 to 800 characters behind a label; long ones ask for long texts."""
    rows = _once(_after_colon(whole(records)).filter(F.col("v").rlike(labels.INSTRUCTION)), n=F.char_length(labels.space(F.col("v"))))
    rows = _once(rows.filter(F.col("n").between(12, 800) & labels.reasonable(F.col("l"), 120)), kind=suggest(F.col("l")))
    kind = F.when((F.col("kind") == "text") & (F.col("n") >= 70), "multiline").otherwise(F.col("kind"))
    return _out(rows, F.col("l"), kind, F.when(F.col("is_red"), 0.90).otherwise(0.82), "instruction", F.col("v"), F.col("v_start"), F.char_length("text"))


def inline_masks(records: DataFrame) -> DataFrame:
    """Masks in a text, each with the label before it on its line; single braces need a label or a structured name."""
    signed = whole(records).filter(F.col("text").rlike(MASK_SIGN))
    rows = _free(signed).withColumn("m", detect.masks(F.col("text"))).select("*", F.posexplode("m").alias("i", "s"))
    last = F.when(F.col("i") > 0, F.get("m", F.col("i") - 1)["end"]).otherwise(0)
    before = F.substring("text", last + 1, F.col("s.start") - last)
    line = F.element_at(F.split("before", "\n", -1), -1)
    rows = _once(rows, before=before)
    rows = _once(rows, near=labels.local(line), wide=labels.local(F.col("before")))
    label = F.when(F.col("near") != "", F.col("near")).when(F.col("wide") != "", F.col("wide")).otherwise(F.coalesce("context", F.lit("")))
    value = F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    rows = _once(rows, l=label, v=value).withColumn("inner", F.btrim("v", F.lit("{}"))).withColumn("braces", F.col("s.kind") == "braces")
    alone = F.col("table_index").isNotNull() & (F.col("t") == labels.space(F.col("v")))
    told = (F.col("l") != "") & (F.col("before").rlike(r"[:：]\s*$") | alone)
    rows = rows.filter(~F.col("braces") | told | F.col("inner").rlike("[._-]"))
    shown = F.when(F.col("l") != "", F.col("l")).when(F.col("s.kind") == "currency", "Valor").when(F.col("braces"), labels.humanize(labels.legacy_id(F.col("inner")))).otherwise(F.concat(F.lit("Campo "), (F.col("ordinal") + 1).cast("string")))
    sure = F.when(F.col("braces"), F.when(F.col("l") != "", 0.98).otherwise(0.82)).otherwise(F.when((F.col("l") != "") | (F.col("s.kind") == "currency"), 0.91).otherwise(0.74))
    rows = _once(rows, shown=shown)
    out = _out(rows, F.col("shown"), labels.mask_type(F.col("v"), F.col("shown")), sure, "inline_placeholder", F.col("v"), F.col("s.start"), F.col("s.end"))
    return out.withColumn("source", F.when(F.startswith("preview", F.lit("{")), "legacy_placeholder").otherwise(F.col("source")))


def instruction_paragraphs(records: DataFrame) -> DataFrame:
    """A red or table paragraph of 12 to 800 characters that begins with an instruction."""
    t = F.col("t")
    rows = whole(records).filter((F.col("is_red") | F.col("table_index").isNotNull()) & (F.char_length("text") >= 12))
    rows = _once(rows, t=t).filter(F.char_length(t).between(12, 800) & t.rlike(labels.INSTRUCTION))
    label = F.coalesce("context", F.lit(""))
    kind = F.when(F.char_length(t) >= 70, "multiline").otherwise(suggest(F.when(label != "", label).otherwise(t)))
    return _out(rows, F.when(label != "", label).otherwise(labels.instruction(t)), kind, F.when(F.col("is_red"), 0.84).otherwise(0.76), "instruction", t)


_ROW = ["doc", "table_index", "row_index"]


def _row_texts(records: DataFrame) -> DataFrame:
    """(doc, table_index, row_index, cells): the texts of a table row's cells, in order."""
    cell = records.filter("table_index IS NOT NULL").repartition(*_ROW).groupBy("doc", "table_index", "row_index", "cell_index").agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("p"))
    one = cell.select("doc", "table_index", "row_index", F.struct("cell_index", labels.space(F.array_join(F.transform("p", lambda x: x["text"]), " ")).alias("t"), F.size("p").alias("paragraphs"), F.size(F.filter("p", lambda x: labels.space(x["text"]) != "")).alias("said"), F.col("p")[0]["ordinal"].alias("first")).alias("c"))
    return one.groupBy("doc", "table_index", "row_index").agg(F.array_sort(F.collect_list("c")).alias("cells"))


def _beside(records: DataFrame, rows: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``records`` with what ``rows`` say, by shuffle: rows grow with the records, but where those are exploded from a small table
    the planner takes them for small and would send them all to the driver to broadcast them."""
    return records.join(rows.hint("merge"), keys, how)


def prefilled_prose(records: DataFrame) -> DataFrame:
    """Prose of seven words and more that is an answer: in a section that asks for one, or alone in a row below a header or title."""
    r = whole(records)
    above = W.partitionBy("doc", "table_index").orderBy("row_index").rowsBetween(W.unboundedPreceding, -1)
    said = F.col("said")
    header = (F.size(said) >= 2) & F.forall(said, lambda x: F.char_length(x) <= 90)
    title = (F.size(said) == 1) & labels.is_section(F.get(said, F.lit(0)))
    rows = _once(_row_texts(r), said=F.filter(F.transform("cells", lambda c: c["t"]), lambda x: x != ""))
    rows = rows.withColumn("kind", F.when(header, F.struct(F.lit("").alias("t"))).when(title, F.struct(labels.clean(F.get(said, F.lit(0))).alias("t"))))
    rows = rows.withColumn("over", F.last("kind", ignorenulls=True).over(above)).select(*_ROW, F.size("cells").alias("n_cells"), "over")
    t = F.col("t")
    static = labels.is_section(t) | t.rlike(STATIC) | t.rlike(labels.BOX) | t.rlike(labels.WHOLE_PROMPT) | labels.is_fill(t)
    prose = F.char_length(t).between(45, 2200) & (F.size(F.split(t, " ")) >= 7) & (F.regexp_count(t, F.lit(r"\p{L}")) >= 24) & ~static & (F.col("story") == "body")
    # A text is no shorter than with single blanks.
    r = _once(_free(r.filter((F.col("story") == "body") & (F.char_length("text") >= 45))), t=t).filter(prose)
    section = F.col("titled")
    r = _beside(_once(r, titled=labels.clean(F.col("section"))), rows, _ROW, "left")
    asked = section.rlike(RESPONSE)
    row_answer = (F.col("n_cells") == 1) & ((section != "") | F.col("over").isNotNull())
    r = r.withColumn("asked", asked).filter(F.col("asked") | F.coalesce(row_answer, F.lit(False)))
    label = labels.clean(F.when(section != "", section).when(F.col("over.t") != "", F.col("over.t")).otherwise(F.coalesce("context", F.lit(""))))
    r = _once(r, l=label)
    return _out(r, F.when(labels.reasonable(F.col("l"), 180), F.col("l")).otherwise("Texto editável"), F.lit("multiline"), F.when(F.col("asked"), 0.90).otherwise(0.82), "prefilled_text", t)


def _in_cells(records: DataFrame) -> DataFrame:
    """Records in tables with ``l``, what a label of their text is."""
    rows = whole(records).filter(F.col("table_index").isNotNull() & (F.col("text") != ""))
    return _once(_once(_free(rows), t=F.col("t")).filter("t <> ''"), l=labels.clean(F.col("t")))


def _neighbours(records: DataFrame, mine: DataFrame) -> DataFrame:
    """Those of ``mine`` (some of the records) that are alone in their cell, with ``cells`` of their row and ``at``, their cell's place in it."""
    mine = _beside(mine, _row_texts(whole(records)), _ROW)
    at = F.array_position(F.transform("cells", lambda c: c["cell_index"]), F.col("cell_index")).cast("int") - 1
    return mine.withColumn("at", at).filter(F.get("cells", F.col("at"))["paragraphs"] == 1)


def adjacent_samples(records: DataFrame) -> DataFrame:
    """Example values in the cell after an e-mail, phone or place label; the field is in the value's record."""
    t, label, slug = F.col("t"), F.col("l"), F.col("slug")
    # No other label's value fits, so only these records look for their row.
    mine = _once(_in_cells(records), slug=detection_slug(label)).filter(slug.isin(*EMAILS, *PHONES, *PLAIN_SAMPLES)).filter(labels.reasonable(label, 100))
    rows = _once(_neighbours(records, mine), n=F.get("cells", F.col("at") + 1)).filter(F.col("n").isNotNull() & (F.col("n.said") == 1))
    v = F.col("n.t")
    fits = (
        F.when(slug.isin(*EMAILS), v.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")).when(slug.isin(*PHONES), v.rlike(r"^\(?\d{2}\)?\s*\d{4,5}\s*-\s*\d{4}$"))
        .when(slug.isin(*PLAIN_SAMPLES), (F.char_length(v) <= 60) & ~v.rlike(r"[.;]$") & (F.size(F.split(v, " ")) <= 6) & ~v.rlike(labels.BOX)).otherwise(False)
    )
    rows = rows.filter(F.char_length(v).between(1, 100) & ~labels.is_fill(v) & ~v.rlike(labels.TAG) & fits)
    found = _out(rows.withColumn("ordinal", F.col("n.first")), label, suggest(label), F.when(t.rlike("[:：]$"), 0.88).otherwise(0.85), "sample_value", v, F.lit(0), F.char_length(v))
    return found


def label_only_fields(records: DataFrame) -> DataFrame:
    """A bare label with a colon whose next cell holds text and whose row has a place to fill in elsewhere: a tag goes behind it."""
    t = F.col("t")
    mine = _in_cells(records.filter(F.contains("text", F.lit(":")))).filter(t.endswith(":")).filter(labels.reasonable(F.col("l"), 100) & ~(labels.is_section(t) & t.rlike(r"^\s*\d")))
    rows = _neighbours(records, mine)
    nxt = F.get("cells", F.col("at") + 1)["t"]
    others = F.transform(F.filter("cells", lambda c: c["cell_index"] != F.col("cell_index")), lambda c: c["t"])
    # The first neighbour that is blank or has a place to fill in decides.
    first = F.get(F.filter(others, lambda x: (x == "") | labels.has_fill(x)), F.lit(0))
    rows = rows.filter(F.coalesce((nxt != "") & ~labels.is_fill(nxt), F.lit(True)) & (first != ""))
    return _out(rows, F.col("l"), suggest(F.col("l")), F.lit(0.82), "empty_cell", F.lit("Área vazia após o rótulo"))


def blank_cells(records: DataFrame) -> DataFrame:
    """Cells without any text, with a label at their left; the field is in the cell's first record."""
    cells = _row_texts(whole(records)).select(*_ROW, F.explode("cells").alias("c")).select(*_ROW, "c.cell_index", F.col("c.t").alias("text"), F.col("c.first").alias("ordinal"))
    found = detect.empty_cells(cells, "ordinal").withColumnRenamed("confidence", "sure").dropna(subset=[*_ROW, "cell_index"])
    found = _once(found, l=labels.clean(F.col("label")))
    return _out(found, F.col("l"), suggest(F.col("l")), F.col("sure"), "empty_cell", F.lit(""))


#: The order in which detectors may claim a record; blank cells come after all others.
STAGES = (standalone_boxes, blank_follow_ups, dropdown_prompts, labelled_samples, labelled_instructions, inline_masks, instruction_paragraphs, prefilled_prose, adjacent_samples, label_only_fields, blank_cells)


def cascade(records: DataFrame) -> DataFrame:
    """All proposals, each record claimed by its first detector (which may propose several fields in it), with ``stage``."""
    found = reduce(DataFrame.unionByName, [f(records).withColumn("stage", F.lit(i + 1)) for i, f in enumerate(STAGES)])
    first = F.min("stage").over(W.partitionBy("doc", "ordinal"))
    return found.withColumn("d_first", first).filter("stage = d_first").drop("d_first")


def as_fields(candidates: DataFrame) -> DataFrame:
    """Accepted candidates (``COLUMNS``) as fields: pos, field_id (unique in the document), required, section."""
    from .records import unique_ids

    braces = labels.legacy_id(F.btrim("preview", F.lit("{}")))
    rows = candidates.withColumn("base", F.when(F.col("source") == "legacy_placeholder", braces).otherwise(labels.field_id(F.col("label")))).withColumn("at", F.coalesce("start", F.lit(-1)))
    named = unique_ids(rows, "base", ["ordinal", "at", "source"], "doc", name="field_id")
    pos = F.row_number().over(W.partitionBy("doc").orderBy("ordinal", "at", "source")) - 1
    return named.select("doc", pos.alias("pos"), "field_id", "label", "type", (F.col("type") != "checkbox").alias("required"), labels.suggest_section(F.col("field_id")).alias("section"), "confidence", "source")


def apply_spans(records: DataFrame, accepted: DataFrame) -> DataFrame:
    """Records with the tags of accepted candidates (doc, ordinal, start, end, tag) written into their texts.

    Spans are replaced from the right; a candidate without a span replaces a blank text and follows any other after a blank.
    """
    spans = accepted.groupBy("doc", "ordinal").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("start", F.lit(1 << 30)).alias("start"), "end", "tag"))).alias("a"))
    step = lambda acc, s: F.when(s["end"].isNotNull(), F.concat(F.left(acc, s["start"]), s["tag"], F.substring(acc, s["end"] + 1, 1 << 20))).when(F.trim(acc) == "", s["tag"]).otherwise(F.concat(F.rtrim(acc), F.lit(" "), s["tag"]))
    said = F.aggregate(F.reverse("a"), F.col("text"), step)
    return _beside(records, spans, ["doc", "ordinal"], "left").select(*[F.when(F.col("a").isNotNull(), said).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in records.columns])
