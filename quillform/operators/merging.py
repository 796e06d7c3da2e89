"""Inferred layout merged into the fields of a template: what a person has set stays, what was derived follows the document.

``fields`` has doc, pos, field_id, type, label, label_source, section, section_source, detection_source and the layout attributes of
``LAYOUT``; ``inferred`` has doc, field_id, section, detected_label and those attributes (``operators/inference.py``). Texts that are
empty count as not set, and so does the layout ``auto``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import labels
from ..functions.text import bound, casefold, fold

#: Attributes that a document can give a field, in groups: what a migration or a rehoming takes away, and the rest.
STALE = ("layout", "layout_group", "layout_group_label", "layout_row", "layout_row_label", "layout_column", "layout_column_index", "layout_column_span", "layout_grid_columns", "layout_order")
HEADER = "layout_row_header_label"
CHOICE = ("choice_group", "choice_required")
LAYOUT = (*STALE, HEADER, "layout_presentation", *CHOICE)
#: Sources of labels that a document may replace, sections that say nothing, sources of fields with their authority.
DERIVED = ("", "identifier", "document_context", "automatic")
EMPTY_SECTIONS = ("Dados do documento", "Informações adicionais")
ASSISTED, NATIVE = ("automatic", "assisted", "auto_detection"), ("native_pdf", "native_word", "word_control")
GRID_MOST = 12


def _low(name: str) -> Column:
    return casefold(F.trim(F.coalesce(F.col(name), F.lit(""))))


def _unset(x: Column, kind: str) -> Column:
    return x.isNull() | (x.isin("", "auto") if kind == "string" else F.lit(False))


def apply_layout(fields: DataFrame, inferred: DataFrame) -> DataFrame:
    """``fields`` with what ``inferred`` says where nothing deliberate stands, and ``origins``: where the label, the section and each layout
    attribute come from (kept, document, or none).

    A detected label replaces an empty or derived one, an inferred section an empty one or one that says nothing. A layout of the
    other table kind, made by the library before, goes first with all its places; boxes of an automatic choice that the document
    shows in a table or grid go there and stay a choice (``compact_choice``). Fields that nothing was inferred for stay.
    """
    kinds = {f.name: f.dataType.simpleString() for f in fields.schema}
    i = inferred.select(F.col("doc").alias("i_doc"), F.col("field_id").alias("i_id"), F.col("section").alias("i_section"), F.col("detected_label").alias("i_label"), *[F.col(c).alias(f"i_{c}") for c in LAYOUT])
    j = fields.join(i, fields.doc.eqNullSafe(F.col("i_doc")) & (fields.field_id == F.col("i_id")), "left")
    text = lambda n: F.trim(F.coalesce(F.col(n), F.lit("")))
    takes_label = (text("i_label") != "") & ((text("label") == "") | text("label_source").isin(*DERIVED))
    takes_section = (text("i_section") != "") & ((text("section") == "") | text("section").isin(*EMPTY_SECTIONS))
    grids = ("table", "form_grid")
    rehomed = (_low("detection_source") == "automatic") & (_low("type") == "checkbox") & (_low("layout") == "choice") & _low("i_layout").isin(*grids) & (text("i_layout_group") != "") & (text("i_layout_row") != "")
    moved = ~rehomed & _low("layout").isin(*grids) & _low("i_layout").isin(*grids) & (_low("layout") != _low("i_layout")) & F.startswith(text("layout_group"), F.lit("doc_table_"))
    j = j.withColumn("x_rehomed", rehomed).withColumn("x_moved", moved)
    own_group = F.when(text("choice_group") != "", text("choice_group")).otherwise(text("layout_group"))

    def before(c: str) -> Column:
        kept = F.col(c)
        if c in STALE:
            return F.when(F.col("x_rehomed") | F.col("x_moved"), None).otherwise(kept)
        if c == HEADER:
            return F.when(F.col("x_rehomed"), None).otherwise(kept)
        if c == "choice_group":
            return F.when(F.col("x_rehomed") & (own_group != ""), own_group).otherwise(kept)
        if c == "choice_required":
            return F.when(F.col("x_rehomed"), F.coalesce(kept, F.lit(True))).otherwise(kept)
        return kept

    values, origins = {}, {}
    for c in LAYOUT:
        old, new = before(c), F.col(f"i_{c}")
        free = _unset(old, kinds[c])
        has = ~_unset(new, "string" if kinds[c] == "string" else "")
        # What a document says about a layout may be "auto" nowhere; an empty text says nothing.
        values[c] = F.when(free & has, new).otherwise(old)
        origins[c] = F.when(free & has, "document").when(~free, "kept")
    values |= {
        "label": F.when(takes_label, text("i_label")).otherwise(F.col("label")), "label_source": F.when(takes_label, "document_context").otherwise(F.col("label_source")),
        "section": F.when(takes_section, text("i_section")).otherwise(F.col("section")), "section_source": F.when(takes_section, "document_context").otherwise(F.col("section_source")),
    }
    origins |= {"label": F.when(takes_label, "document").when(text("label") != "", "kept"), "section": F.when(takes_section, "document").when(text("section") != "", "kept")}
    told = F.map_filter(F.create_map(*[x for c, o in origins.items() for x in (F.lit(c), o)]), lambda _, v: v.isNotNull())
    return j.select(*[values.get(c, F.col(c)).alias(c) for c in fields.columns], F.col("x_rehomed").alias("compact_choice"), F.when(F.col("x_rehomed"), F.col("layout_group_label")).alias("choice_group_label"), told.alias("origins"))


def three_way(base: DataFrame, user: DataFrame, scan: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """Fields of ``scan`` with each attribute as the user left it if that differs from ``base``, else as scanned.

    ``base`` is the scan that the user's fields came from. Output: keys, attributes, ``origins`` (attribute -> user or scan) and
    ``conflicts`` (attributes that the user and the document have changed to different values). A field that the user deleted
    (in ``base``, not in ``user``) stays away; one that the scan lacks stays only if the user changed something in it, and then
    its other attributes are those of the base. So values set by hand survive any number of scans, for the next base is this scan.
    """
    side = lambda df, p: df.select(*[F.col(k).alias(f"{p}_{k}") for k in keys], F.lit(True).alias(f"{p}_is"), *[F.col(a).alias(f"{p}_{a}") for a in attributes])
    on = lambda a, b: _all([F.col(f"{a}_{k}").eqNullSafe(F.col(f"{b}_{k}")) for k in keys])
    j = side(base, "b").join(side(user, "u"), on("b", "u"), "full")
    j = j.withColumns({f"m_{k}": F.when(F.col("b_is"), F.col(f"b_{k}")).otherwise(F.col(f"u_{k}")) for k in keys}).join(side(scan, "s"), on("m", "s"), "full")
    own = {a: F.coalesce(F.col("u_is"), F.lit(False)) & ~F.when(F.col("b_is"), F.col(f"u_{a}").eqNullSafe(F.col(f"b_{a}"))).otherwise(F.col(f"u_{a}").isNull()) for a in attributes}
    changed = own[attributes[0]]
    for a in attributes[1:]:
        changed = changed | own[a]
    gone = F.col("b_is") & F.col("u_is").isNull()
    j = j.filter(~F.coalesce(gone, F.lit(False)) & (F.col("s_is").isNotNull() | changed))
    value = lambda a: F.when(own[a], F.col(f"u_{a}")).when(F.col("s_is"), F.col(f"s_{a}")).otherwise(F.col(f"b_{a}"))
    clash = [F.when(own[a] & F.col("s_is") & ~F.col(f"s_{a}").eqNullSafe(F.col(f"b_{a}")) & ~F.col(f"s_{a}").eqNullSafe(F.col(f"u_{a}")), F.lit(a)) for a in attributes]
    return j.select(
        *[F.when(F.col("s_is"), F.col(f"s_{k}")).otherwise(F.col(f"m_{k}")).alias(k) for k in keys], *[value(a).alias(a) for a in attributes],
        F.create_map(*[x for a in attributes for x in (F.lit(a), F.when(own[a], "user").otherwise("scan"))]).alias("origins"), F.filter(F.array(*clash), lambda x: x.isNotNull()).alias("conflicts"),
    )


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def describes(static: Column, label: Column) -> Column:
    """Whether a fixed text is a field's own label, or the label with a prompt to choose behind its colon."""
    bare = lambda x: F.rtrim(x, F.lit(" :：–—-"))

    def names(v: Column) -> Column:
        b = v["b"]
        low = F.trim(F.replace(v["said"], F.lit("："), F.lit(":")))
        tail = F.rtrim(F.trim(F.substring(low, F.char_length(b) + 2, F.lit(1 << 20))), F.lit("."))
        return (v["said"] != "") & (v["named"] != "") & ((bare(v["said"]) == b) | (F.startswith(low, F.concat(b, F.lit(":"))) & tail.rlike(r"(?i)^(?:escolher|selecione|selecionar)\s+(?:um|uma)\s+(?:item|op[cç][aã]o)$")))

    said, named = casefold(labels.space(static)), casefold(labels.space(label))
    return bound(bound(F.struct(said.alias("said"), named.alias("named")), lambda v: F.struct(v["said"].alias("said"), v["named"].alias("named"), bare(v["named"]).alias("b"))), names)


def without_duplicates(fields: DataFrame) -> DataFrame:
    """Form-grid ``fields`` (doc, layout_group, layout_row, pos, start, span, label, detection_source, field_id) without assisted readings of a
    cell that a native or explicit field reads under the same label.

    Fields that overlap meet in the columns that both cover. Equal authorities are conflicts for a person and stay.
    """
    source = F.lower(F.trim(F.coalesce("detection_source", F.lit(""))))
    assisted = source.isin(*ASSISTED) | ((source == "") & F.startswith(F.lower(F.trim("field_id")), F.lit("auto.")))
    authority = F.when(source.isin(*NATIVE), 40).when(assisted, 10).otherwise(30)
    name = F.btrim(F.regexp_replace(F.regexp_replace(fold(F.trim("label")), r"^\s*\d+(?:\.\d+)*[.)]?\s+", ""), "[^a-z0-9]+", "_"), F.lit("_"))
    f = fields.withColumn("x_authority", authority).withColumn("x_name", name)
    cover = f.withColumn("x_at", F.explode(F.sequence("start", F.col("start") + F.greatest("span", F.lit(1)) - 1)))
    top = F.max("x_authority").over(W.partitionBy("doc", "layout_group", "layout_row", "x_name", "x_at"))
    beaten = cover.withColumn("x_top", top).filter((F.col("x_authority") < F.col("x_top")) & (F.col("x_name") != "") & (F.coalesce("layout_group", F.lit("")) != "") & (F.coalesce("layout_row", F.lit("")) != "")).select("doc", "pos").distinct()
    return f.join(beaten.withColumnsRenamed({"doc": "b_doc", "pos": "b_pos"}), f.doc.eqNullSafe(F.col("b_doc")) & (f.pos == F.col("b_pos")), "left_anti").drop("x_authority", "x_name")


def normalized(fields: DataFrame) -> DataFrame:
    """Form-grid fields (doc, section, layout_group, layout_row, pos, label, start, span, grid, locked, statics ARRAY<STRUCT<start, span, label>>) in a
    grid of 1 to 12 columns: starts and spans lie in it, a fixed text at the left of a field that only names it becomes part of
    the field, one in the field's own cell goes, and a field alone in its row takes the whole row unless it is ``locked``.

    Output: the fields with new ``start``, ``span``, ``grid``, ``full_width`` and ``statics`` (what is left of the fixed texts).
    """
    group = W.partitionBy("doc", "section", "layout_group")
    grid = F.greatest(F.lit(1), F.least(F.lit(GRID_MOST), F.max(F.coalesce("grid", F.lit(1))).over(group))).cast("int")
    f = fields.withColumn("grid", grid)
    start = F.greatest(F.lit(0), F.least(F.coalesce("start", F.lit(0)), F.col("grid") - 1))
    f = f.withColumn("start", start).withColumn("span", F.greatest(F.lit(1), F.least(F.coalesce("span", F.lit(1)), F.col("grid") - F.col("start"))))
    row = ["doc", "section", "layout_group", "layout_row"]
    item = F.struct("pos", "start", "span", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("locked", F.lit(False)).alias("locked"))
    none = F.expr("cast(array() as array<struct<start:int,span:int,label:string>>)")
    rows = f.groupBy(*row).agg(
        F.array_sort(F.collect_list(item)).alias("items"), F.first("grid").alias("g"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("statics", none).alias("s")))), lambda x: x["s"])).alias("all"),
    )
    given = F.filter("all", lambda s: F.trim(F.coalesce(s["label"], F.lit(""))) != "")

    def step(acc: Column, s: Column) -> Column:
        width = F.greatest(F.lit(1), s["span"])
        beside = lambda x: (s["start"] + width == x["start"]) & describes(s["label"], x["label"]) & ~x["locked"]
        over = lambda x: (s["start"] < x["start"] + x["span"]) & (x["start"] < s["start"] + width) & describes(s["label"], x["label"])
        at = F.array_position(F.transform(acc["items"], lambda x: beside(x) | over(x)), True)
        grown = lambda x: F.struct(x["pos"].alias("pos"), s["start"].alias("start"), F.least(acc["g"] - s["start"], width + x["span"]).alias("span"), x["label"].alias("label"), x["locked"].alias("locked"))
        return bound(at, lambda n: F.struct(F.transform(acc["items"], lambda x, k: F.when((k == n - 1) & beside(x), grown(x)).otherwise(x)).alias("items"), F.when(n > 0, F.array_append(acc["gone"], s)).otherwise(acc["gone"]).alias("gone"), acc["g"].alias("g")))

    done = F.aggregate(given, F.struct("items", none.alias("gone"), F.col("g").alias("g")), step)
    rows = rows.withColumn("done", done).withColumn("left", F.filter(given, lambda s: ~F.array_contains(F.col("done.gone"), s)))
    alone = (F.size("items") == 1) & (F.size("left") == 0)
    rows = rows.select(*row, "left", "done.gone", alone.alias("alone"), F.explode("done.items").alias("x")).withColumn("wide", F.col("alone") & ~F.col("x.locked"))
    new = rows.select(*[F.col(c).alias(f"n_{c}") for c in row], "x.pos", "gone", "wide", F.col("x.start").alias("n_start"), F.col("x.span").alias("n_span")).withColumnRenamed("pos", "n_pos")
    j = f.join(new, _all([f[c].eqNullSafe(F.col(f"n_{c}")) for c in row]) & (f.pos == F.col("n_pos")))
    kept = F.filter(F.coalesce("statics", none), lambda s: ~F.array_contains(F.col("gone"), s))
    value = {"start": F.when(F.col("wide"), 0).otherwise(F.col("n_start")), "span": F.when(F.col("wide"), F.col("grid")).otherwise(F.col("n_span")), "statics": kept}
    return j.select(*[value.get(c, F.col(c)).alias(c) for c in fields.columns], F.col("wide").alias("full_width"))
