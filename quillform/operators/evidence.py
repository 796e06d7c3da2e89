"""Missing metadata of fields from ranked evidence: what each value is, where it comes from, and how sure it is.

Nothing that a person or a document has said explicitly is replaced. ``fields``: doc, pos, field_id, label, label_source, section, type,
type_source, placeholder, default_value, options (texts), profile_identity, and the places that can name a field:
choice_group_label, layout_group_label, layout_row_label, layout_column, profile_key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import labels
from ..functions.text import bound, context_text
from .records import unique_ids

#: Where a label may come from, shapes of samples, words of labels with the type that they tell, and confidences.
LABELS = (("choice_group_label", "choice_group", 0.98), ("layout_group_label", "layout_group", 0.94), ("layout_row_label", "row_label", 0.92), ("layout_column", "column_header", 0.82), ("profile_key", "profile_key", 0.72))
SHAPES = (
    ("cpf", r"^(?:\d{3}|[Xx0]{3})\.(?:\d{3}|[Xx0]{3})\.(?:\d{3}|[Xx0]{3})-(?:\d{2}|[Xx0]{2})$", "mask", 0.99),
    ("cnpj", r"^(?:\d{2}|[Xx0]{2})\.(?:\d{3}|[Xx0]{3})\.(?:\d{3}|[Xx0]{3})/(?:\d{4}|[Xx0]{4})-(?:\d{2}|[Xx0]{2})$", "mask", 0.99),
    ("email", r"^[^\s@]+@[^\s@]+\.[^\s@]+$", "example_value", 0.98),
    ("phone", r"^\(?\d{2}\)?\s*\d{4,5}[-\s]?\d{4}$", "example_value", 0.97),
    ("date", r"^(?:_\s*[/.-]\s*){2}_+$|^\d{2}/\d{2}/\d{4}$", "mask", 0.98),
    ("currency", r"^R\$\s*(?:[Xx0_.]+(?:[,\.]?[Xx0_]{2})?|_+(?:,__)?|[\d.]+,\d{2})$", "mask", 0.98),
)
WORDS = (
    ("cnpj", ("cnpj",), 0.99), ("cpf", ("cpf",), 0.99), ("email", ("email", "e mail"), 0.98), ("phone", ("telefone", "celular", "whatsapp"), 0.97), ("cep", ("cep", "codigo postal"), 0.97),
    ("date", ("data", "vencimento", "prazo final", "proxima revisao"), 0.90), ("currency", ("valor", "preco", "montante", "custo", "orcamento"), 0.92), ("percentage", ("percentual", "porcentagem", "aliquota"), 0.94),
    ("integer", ("quantidade", "numero de unidades", "qtd"), 0.88), ("multiline", ("justificativa", "descricao detalhada", "observacao", "fundamentacao", "providencia"), 0.88),
)
PLAIN_TYPES = ("", "text", "string", "input", "auto")
SETTLED = ("manual", "explicit", "native_control", "native_pdf", "automatic_detection")
ID_SURE, IDENTITY_SURE, VERSION = 0.93, 0.90, 3


def _found(value: Column, source: Column | str, sure: Column | float) -> Column:
    told = source if isinstance(source, Column) else F.lit(source)
    return F.struct(value.alias("value"), told.alias("source"), (sure if isinstance(sure, Column) else F.lit(sure)).cast("double").alias("confidence"))


def inferred_type(label: Column, field_id: Column, samples: list[Column], options: Column, current: Column) -> Column:
    """STRUCT<value, source, confidence> of a type by options, by the shape of a sample, or by words of label and id; null where nothing
    tells, or where the field has a type of its own."""
    given = F.coalesce(options, F.expr("cast(array() as array<string>)"))
    text = lambda x: F.trim(F.coalesce(x.cast("string"), F.lit("")))
    rules = F.array(*[F.struct(F.lit(f" {w} ").alias("word"), F.lit(kind).alias("kind"), F.lit(sure).cast("double").alias("sure")) for kind, words, sure in WORDS for w in words])
    context = F.concat(F.lit(" "), context_text(label), F.lit(" "), context_text(field_id), F.lit(" "))
    # Values that several conditions read are bound once, as the one element of an array.
    said = F.get(F.flatten(F.transform(F.array(context), lambda c: F.transform(F.filter(rules, lambda r: F.contains(c, r["word"])), lambda r: _found(r["kind"], "semantic_label", r["sure"])))), F.lit(0))

    def shape(x: Column) -> Column:
        out = F.lit(None)
        for kind, pattern, source, sure in reversed(SHAPES):
            out = F.when(x.rlike(pattern), _found(F.lit(kind), source, sure)).otherwise(out)
        return out

    shaped = F.get(F.filter(F.transform(F.array(*[text(x) for x in samples]), shape), lambda x: x.isNotNull()), F.lit(0))
    listed = F.when(F.exists(given, lambda x: F.trim(x) != ""), _found(F.lit("dropdown"), "options", 1.0))
    return F.when(F.lower(text(current)).isin(*PLAIN_TYPES), F.coalesce(listed, shaped, said))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is evaluated once a row, however many later columns read it: projections aren't merged past a generator."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def resolve(fields: DataFrame) -> DataFrame:
    """``fields`` with missing labels, ids, types and identities filled in, ``id_source``, ``evidence`` (attribute -> value, source and
    confidence) and ``context_confidence``, their mean to three decimals, halves up (null without evidence).

    A label comes from the first place that has one; an id from label and section, the first that no field of the document has, else
    with the first free number; a type where there is none of its own; an identity from section, label and type. Fields that get
    their first choice of an id come before those that need a number. Null texts are empty.
    """
    text = lambda n: F.trim(F.coalesce(F.col(n), F.lit("")))
    places = F.array(*[F.struct(F.col(place).alias("said"), F.lit(source).alias("source"), F.lit(sure).alias("sure")) for place, source, sure in LABELS])
    cleaned = F.transform(places, lambda p: _found(labels.clean_choice(p["said"]), p["source"], p["sure"]))
    own = F.when(text("label") == "", bound(cleaned, lambda c: F.get(F.filter(c, lambda p: p["value"] != ""), F.lit(0))))
    labelled = lambda df: _once(df, "e_label", own).withColumn("x_label", F.coalesce("e_label.value", text("label")))
    # Only fields without an id go through the search for one.
    sure, f = labelled(fields.filter(text("field_id") != "")), labelled(fields.filter(text("field_id") == ""))
    # What follows is bound as lambda variables: written out, the expressions would be too large to compile.
    one = F.array(F.struct(F.col("x_label").alias("label"), F.coalesce("section", F.lit("")).alias("section"), F.coalesce("type", F.lit("text")).alias("type")))
    ids = F.get(F.transform(one, lambda v: labels.context_ids(v["label"], v["section"], v["type"], F.lit(1))), F.lit(0))
    f = f.withColumn("x_ids", F.when(F.col("x_label") != "", ids))
    named = fields.filter(text("field_id") != "").select("doc", text("field_id").alias("name")).distinct()
    wants = f.filter("x_ids IS NOT NULL").select("doc", "pos", F.get("x_ids", F.lit(0)).alias("name"), F.element_at("x_ids", -1).alias("base"))
    wants = wants.join(named.withColumn("taken", F.lit(True)), ["doc", "name"], "left")
    wants = wants.withColumn("n", F.row_number().over(W.partitionBy("doc", "name").orderBy("pos")))
    first = wants.filter("taken IS NULL AND n = 1").select("doc", "pos", "name")
    rest = wants.filter("taken IS NOT NULL OR n > 1").select("doc", "pos", "base")
    held = named.unionByName(first.select("doc", "name")).select("doc", F.col("name").alias("base"))
    ids = first.unionByName(unique_ids(rest, "base", ["pos"], "doc", taken=held, name="name").select("doc", "pos", "name"))
    j = f.join(ids.select(F.col("doc").alias("n_doc"), F.col("pos").alias("n_pos"), "name"), f.doc.eqNullSafe(F.col("n_doc")) & (f.pos == F.col("n_pos")), "left")
    j = sure.withColumn("name", F.lit(None).cast("string")).unionByName(j.select(*sure.columns, "name"))
    j = j.withColumn("x_id", F.coalesce("name", text("field_id")))
    kind = inferred_type(F.col("x_label"), F.col("x_id"), [F.col("placeholder"), F.col("default_value")], F.col("options"), F.col("type"))
    j = _once(j, "e_type", F.when(~F.lower(text("type_source")).isin(*SETTLED), kind)).withColumn("x_type", F.coalesce("e_type.value", "type"))
    one = F.array(F.struct(F.col("x_label").alias("label"), F.coalesce("section", F.lit("")).alias("section"), F.coalesce("x_type", F.lit("text")).alias("type")))
    identity = F.filter(F.transform(one, lambda v: _found(labels.profile_identity(v["label"], v["section"], v["type"]), "semantic_identity", IDENTITY_SURE)), lambda x: x["value"] != "")
    j = _once(j, "e_identity", F.when((F.col("x_label") != "") & (text("profile_identity") == ""), F.get(identity, F.lit(0))))
    every = {"label": F.col("e_label"), "id": F.when(F.col("name").isNotNull(), _found(F.col("name"), "label_and_section", ID_SURE)), "type": F.col("e_type"), "profile_identity": F.col("e_identity")}
    told = F.map_filter(F.create_map(*[x for k, v in every.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    j = _once(j, "evidence", told)
    each = F.transform(F.map_values("evidence"), lambda x: x["confidence"])
    mean = F.round(F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.size(each), 3)
    value = {
        "label": F.when(F.col("e_label").isNotNull(), F.col("x_label")).otherwise(F.col("label")), "label_source": F.coalesce("label_source", F.when(F.col("e_label").isNotNull(), "context_resolver")), "field_id": F.coalesce("name", "field_id"),
        "type": F.col("x_type"), "type_source": F.when(F.col("e_type").isNotNull(), "context_resolver").otherwise(F.col("type_source")), "profile_identity": F.coalesce("e_identity.value", "profile_identity"),
    }
    return j.select(*[value.get(c, F.col(c)).alias(c) for c in fields.columns], F.when(F.col("name").isNotNull(), "context_resolver").alias("id_source"), "evidence", F.when(F.size("evidence") > 0, mean).alias("context_confidence"))
