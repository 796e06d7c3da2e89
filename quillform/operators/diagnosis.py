"""Template diagnosis: what is configured against what a document holds, as tables of issues, and the gates that read them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import is_empty
from .graph import components
from .rules import cycles
from .tags import valid_id

#: Scanned types that a configured type must equal; file name tokens that every template knows.
BINDING = ("checkbox", "date", "dropdown", "repeatable_table")
TOKENS = ("template.name", "year", "sequence")
#: Codes, severities, whether a safe fix exists, and the words of the summary (in its order).
CODES = (
    ("source.missing", "error", False, None),
    ("field.missing_config", "warning", True, "campo(s) do DOCX não possuem configuração"),
    ("field.unused_config", "warning", False, "campo(s) configurados não aparecem no DOCX"),
    ("field.type_mismatch", "warning", True, "incompatibilidade(s) de tipo de campo"),
    ("field.duplicate_id", "error", False, "ID(s) de campo configurado duplicados"),
    ("field.invalid_id", "error", False, "ID(s) de campo configurado são inválidos"),
    ("condition.invalid", "error", False, "problema(s) em regras condicionais"),
    ("condition.cycle", "error", False, "ciclo(s) em regras condicionais"),
    ("dropdown.no_options", "error", False, "lista(s) suspensa(s) não possuem opções"),
    ("dropdown.duplicate_options", "warning", False, "lista(s) suspensa(s) possuem opções repetidas"),
    ("table.no_columns", "error", False, "tabela(s) repetível(is) não possuem colunas"),
    ("table.duplicate_columns", "error", False, "tabela(s) repetível(is) possuem IDs de coluna duplicados"),
    ("output.unknown_token", "warning", False, "marcador(es) do nome do arquivo são desconhecidos"),
    ("tag.malformed", "error", False, "marcador(es) malformados"),
    ("tag.unmatched_braces", "error", False, None),
)
_NONE = "cast(array() as array<string>)"


def _filled(name: str):
    """An array column without blank elements, trimmed."""
    return F.filter(F.transform(F.coalesce(name, F.expr(_NONE)), lambda x: F.trim(x)), lambda x: x != "")


def condition_problems(fields: DataFrame, key: str = "template_id") -> DataFrame:
    """(key, id, problem): conditions that aren't objects, lack their field or a comparison, or name an unknown field.

    ``fields`` has id and ``condition`` STRUCT<object BOOLEAN, field, compares BOOLEAN>, or null without one.
    """
    known = fields.select(F.col(key).alias("k"), F.col("id").alias("known")).distinct()
    f = fields.filter("condition IS NOT NULL").withColumn("on", F.trim(F.coalesce("condition.field", F.lit(""))))
    f = f.join(known, (F.col(key) == F.col("k")) & (F.col("on") == F.col("known")), "left")
    shape = F.col("condition.object")
    problems = [F.when(~shape, "not an object"), F.when(shape & (F.col("on") == ""), "no field"), F.when(shape & (F.col("on") != "") & F.col("known").isNull(), F.concat(F.lit("unknown field "), F.col("on"))), F.when(shape & ~F.col("condition.compares"), "no comparison")]
    return f.select(key, "id", F.explode(F.filter(F.array(*problems), lambda x: x.isNotNull())).alias("problem"))


def condition_edges(fields: DataFrame, key: str = "template_id") -> DataFrame:
    """(key, id, on): dependencies between known fields whose ids stand once."""
    once = fields.filter(~is_empty(F.col("id"))).withColumn("n", F.count("*").over(W.partitionBy(key, "id"))).filter("n = 1")
    e = once.filter("condition.object").select(key, "id", F.trim("condition.field").alias("on"))
    return e.join(once.select(key, F.col("id").alias("on")), [key, "on"], "left_semi").select(key, "id", "on")


def condition_cycles(fields: DataFrame, key: str = "template_id") -> DataFrame:
    """(key, members): each cycle of conditions once, its fields sorted."""
    edges = condition_edges(fields, key)
    on = cycles(edges, key, "id", "on")
    name = lambda c: F.to_json(F.struct(F.col(key).alias("k"), F.col(c).alias("n")))
    inner = edges.join(on, [key, "id"], "left_semi")
    nodes = on.select(name("id").alias("node"), key, "id")
    placed = components(nodes.select("node"), inner.select(name("id").alias("u"), name("on").alias("v")))
    return nodes.join(placed, "node").groupBy(key, "grp").agg(F.array_sort(F.collect_list("id")).alias("members")).drop("grp")


def diagnose(templates: DataFrame, configured: DataFrame, scanned: DataFrame, health: DataFrame, key: str = "template_id") -> DataFrame:
    """(key, code, severity, field_id, detail, safe_fix, locations): every issue of every template.

    ``templates`` has has_source and filename_tokens; ``configured`` id, pos, type, options and columns (arrays of raw
    values) and condition (of several fields with one id the last counts); ``scanned`` id, type and parts (where the field stands); ``health`` malformed (array) and unmatched.
    """
    c = configured.withColumn("id", F.trim(F.coalesce("id", F.lit("")))).filter("id <> ''")
    ids = c.groupBy(key, "id").agg(F.count("*").alias("n"), F.max_by("type", "pos").alias("c_type"))
    s = scanned.select(key, "id", F.col("type").alias("s_type"), "parts")
    both = ids.join(s, [key, "id"], "full_outer")
    options, columns = _filled("options"), _filled("columns")
    per = c.select(key, "id", "type", options.alias("o"), columns.alias("t"))
    repeated = lambda a: F.size(F.array_distinct(a)) < F.size(a)
    one = lambda df, code, detail=F.lit(""): df.select(key, F.lit(code).alias("code"), F.col("id").alias("field_id"), detail.alias("detail"))
    loose = lambda df, code, detail=F.lit(""): df.select(key, F.lit(code).alias("code"), F.lit("").alias("field_id"), detail.alias("detail"))
    tokens = templates.select(key, F.explode(F.array_distinct(_filled("filename_tokens"))).alias("id")).filter(~F.col("id").isin(*TOKENS)).join(ids, [key, "id"], "left_anti")
    drop, tab = per.filter("type = 'dropdown'"), per.filter("type = 'repeatable_table'")
    found = [
        loose(templates.filter("NOT has_source"), "source.missing"),
        one(both.filter("c_type IS NULL"), "field.missing_config"),
        one(both.filter("s_type IS NULL"), "field.unused_config"),
        one(both.filter(F.col("s_type").isin(*BINDING) & F.col("c_type").isNotNull() & (F.col("c_type") != F.col("s_type"))), "field.type_mismatch", F.concat("c_type", F.lit("/"), "s_type")),
        one(ids.filter("n > 1"), "field.duplicate_id"),
        one(ids.filter(~valid_id(F.col("id"))), "field.invalid_id"),
        loose(condition_problems(c, key), "condition.invalid", F.concat("id", F.lit(": "), "problem")),
        loose(condition_cycles(c, key), "condition.cycle", F.array_join("members", " ")),
        one(drop.filter(F.size(F.array_distinct("o")) < 2), "dropdown.no_options"),
        one(drop.filter(repeated(F.col("o"))), "dropdown.duplicate_options"),
        one(tab.filter("size(t) = 0"), "table.no_columns"),
        one(tab.filter(repeated(F.col("t"))), "table.duplicate_columns"),
        loose(tokens, "output.unknown_token", F.col("id")),
        loose(health.select(key, F.explode("malformed").alias("m")), "tag.malformed", F.col("m")),
        loose(health.filter("unmatched > 0"), "tag.unmatched_braces"),
    ]
    rows = reduce(DataFrame.unionByName, found)
    known = F.create_map(*[F.lit(v) for code, severity, fix, _ in CODES for v in (code, f"{severity}:{str(fix).lower()}")])
    said = F.split(known[F.col("code")], ":")
    places = s.select(F.col(key).alias("p_key"), F.col("id").alias("p_id"), "parts")
    out = rows.join(places, (F.col(key) == F.col("p_key")) & (F.col("field_id") == F.col("p_id")), "left")
    return out.select(key, "code", said[0].alias("severity"), "field_id", "detail", (said[1] == "true").alias("safe_fix"), F.coalesce("parts", F.expr(_NONE)).alias("locations"))


def verdicts(templates: DataFrame, issues: DataFrame, key: str = "template_id") -> DataFrame:
    """(key, errors, warnings, ok, blocking, safe_fix_available) of every template."""
    n = issues.groupBy(key).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.bool_or("safe_fix").alias("fix"))
    rows = templates.select(key).join(n, key, "left").na.fill(0, ["errors", "warnings"])
    return rows.select(key, "errors", "warnings", ((F.col("errors") == 0) & (F.col("warnings") == 0)).alias("ok"), (F.col("errors") > 0).alias("blocking"), F.coalesce("fix", F.lit(False)).alias("safe_fix_available"))


def warnings(issues: DataFrame, key: str = "template_id") -> DataFrame:
    """(key, messages): counts of issues in words, in a fixed order."""
    words = [(i, code, text) for i, (code, _, _, text) in enumerate(CODES)]
    text = F.create_map(*[F.lit(v) for _, code, t in words if t for v in (code, t)])
    order = F.create_map(*[F.lit(v) for i, code, _ in words for v in (code, i)])
    n = issues.groupBy(key, "code").agg(F.count("*").alias("n"))
    counted = F.concat(F.lit("Foram detectados "), F.col("n").cast("string"), F.lit(" "), text[F.col("code")], F.lit("."))
    said = F.when(F.col("code") == "source.missing", "O DOCX de origem está ausente.").when(F.col("code") == "tag.unmatched_braces", "Foram detectadas chaves de marcadores sem par no DOCX.").otherwise(counted)
    return n.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order[F.col("code")].alias("i"), said.alias("s")))), lambda x: x["s"]).alias("messages"))


def allowed(templates: DataFrame, issues: DataFrame, key: str = "template_id") -> DataFrame:
    """Templates without an error: what may be saved or generated from."""
    return templates.join(issues.filter("severity = 'error'").select(key).distinct(), key, "left_anti")


def require(issues: DataFrame) -> None:
    """Raise where an issue is an error, with the first ones by code."""
    first = issues.filter("severity = 'error'").orderBy("code", "field_id").limit(5).collect()
    if first:
        raise ValueError("; ".join(f"{r.code} {r.field_id or r.detail}".strip() for r in first))


def readiness(templates: DataFrame, fields: DataFrame, health: DataFrame, key: str = "template_id") -> DataFrame:
    """(key, checks MAP<name, BOOLEAN>, ready): the named checks of a template before it is published.

    ``templates`` has name, has_source and filename_tokens; ``fields`` id, type, options, columns; ``health`` malformed, unmatched.
    """
    f = fields.withColumn("id", F.trim(F.coalesce("id", F.lit("")))).withColumn("same", F.count("*").over(W.partitionBy(key, "id")))
    g = f.groupBy(key).agg(
        F.count("*").alias("n"), F.bool_or((F.col("id") != "") & (F.col("same") > 1)).alias("twice"), F.bool_or((F.col("id") != "") & ~valid_id(F.col("id"))).alias("bad"),
        F.bool_or((F.col("type") == "dropdown") & (F.size(F.array_distinct(_filled("options"))) < 2)).alias("few"), F.bool_or((F.col("type") == "repeatable_table") & (F.size(F.coalesce("columns", F.expr(_NONE))) == 0)).alias("bare"), F.collect_set("id").alias("ids"),
    )
    h = health.select(key, ((F.size("malformed") > 0) | (F.col("unmatched") > 0)).alias("broken"))
    rows = templates.join(g, key, "left").join(h, key, "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    tokens = F.forall(_filled("filename_tokens"), lambda t: t.isin(*TOKENS) | F.array_contains(F.coalesce("ids", F.expr(_NONE)), t))
    checks = {"name": ~is_empty(F.col("name")), "source": F.col("has_source"), "fields": F.coalesce("n", F.lit(0)) > 0, "unique_ids": no("twice"), "valid_ids": no("bad"), "options": no("few"), "columns": no("bare"), "filename_tokens": tokens, "tags": no("broken")}
    made = rows.select(key, F.create_map(*[x for k, v in checks.items() for x in (F.lit(k), v)]).alias("checks"))
    return made.withColumn("ready", F.forall(F.map_values("checks"), lambda x: x))
