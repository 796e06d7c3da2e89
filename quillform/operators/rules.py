"""Conditions, answer validation, and template quality as rules over tables of fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import formats
from ..functions.text import casefold, digits_only, is_empty
from .graph import stored
from .tags import valid_id

EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


def condition_matches(op: Column, expected: Column, actual: Column, actual_is_bool: Column | None = None) -> Column:
    """Whether a field is visible. ``op`` is equals, not_equals, truthy or anything else, which always holds.

    Texts are compared without case; a boolean answer is compared with the words for true; a missing answer reads None.
    Any answer that isn't empty is truthy, the texts "false" and "0" too; a boolean is what it says.
    """
    said = F.coalesce(casefold(actual), F.lit("none"))
    said = F.when(actual.isNull(), "none").otherwise(said)
    equal = said == casefold(expected)
    if actual_is_bool is not None:
        as_bool = casefold(expected).isin("1", "true", "yes", "sim", "checked").cast("string")
        equal = F.when(actual_is_bool, said == as_bool).otherwise(equal)
    holds = actual.isNotNull() & (actual != "")
    if actual_is_bool is not None:
        holds = F.when(actual_is_bool, said == "true").otherwise(holds)
    return F.when(op == "equals", equal).when(op == "not_equals", said != casefold(expected)).when(op == "truthy", holds).otherwise(F.lit(True))


def parse_condition(text: Column) -> Column:
    """STRUCT<field, op, expected> of ``field=value``; null without a sign."""
    at = F.instr(text, "=")
    made = F.struct(F.trim(F.left(text, at - 1)).alias("field"), F.lit("equals").alias("op"), F.trim(F.substring(text, at + 1, F.length(text))).alias("expected"))
    return F.when(at > 0, made)


def validate(kind: Column, value: Column, required: Column, options: Column | None = None, least: Column | None = None, most: Column | None = None, pattern: str | None = None, low: Column | None = None, high: Column | None = None, kinds: tuple[str, ...] | None = None) -> Column:
    """The first rule that an answer breaks, as a code, or null: required, its type, lengths, pattern.

    ``kinds`` names the types that occur, where they are known: only their checks are compiled.
    """
    t = F.trim(F.coalesce(value, F.lit("")))
    number, n = formats.localized(t), F.length(digits_only(t))
    checks = {
        "cnpj": ("cnpj", ~formats.valid_cnpj(t)),
        "cpf": ("cpf", ~formats.valid_cpf(t)),
        "cep": ("cep", n != 8),
        "phone": ("phone", ~n.isin(10, 11)),
        "email": ("email", ~t.rlike(EMAIL)),
        "integer": ("integer", ~t.rlike(r"^[+-]*[0-9]+$")),
        "decimal": ("number", number.isNull()),
        "currency": ("number", number.isNull()),
        "percentage": ("number", number.isNull()),
    }
    typed = F.lit(None).cast("string")
    for name, (code, broken) in checks.items():
        if kinds is None or name in kinds:
            typed = F.when((kind == name) & broken, code).otherwise(typed)
    if kinds is None or "percentage" in kinds:
        outside = (number < F.coalesce(low if low is not None else F.lit(None), F.lit(0))) | (number > F.coalesce(high if high is not None else F.lit(None), F.lit(100)))
        typed = F.coalesce(typed, F.when((kind == "percentage") & outside, "range"))
    if options is not None:
        typed = F.coalesce(typed, F.when((kind == "dropdown") & (F.size(options) == 0), "no options").when((kind == "dropdown") & ~F.array_contains(options, t), "not an option"))
    rules = [typed]
    if least is not None:
        rules.append(F.when((least > 0) & (F.length(t) < least), "too short"))
    if most is not None:
        rules.append(F.when((most > 0) & (F.length(t) > most), "too long"))
    if pattern:
        rules.append(F.when(~t.rlike(f"^(?:{pattern})$"), "pattern"))
    return F.when(kind == "checkbox", None).when(is_empty(value), F.when(required, "required")).otherwise(F.coalesce(*rules))


def missing_choices(fields: DataFrame, *keys: str) -> DataFrame:
    """Groups (by ``keys``) of required choices of which none is checked; fields have ``checked`` and ``required``."""
    return fields.groupBy(*keys).agg(F.bool_or("required").alias("required"), F.bool_or("checked").alias("any")).filter("required AND NOT any").select(*keys)


def quality_issues(fields: DataFrame, key: str = "template_id") -> DataFrame:
    """(key, pos, field_id, severity, code) for fields (key, pos, id, label, type, options, depends_on).

    ``options`` is an array, ``depends_on`` the id of another field of the template, or null. Confidence rules use
    ``detection_source``, ``detection_reviewed`` and ``detection_confidence`` where the table has them (and
    ``detection_band``), table rules ``columns`` (array of raw ids), and rules on the shape of conditions and on cycles
    ``condition_object`` and ``condition_compares`` (booleans, null without a condition).
    """
    f = fields.withColumn("id", F.trim(F.coalesce("id", F.lit("")))).withColumn("same", F.count("*").over(W.partitionBy(key, "id")))
    known = f.filter("id <> ''").select(F.col(key).alias("k"), F.col("id").alias("known_id")).distinct()
    f = f.join(known, (F.col(key) == F.col("k")) & (F.col("depends_on") == F.col("known_id")), "left")
    has = lambda *names: all(n in fields.columns for n in names)
    whole = F.col("condition_object") if has("condition_object") else F.lit(True)
    options = F.transform(F.coalesce("options", F.expr("cast(array() as array<string>)")), lambda x: F.trim(x))
    some = F.filter(options, lambda x: x != "")
    drop = F.col("type") == "dropdown"
    rules = [
        ("error", "field.id_missing", F.col("id") == ""),
        ("error", "field.id_invalid", (F.col("id") != "") & ~valid_id(F.col("id"))),
        ("error", "field.id_duplicate", (F.col("id") != "") & valid_id(F.col("id")) & (F.col("same") > 1)),
        ("error", "field.label_missing", is_empty(F.col("label"))),
        ("error", "dropdown.options_missing", drop & (F.size(F.array_distinct(some)) < 2)),
        ("warning", "dropdown.options_duplicate", drop & (F.size(F.array_distinct(some)) < F.size(some))),
        ("error", "condition.field_unknown", whole & F.col("depends_on").isNotNull() & (F.col("depends_on") != "") & F.col("known_id").isNull()),
        ("error", "condition.field_missing", whole & (F.col("depends_on") == "")),
    ]
    if has("columns"):
        named = F.filter(F.transform(F.coalesce("columns", F.expr("cast(array() as array<string>)")), lambda x: F.trim(x)), lambda x: x != "")
        tab = F.col("type") == "repeatable_table"
        rules += [("error", "table.columns_missing", tab & (F.size(named) == 0)), ("error", "table.columns_duplicate", tab & (F.size(F.array_distinct(named)) < F.size(named)))]
    if has("condition_object", "condition_compares"):
        rules += [("error", "condition.invalid", ~F.col("condition_object")), ("error", "condition.comparison_missing", F.col("condition_object") & ~F.col("condition_compares"))]
        once = f.filter((F.col("id") != "") & (F.col("same") == 1)).select(F.col(key).alias("k"), F.col("id").alias("n"), F.when(F.col("condition_object"), F.trim("depends_on")).alias("t"))
        inner = once.join(once.select("k", F.col("n").alias("t")), ["k", "t"], "left_semi")
        on = cycles(inner, "k", "n", "t").select(F.col("k").alias("y_k"), F.col("n").alias("y_n"))
        f = f.join(on, (F.col(key) == F.col("y_k")) & (F.col("id") == F.col("y_n")) & (F.col("same") == 1), "left")
        rules.append(("error", "condition.cycle", F.col("y_n").isNotNull()))
    if has("detection_confidence"):
        band = F.lower(F.trim(F.coalesce("detection_band", F.lit("")))) if has("detection_band") else F.lit("")
        sure = lambda x: F.coalesce(x, F.lit(False))
        low, medium = (band == "low") | sure(F.col("detection_confidence") < 0.65), (band == "medium") | sure(F.col("detection_confidence") < 0.85)
        unseen = F.lower(F.trim("detection_source")).isin("automatic", "assisted", "auto_detection") & ~F.coalesce("detection_reviewed", F.lit(False))
        rules += [("warning", "detection.low_confidence", unseen & low), ("warning", "detection.medium_confidence", unseen & ~low & medium)]
    found = F.filter(F.array(*[F.when(test, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"))) for s, c, test in rules]), lambda x: x.isNotNull())
    return f.select(F.col(key), "pos", F.col("id").alias("field_id"), F.explode(found).alias("i")).select(key, "pos", "field_id", "i.severity", "i.code")


def issue_counts(issues: DataFrame, key: str = "template_id") -> DataFrame:
    return issues.groupBy(key).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def cycles(edges: DataFrame, key: str, node: str, to: str) -> DataFrame:
    """(key, node): nodes on a cycle of a graph in which each node has one edge at most; a self-loop is a cycle.

    Pointer doubling: after k rounds a node knows where 2^k steps lead, so log2(nodes) joins settle chains of any
    length. Nodes reached after at least as many steps as there are nodes are exactly those on cycles.
    """
    e = edges.select(F.col(key).alias("k"), F.col(node).alias("n"), F.col(to).alias("t")).distinct()
    most = e.groupBy("k").count().agg(F.max("count")).first()[0] or 0
    step, length = stored(e), 1
    while length < most:
        # Stored each round: a plan that joins itself would double.
        step = stored(step.alias("a").join(step.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.t") == F.col("b.n"))).select("a.k", "a.n", "b.t"))
        length *= 2
    return step.select(F.col("k").alias(key), F.col("t").alias(node)).distinct()


def configured_vs_scanned(configured: DataFrame, scanned: DataFrame, keys: list[str], kind: str = "type") -> DataFrame:
    """Full outer comparison: missing (configured, not in the document), unused (only in the document), type_mismatch, or ok."""
    c, s = configured.select(*keys, F.col(kind).alias("configured_type")), scanned.select(*keys, F.col(kind).alias("scanned_type"))
    status = F.when(F.col("scanned_type").isNull(), "missing").when(F.col("configured_type").isNull(), "unused").when(F.col("configured_type") != F.col("scanned_type"), "type_mismatch").otherwise("ok")
    return c.join(s, keys, "full_outer").withColumn("status", status)


def union_rules(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
