"""Tags ``{{...}}`` in texts: tokens, their grammar, their health, and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.text import casefold
from ..functions.types import guess

TAG = r"\{\{([^{}]+)\}\}"
#: Ids of row numbers, and prefixes of typed tags.
ROW_NUMBERS = ("row.number", "row.index", "linha.numero", "linha.número")
PREFIXES = ("checkbox", "date", "dropdown", "single_choice", "default_or_text")
FIELD_ID = r"(?U)^[^\W\d_][\w.-]*$"
CHECKED, UNCHECKED = "☑", "☐"


def tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """A row for each tag of each text, in order: ``token_pos`` and ``token``."""
    return df.select("*", F.posexplode(F.regexp_extract_all(text, F.lit(TAG), F.lit(1))).alias("token_pos", "token"))


def parse(token: Column) -> Column:
    """STRUCT<kind, tag_type, field_id, type, options, default_value, error> of a tag's inside."""
    value = F.trim(token)
    low = casefold(value)
    colon = F.instr(value, ":")
    head = F.when(colon > 0, F.trim(casefold(F.left(value, colon - 1))))
    body = F.substring(value, colon + 1, F.length(value))
    known = head.isin(*PREFIXES)
    parts = F.transform(F.split(body, r"\|", -1), lambda x: F.trim(x))
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    listed = head.isin("dropdown", "single_choice")
    repeat = F.startswith(low, F.lit("repeat:"))
    field_id = F.when(repeat, F.trim(body)).when(known & head.isin("checkbox", "date"), F.trim(body)).when(known, parts[0]).otherwise(value)
    options = F.when(known & listed, F.filter(rest, lambda x: x != "")).otherwise(F.expr("cast(array() as array<string>)"))
    default = F.when(head == "default_or_text", F.trim(F.array_join(rest, "|")))
    typed = F.when(repeat | low.isin(*ROW_NUMBERS), F.lit("text")).when(known & listed, "dropdown").when(head == "default_or_text", "multiline").when(head.isin("checkbox", "date"), head).otherwise(guess(value))
    error = (
        F.when((repeat | known) & (field_id == ""), "missing id")
        .when((head == "single_choice") & (F.size(options) < 2), "too few options")
        .when((head == "dropdown") & (F.size(options) < 1), "no options")
        .when((head == "default_or_text") & (default == ""), "no default")
    )
    kind = F.when(repeat, "repeat").when(low.isin(*ROW_NUMBERS), "row_number").otherwise("field")
    tag_type = F.when(repeat, "repeat").when(low.isin(*ROW_NUMBERS), "row_number").when(known, head)
    return F.struct(kind.alias("kind"), tag_type.alias("tag_type"), field_id.alias("field_id"), typed.alias("type"), options.alias("options"), default.alias("default_value"), error.alias("error"))


def valid_id(x: Column) -> Column:
    return x.rlike(FIELD_ID)


def health(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Per key: tags, distinct valid ids, malformed ids, repeated occurrences, unmatched openings and closings."""
    ids = F.transform(F.regexp_extract_all(text, F.lit(TAG), F.lit(1)), lambda t: parse(t)["field_id"])
    count = lambda s: F.floor((F.length(text) - F.length(F.replace(F.col(text), F.lit(s), F.lit("")))) / 2).cast("long")
    rows = df.select(key, ids.alias("ids"), count("{{").alias("opened"), count("}}").alias("closed"))
    valid = F.array_distinct(F.filter("ids", valid_id))
    bad = F.array_distinct(F.filter("ids", lambda x: ~valid_id(x)))
    n = F.size("ids").cast("long")
    return rows.select(
        key, n.alias("tags"), F.size(valid).cast("long").alias("valid_ids"), F.size(bad).cast("long").alias("malformed"),
        (n - F.size(F.array_distinct("ids"))).alias("repeated"), F.greatest(F.col("opened") - n, F.lit(0)).alias("unmatched_open"), F.greatest(F.col("closed") - n, F.lit(0)).alias("unmatched_close"),
    )


def scan_fields(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per (key, field id): first position, occurrences, label, and the type, where a typed tag beats text."""
    rows = tokens(df, text).withColumn("p", parse(F.col("token"))).filter((F.col("p.kind") == "field") & F.col("p.error").isNull())
    strong = F.min(F.when(F.col("p.type") != "text", F.struct("token_pos", F.col("p.type").alias("type"))))
    got = rows.groupBy(key, F.col("p.field_id").alias("field_id")).agg(F.min("token_pos").alias("first_pos"), F.count("*").alias("occurrences"), strong.alias("s"))
    return got.select(key, "field_id", "first_pos", "occurrences", labels.from_id(F.col("field_id")).alias("label"), F.coalesce("s.type", F.lit("text")).alias("type"))


def render(df: DataFrame, answers: str, text: str = "text") -> DataFrame:
    """Add ``rendered``, and ``unresolved`` (sorted distinct tags without an answer).

    ``answers`` is a column MAP<field id, text>. Check boxes become glyphs, a default stands in for a missing answer, and
    a tag without either stays. One projection: the text is split at its tags and joined again, nothing is shuffled.
    """
    found = F.regexp_extract_all(text, F.lit(TAG), F.lit(1))

    def filled(token: Column) -> Column:
        p = parse(token)
        value = F.col(answers)[p["field_id"]]
        box = F.when(casefold(value).isin("1", "true", "yes", "sim", "checked", "marcado", "x", CHECKED), CHECKED).otherwise(UNCHECKED)
        given = F.when(p["tag_type"] == "checkbox", F.when(value.isNotNull(), box)).otherwise(value)
        return F.coalesce(given, F.when(p["tag_type"] == "default_or_text", p["default_value"]))

    rows = df.withColumn("r_tokens", found).withColumn("r_values", F.transform("r_tokens", filled)).withColumn("r_between", F.split(text, r"\{\{[^{}]+\}\}", -1))
    whole = F.zip_with("r_tokens", "r_values", lambda t, v: F.coalesce(v, F.concat(F.lit("{{"), t, F.lit("}}"))))
    rendered = F.array_join(F.zip_with("r_between", whole, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    left = F.zip_with("r_tokens", "r_values", lambda t, v: F.when(v.isNull(), t))
    return rows.withColumn("rendered", rendered).withColumn("unresolved", F.array_sort(F.array_distinct(F.filter(left, lambda x: x.isNotNull())))).drop("r_tokens", "r_values", "r_between")


def fill_pattern(pattern: Column, pairs: Column) -> Column:
    """Replace ``{{key}}`` and ``{{date:key}}`` for each (key, value) struct in order; a value's own tags are seen by later pairs."""
    step = lambda acc, p: F.replace(F.replace(acc, F.concat(F.lit("{{"), p["key"], F.lit("}}")), p["value"]), F.concat(F.lit("{{date:"), p["key"], F.lit("}}")), p["value"])
    return F.aggregate(pairs, pattern, step)
