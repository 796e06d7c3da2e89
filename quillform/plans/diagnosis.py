"""Queries on diagnosis, filters and profiles, each with DuckDB SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnosis, filters, profiles, rules
from .forms import table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


_F = """f AS (SELECT p_size AS template_id, p_partkey AS pos, CASE WHEN p_partkey % 13 = 0 THEN '' WHEN p_partkey % 17 = 0 THEN '9x' || CAST(p_partkey AS VARCHAR) ELSE 'f' || CAST(p_partkey % 40 AS VARCHAR) END AS id,
 CASE WHEN p_partkey % 3 = 0 THEN 'dropdown' WHEN p_partkey % 5 = 0 THEN 'repeatable_table' ELSE 'text' END AS type, CASE p_partkey % 4 WHEN 0 THEN ['a', 'a'] WHEN 1 THEN ['a', 'b'] ELSE ['a', 'b', 'b'] END AS options,
 CASE WHEN p_partkey % 2 = 0 THEN ['c', 'd', 'c'] WHEN p_partkey % 7 = 0 THEN [] ELSE ['c', 'd'] END AS columns, p_partkey % 6 > 0 AS cond, p_partkey % 9 > 0 AS obj, p_partkey % 10 > 0 AS cmp, CASE WHEN p_partkey % 8 = 0 THEN '' ELSE 'f' || CAST(p_partkey % 40 + 1 - 2 * (p_partkey % 2) AS VARCHAR) END AS dep FROM part)"""
_CYCLES = """u AS (SELECT template_id, id FROM f WHERE id <> '' GROUP BY ALL HAVING count(*) = 1), e AS (SELECT f.template_id, f.id, dep FROM f JOIN u ON u.template_id = f.template_id AND u.id = f.id JOIN u AS v ON v.template_id = f.template_id AND v.id = dep WHERE cond AND obj),
r AS (SELECT template_id, id AS a, dep AS b FROM e UNION SELECT r.template_id, a, dep FROM r JOIN e ON e.template_id = r.template_id AND e.id = b), y AS (SELECT DISTINCT template_id, a AS id FROM r WHERE a = b),
g AS (SELECT y.template_id, y.id, min(b) AS grp FROM y JOIN r ON r.template_id = y.template_id AND a = y.id GROUP BY ALL), z AS (SELECT template_id, grp, list(id ORDER BY id) AS members FROM g GROUP BY ALL)"""


def _fields(spark, sf_dir):
    k = F.col("p_partkey")
    dep = F.when(k % 8 == 0, "").otherwise(F.concat(F.lit("f"), (k % 40 + 1 - 2 * (k % 2)).cast("string")))
    texts = lambda *xs: F.array(*[F.lit(x) for x in xs])
    return table(spark, sf_dir, "part").select(
        F.col("p_size").alias("template_id"), k.alias("pos"), F.when(k % 13 == 0, "").when(k % 17 == 0, F.concat(F.lit("9x"), k.cast("string"))).otherwise(F.concat(F.lit("f"), (k % 40).cast("string"))).alias("id"), F.col("p_name").alias("label"),
        F.when(k % 3 == 0, "dropdown").when(k % 5 == 0, "repeatable_table").otherwise("text").alias("type"), F.when(k % 4 == 0, texts("a", " a ")).when(k % 4 == 1, texts("a", "b", " ")).otherwise(texts("a", "b", "b")).alias("options"),
        F.when(k % 2 == 0, texts("c", "d", "c")).when(k % 7 == 0, F.expr("cast(array() as array<string>)")).otherwise(texts("c", "d")).alias("columns"),
        F.when(k % 6 > 0, F.struct((k % 9 > 0).alias("object"), dep.alias("field"), (k % 10 > 0).alias("compares"))).alias("condition"),
    )


def _whole(spark, sf_dir):
    """Templates, configured fields, scanned fields and tag health."""
    fields = _fields(spark, sf_dir)
    t = F.col("template_id")
    templates = fields.select("template_id").distinct().select("template_id", F.when(t % 11 > 0, F.concat(F.lit("Modelo "), t.cast("string"))).otherwise(" ").alias("name"), (t % 7 > 0).alias("has_source"), F.array(F.lit("year"), F.concat(F.lit("f"), (t % 45).cast("string"))).alias("filename_tokens"))
    j = F.col("j")
    scanned = templates.select("template_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("j")).select("template_id", F.concat(F.lit("f"), j.cast("string")).alias("id"), F.when(j % 4 == 0, "dropdown").when(j % 4 == 1, "date").otherwise("text").alias("type"), F.array(F.when(j % 2 == 0, "word/document.xml").otherwise("word/header1.xml")).alias("parts"))
    health = templates.select("template_id", F.when(t % 5 == 0, F.array(F.lit("9z"))).otherwise(F.expr("cast(array() as array<string>)")).alias("malformed"), (t % 3 - 1).alias("unmatched"))
    return templates, fields, scanned, health


_T = """t AS (SELECT DISTINCT template_id, template_id % 7 > 0 AS src, 'f' || CAST(template_id % 45 AS VARCHAR) AS token, template_id % 11 > 0 AS named FROM f),
s AS (SELECT template_id, 'f' || CAST(j AS VARCHAR) AS id, CASE j % 4 WHEN 0 THEN 'dropdown' WHEN 1 THEN 'date' ELSE 'text' END AS type, CASE WHEN j % 2 = 0 THEN 'word/document.xml' ELSE 'word/header1.xml' END AS part FROM t, range(30) AS x(j)),
c AS (SELECT template_id, id, count(*) AS n, arg_max(type, pos) AS type FROM f WHERE id <> '' GROUP BY ALL), w AS (SELECT * FROM f WHERE id <> '')"""
_ISSUES = f"""WITH RECURSIVE {_F}, {_CYCLES}, {_T}, i AS (
SELECT template_id, 'source.missing' AS code, '' AS field_id, '' AS detail FROM t WHERE NOT src
UNION ALL SELECT s.template_id, 'field.missing_config', s.id, '' FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.template_id = s.template_id AND c.id = s.id)
UNION ALL SELECT c.template_id, 'field.unused_config', c.id, '' FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE c.template_id = s.template_id AND c.id = s.id)
UNION ALL SELECT c.template_id, 'field.type_mismatch', c.id, c.type || '/' || s.type FROM c JOIN s ON c.template_id = s.template_id AND c.id = s.id WHERE s.type IN ('checkbox', 'date', 'dropdown', 'repeatable_table') AND c.type <> s.type
UNION ALL SELECT template_id, 'field.duplicate_id', id, '' FROM c WHERE n > 1
UNION ALL SELECT template_id, 'field.invalid_id', id, '' FROM c WHERE id LIKE '9%'
UNION ALL SELECT template_id, 'condition.invalid', '', id || ': not an object' FROM w WHERE cond AND NOT obj
UNION ALL SELECT template_id, 'condition.invalid', '', id || ': no field' FROM w WHERE cond AND obj AND dep = ''
UNION ALL SELECT template_id, 'condition.invalid', '', id || ': unknown field ' || dep FROM w WHERE cond AND obj AND dep <> '' AND NOT EXISTS (SELECT 1 FROM c WHERE c.template_id = w.template_id AND c.id = dep)
UNION ALL SELECT template_id, 'condition.invalid', '', id || ': no comparison' FROM w WHERE cond AND obj AND NOT cmp
UNION ALL SELECT template_id, 'condition.cycle', '', array_to_string(members, ' ') FROM z
UNION ALL SELECT template_id, 'dropdown.no_options', id, '' FROM w WHERE type = 'dropdown' AND len(list_distinct(options)) < 2
UNION ALL SELECT template_id, 'dropdown.duplicate_options', id, '' FROM w WHERE type = 'dropdown' AND len(list_distinct(options)) < len(options)
UNION ALL SELECT template_id, 'table.no_columns', id, '' FROM w WHERE type = 'repeatable_table' AND len(columns) = 0
UNION ALL SELECT template_id, 'table.duplicate_columns', id, '' FROM w WHERE type = 'repeatable_table' AND len(list_distinct(columns)) < len(columns)
UNION ALL SELECT template_id, 'output.unknown_token', '', token FROM t WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.template_id = t.template_id AND c.id = token)
UNION ALL SELECT template_id, 'tag.malformed', '', '9z' FROM t WHERE template_id % 5 = 0
UNION ALL SELECT template_id, 'tag.unmatched_braces', '', '' FROM t WHERE template_id % 3 = 2),
q AS (SELECT i.*, CASE WHEN code IN ('field.missing_config', 'field.unused_config', 'field.type_mismatch', 'dropdown.duplicate_options', 'output.unknown_token') THEN 'warning' ELSE 'error' END AS severity, code IN ('field.missing_config', 'field.type_mismatch') AS safe_fix FROM i)"""


def _found(spark, sf_dir):
    templates, fields, scanned, health = _whole(spark, sf_dir)
    return templates, diagnosis.diagnose(templates, fields, scanned, health)


@query(f"{_ISSUES} SELECT q.template_id, code, severity, field_id, detail, safe_fix, coalesce(part, '') AS locations FROM q LEFT JOIN s ON s.template_id = q.template_id AND s.id = field_id")
def template_diagnosis(spark, sf_dir):
    return _found(spark, sf_dir)[1].withColumn("locations", F.array_join("locations", ","))


@query(f"{_ISSUES} SELECT t.template_id, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(code) = 0 AS ok, count(*) FILTER (WHERE severity = 'error') > 0 AS blocking, coalesce(bool_or(safe_fix), FALSE) AS safe_fix_available FROM t LEFT JOIN q USING (template_id) GROUP BY t.template_id")
def template_verdicts(spark, sf_dir):
    return diagnosis.verdicts(*_found(spark, sf_dir))


@query(f"""{_ISSUES}, n AS (SELECT template_id, code, count(*) AS n FROM q GROUP BY ALL), m AS (SELECT template_id, code, n, CASE code WHEN 'source.missing' THEN 0 WHEN 'field.missing_config' THEN 1 WHEN 'field.unused_config' THEN 2 WHEN 'field.type_mismatch' THEN 3 WHEN 'field.duplicate_id' THEN 4 WHEN 'field.invalid_id' THEN 5
 WHEN 'condition.invalid' THEN 6 WHEN 'condition.cycle' THEN 7 WHEN 'dropdown.no_options' THEN 8 WHEN 'dropdown.duplicate_options' THEN 9 WHEN 'table.no_columns' THEN 10 WHEN 'table.duplicate_columns' THEN 11 WHEN 'output.unknown_token' THEN 12 WHEN 'tag.malformed' THEN 13 ELSE 14 END AS o FROM n)
SELECT template_id, string_agg(CASE code WHEN 'source.missing' THEN 'O DOCX de origem está ausente.' WHEN 'tag.unmatched_braces' THEN 'Foram detectadas chaves de marcadores sem par no DOCX.' ELSE 'Foram detectados ' || CAST(n AS VARCHAR) || ' ' || CASE code
 WHEN 'field.missing_config' THEN 'campo(s) do DOCX não possuem configuração' WHEN 'field.unused_config' THEN 'campo(s) configurados não aparecem no DOCX' WHEN 'field.type_mismatch' THEN 'incompatibilidade(s) de tipo de campo' WHEN 'field.duplicate_id' THEN 'ID(s) de campo configurado duplicados' WHEN 'field.invalid_id' THEN 'ID(s) de campo configurado são inválidos'
 WHEN 'condition.invalid' THEN 'problema(s) em regras condicionais' WHEN 'condition.cycle' THEN 'ciclo(s) em regras condicionais' WHEN 'dropdown.no_options' THEN 'lista(s) suspensa(s) não possuem opções' WHEN 'dropdown.duplicate_options' THEN 'lista(s) suspensa(s) possuem opções repetidas' WHEN 'table.no_columns' THEN 'tabela(s) repetível(is) não possuem colunas'
 WHEN 'table.duplicate_columns' THEN 'tabela(s) repetível(is) possuem IDs de coluna duplicados' WHEN 'output.unknown_token' THEN 'marcador(es) do nome do arquivo são desconhecidos' ELSE 'marcador(es) malformados' END || '.' END, '|' ORDER BY o) AS messages FROM m GROUP BY template_id""")
def diagnosis_warnings(spark, sf_dir):
    return diagnosis.warnings(_found(spark, sf_dir)[1]).withColumn("messages", F.array_join("messages", "|"))


@query(f"{_ISSUES} SELECT template_id FROM t WHERE template_id NOT IN (SELECT template_id FROM q WHERE severity = 'error' AND code IN ('source.missing', 'tag.malformed', 'tag.unmatched_braces', 'condition.cycle'))")
def preflight_gate(spark, sf_dir):
    """Templates whose source is there, with whole tags and no cycle."""
    templates, issues = _found(spark, sf_dir)
    return diagnosis.allowed(templates, issues.filter(F.col("code").rlike("^(source|tag)|cycle"))).select("template_id")


@query(f"WITH RECURSIVE {_F}, {_CYCLES} SELECT template_id, array_to_string(members, ',') AS members FROM z")
def condition_cycle_sets(spark, sf_dir):
    return diagnosis.condition_cycles(_fields(spark, sf_dir)).withColumn("members", F.array_join("members", ","))


@query(f"""WITH {_F}, {_T}, x AS (SELECT template_id, id, type, options, columns, count(*) OVER (PARTITION BY template_id, id) AS same FROM f),
g AS (SELECT template_id, NOT bool_or(id <> '' AND same > 1) AS u, NOT bool_or(id LIKE '9%') AS v, NOT bool_or(type = 'dropdown' AND len(list_distinct(options)) < 2) AS o, NOT bool_or(type = 'repeatable_table' AND len(columns) = 0) AS k, list(id) AS ids FROM x GROUP BY template_id)
SELECT t.template_id, concat_ws(',', CASE WHEN k THEN 'columns' END, 'fields', CASE WHEN list_contains(ids, token) THEN 'filename_tokens' END, CASE WHEN named THEN 'name' END, CASE WHEN o THEN 'options' END, CASE WHEN src THEN 'source' END, CASE WHEN t.template_id % 5 > 0 AND t.template_id % 3 < 2 THEN 'tags' END, CASE WHEN u THEN 'unique_ids' END, CASE WHEN v THEN 'valid_ids' END) AS passed,
 k AND list_contains(ids, token) AND named AND o AND src AND t.template_id % 5 > 0 AND t.template_id % 3 < 2 AND u AND v AS ready FROM t JOIN g USING (template_id)""")
def readiness_checks(spark, sf_dir):
    templates, fields, _, health = _whole(spark, sf_dir)
    made = diagnosis.readiness(templates, fields, health)
    passed = F.array_sort(F.transform(F.filter(F.map_entries("checks"), lambda e: e["value"]), lambda e: e["key"]))
    return made.select("template_id", F.array_join(passed, ",").alias("passed"), "ready")


@query(f"""WITH RECURSIVE {_F}, {_CYCLES}, n AS (SELECT *, count(*) OVER (PARTITION BY template_id, id) AS same FROM f), i AS (
SELECT template_id, pos, 'table.columns_missing' AS code FROM f WHERE type = 'repeatable_table' AND len(columns) = 0 UNION ALL SELECT template_id, pos, 'table.columns_duplicate' FROM f WHERE type = 'repeatable_table' AND len(list_distinct(columns)) < len(columns)
UNION ALL SELECT template_id, pos, 'condition.invalid' FROM f WHERE cond AND NOT obj UNION ALL SELECT template_id, pos, 'condition.comparison_missing' FROM f WHERE cond AND obj AND NOT cmp UNION ALL SELECT template_id, pos, 'condition.field_missing' FROM f WHERE cond AND obj AND dep = ''
UNION ALL SELECT template_id, pos, 'condition.field_unknown' FROM f WHERE cond AND obj AND dep <> '' AND NOT EXISTS (SELECT 1 FROM f AS o WHERE o.template_id = f.template_id AND o.id = f.dep)
UNION ALL SELECT n.template_id, pos, 'condition.cycle' FROM n JOIN y ON y.template_id = n.template_id AND y.id = n.id WHERE same = 1
UNION ALL SELECT template_id, pos, 'detection.low_confidence' FROM f WHERE pos % 20 < 13 AND pos % 2 = 0 UNION ALL SELECT template_id, pos, 'detection.medium_confidence' FROM f WHERE pos % 20 BETWEEN 13 AND 16 AND pos % 2 = 0)
SELECT * FROM i""")
def condition_and_table_issues(spark, sf_dir):
    """The issues that need columns, conditions, cycles and detections."""
    f = _fields(spark, sf_dir)
    f = f.withColumn("depends_on", F.col("condition.field")).withColumn("condition_object", F.col("condition.object")).withColumn("condition_compares", F.col("condition.compares")).drop("condition")
    f = f.withColumn("detection_source", F.when(F.col("pos") % 2 == 0, " Automatic").otherwise("manual")).withColumn("detection_confidence", (F.col("pos") % 20) / 20).withColumn("detection_reviewed", F.lit(False))
    return rules.quality_issues(f).select("template_id", "pos", "code").filter(F.col("code").rlike("^(table|condition|detection)"))


# ---------------------------------------------------------------- filters

_CAND = "SELECT o_orderkey AS k, 'auto.' || lower(o_orderpriority) AS field_id, o_orderpriority AS label, 'Área ' || o_orderstatus AS preview, 'inline' AS source, CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS band, CASE o_orderkey % 2 WHEN 0 THEN 'ready' ELSE 'required' END AS priority, CASE o_orderkey % 5 WHEN 0 THEN 'date' ELSE 'text' END AS type FROM orders"


@query(f"SELECT k FROM ({_CAND}) WHERE contains(lower(field_id || ' ' || label || ' ' || preview || ' ' || source), 'área f') AND band = 'medium' AND priority = 'required' AND type = 'text'")
def candidate_filter(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), F.concat(F.lit("auto."), F.lower("o_orderpriority")).alias("field_id"), F.col("o_orderpriority").alias("label"), F.concat(F.lit("Área "), "o_orderstatus").alias("preview"), F.lit("inline").alias("source"), F.when(k % 3 == 0, "high").when(k % 3 == 1, "medium").otherwise("low").alias("band"), F.when(k % 2 == 0, "ready").otherwise("required").alias("priority"), F.when(k % 5 == 0, "date").otherwise("text").alias("type"))
    return filters.candidates(rows, " ÁREA F ", "medium", "required", "text").select("k")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_brand || ' ' || p_name || ' ' || p_type), 'brand#1') AND p_size % 2 = 0 AND p_partkey % 3 = 1")
def field_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("id"), F.col("p_name").alias("label"), F.col("p_type").alias("section"), F.when(F.col("p_size") % 2 == 0, "date").otherwise("text").alias("type"), F.when(F.col("p_partkey") % 3 == 1, "error").otherwise("ok").alias("status"))
    return filters.fields(rows, "BRAND#1", "date", "error").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', CAST(p_partkey AS VARCHAR), p_name, p_brand)), '#2')")
def template_filter(spark, sf_dir):
    return filters.anywhere(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), "#2").select("p_partkey")


@query("SELECT p_partkey, len(list_filter(string_split(p_type, ' '), lambda x: contains(lower(x || ' v ' || x), 'n v'))) AS n FROM part")
def option_filter(spark, sf_dir):
    made = F.transform(F.split("p_type", " "), lambda x: F.struct(F.concat(x, F.lit(" v")).alias("label"), x.alias("value")))
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("o")).select("p_partkey", F.size(filters.options("o", "  N \t V ")).cast("long").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'N' THEN CASE l_linenumber % 3 WHEN 0 THEN 'false' WHEN 1 THEN '[]' ELSE '' END ELSE l_linestatus END AS value FROM lineitem")
def visible_values(spark, sf_dir):
    n = F.col("l_linenumber") % 3
    kind = F.when(n == 0, "checkbox").when(n == 1, "repeatable_table").otherwise("text")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", filters.neutral(F.col("l_linestatus"), kind, F.col("l_returnflag") != "N").alias("value"))


@query("SELECT DISTINCT o_custkey FROM orders WHERE CASE o_orderkey % 4 WHEN 0 THEN o_orderstatus = 'F' WHEN 1 THEN o_orderstatus = 'O' WHEN 2 THEN FALSE ELSE o_orderkey % 3 = 0 END")
def meaningful_forms(spark, sf_dir):
    """Forms with an answer: a checked box, a text, no automatic date, or a table with a filled cell."""
    k = F.col("o_orderkey") % 4
    kind = F.when(k == 0, "checkbox").when(k == 1, "text").when(k == 2, "date").otherwise("repeatable_table")
    value = F.when(k == 0, F.when(F.col("o_orderstatus") == "F", "True").otherwise("false")).when(k == 1, F.when(F.col("o_orderstatus") == "O", "x").otherwise("  ")).when(k == 2, "01/01/2026")
    cell = F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(" ")
    rows = F.when(k == 3, F.array(F.create_map(F.lit("a"), F.lit(""), F.lit("__id"), F.lit("7")), F.create_map(F.lit("a"), cell, F.lit("__id"), F.lit("8"))))
    a = table(spark, sf_dir, "orders").select("o_custkey", kind.alias("type"), value.alias("value"), rows.alias("rows"), F.lit(True).alias("automatic"))
    return filters.meaningful_forms(a, "o_custkey")


# ---------------------------------------------------------------- profiles

_P = """f AS (SELECT c_nationkey AS k, c_custkey AS pos, 'id' || CAST(c_custkey % 50 AS VARCHAR) AS field_id, CASE c_custkey % 4 WHEN 0 THEN 'company.name' WHEN 1 THEN 'id' || CAST((c_custkey + 1) % 50 AS VARCHAR) ELSE '' END AS profile_key, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS value FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_custkey % 50 ORDER BY c_custkey) = 1)"""


@query(f"""WITH {_P}, r AS (SELECT k, field_id AS name, value, 0 AS rk, pos FROM f UNION ALL SELECT k, profile_key, value, 1, pos FROM f WHERE profile_key <> '' AND profile_key <> field_id)
SELECT k, name, value FROM r QUALIFY row_number() OVER (PARTITION BY k, name ORDER BY value = '', rk, pos) = 1""")
def profile_payload(spark, sf_dir):
    from pyspark.sql import Window as W

    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    one = c.withColumn("n", F.row_number().over(W.partitionBy("c_nationkey", k % 50).orderBy("c_custkey"))).filter("n = 1")
    f = one.select(F.col("c_nationkey").alias("k"), k.alias("pos"), F.concat(F.lit("id"), (k % 50).cast("string")).alias("field_id"), F.when(k % 4 == 0, "company.name").when(k % 4 == 1, F.concat(F.lit("id"), ((k + 1) % 50).cast("string"))).otherwise("").alias("profile_key"), F.when(k % 3 == 0, "").otherwise(F.col("c_name")).alias("value"))
    return profiles.payload(f.drop("value"), f.select("k", "field_id", "value"), "k")


@query("""SELECT n_nationkey AS k, field_id, CASE field_id WHEN 'a' THEN 'exact' WHEN 'b' THEN 'by key' WHEN 'auto.nome' THEN 'by label' WHEN 'pdf_1' THEN n_name WHEN 'd' THEN '01/02/2026' WHEN 'c' THEN 'false' ELSE '' END AS value, CASE field_id WHEN 'a' THEN 1 WHEN 'b' THEN 2 WHEN 'auto.nome' THEN 3 WHEN 'pdf_1' THEN 4 END AS stage
FROM nation, (SELECT unnest(['a', 'b', 'auto.nome', 'pdf_1', 'c', 'd', 'e']) AS field_id)""")
def profile_stages(spark, sf_dir):
    """Each nation's form, filled from its saved answers in four stages, and by type where nothing was saved."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    rows = [("a", "A", "text", ""), ("b", "B", "text", "company.name"), ("auto.nome", "1. Nome do dono", "text", ""), ("pdf_1", "Razão Social", "text", ""), ("c", "Aceite", "checkbox", ""), ("d", "Dia", "date", ""), ("e", "Nome", "text", "")]
    f = n.select("k", F.posexplode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("field_id", "label", "type", "profile_key"), r, strict=True)]) for r in rows])).alias("pos", "f")).select("k", "pos", "f.*").withColumn("section", F.lit(""))
    saved = n.select("k", F.explode(F.map_from_arrays(F.array(*[F.lit(x) for x in ("a", "company.name", "velho.1", "chefe.razao_social", "x.nome")]), F.array(F.lit("exact"), F.lit("by key"), F.lit("by label"), F.col("n_name"), F.lit("no")))).alias("name", "value"))
    described = profiles.identities(n.select("k", F.lit("velho.1").alias("field_id"), F.lit("Nome do dono").alias("label"), F.lit("text").alias("type"), F.lit("").alias("section")), "k")
    return profiles.history_values(profiles.resolve(f, saved, described, "k"), "01/02/2026").select("k", "field_id", "value", "stage")
