"""Queries on formats, types, tags, rules and rendering, each with DuckDB SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, text, types
from ..operators import rules, tags

QUERIES, ORACLES = {}, {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


# ---------------------------------------------------------------- formats

_KEY = "lpad(CAST(c_custkey * 7919 AS VARCHAR), 9, '0') || lpad(CAST(c_custkey AS VARCHAR), 7, '3')"


def _digits(spark, sf_dir):
    """Customers with 0 to 16 digits each."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    whole = F.concat(F.lpad((F.col("c_custkey") * 7919).cast("string"), 9, "0"), F.lpad(F.col("c_custkey").cast("string"), 7, "3"))
    return c.withColumn("d", F.left(whole, (F.col("c_custkey") % 17).cast("int")))


def _format_sql(case: str) -> str:
    return f"WITH k AS (SELECT c_custkey, left({_KEY}, CAST(c_custkey % 17 AS INT)) AS d FROM customer) SELECT c_custkey, {case} AS formatted FROM k"


@query(_format_sql("CASE WHEN length(d) <= 2 THEN d WHEN length(d) <= 5 THEN d[1:2] || '.' || d[3:] WHEN length(d) <= 8 THEN d[1:2] || '.' || d[3:5] || '.' || d[6:] WHEN length(d) <= 12 THEN d[1:2] || '.' || d[3:5] || '.' || d[6:8] || '/' || d[9:] ELSE d[1:2] || '.' || d[3:5] || '.' || d[6:8] || '/' || d[9:12] || '-' || d[13:14] END"))
def format_cnpj(spark, sf_dir):
    return _digits(spark, sf_dir).select("c_custkey", formats.cnpj(F.col("d")).alias("formatted"))


@query(_format_sql("CASE WHEN length(d) <= 3 THEN d WHEN length(d) <= 6 THEN d[1:3] || '.' || d[4:] WHEN length(d) <= 9 THEN d[1:3] || '.' || d[4:6] || '.' || d[7:] ELSE d[1:3] || '.' || d[4:6] || '.' || d[7:9] || '-' || d[10:11] END"))
def format_cpf(spark, sf_dir):
    return _digits(spark, sf_dir).select("c_custkey", formats.cpf(F.col("d")).alias("formatted"))


@query(_format_sql("CASE WHEN length(d) <= 5 THEN d ELSE d[1:5] || '-' || d[6:8] END"))
def format_cep(spark, sf_dir):
    return _digits(spark, sf_dir).select("c_custkey", formats.cep(F.col("d")).alias("formatted"))


@query(_format_sql("CASE WHEN length(d) <= 2 THEN d WHEN length(d) <= 6 THEN '(' || d[1:2] || ') ' || d[3:] WHEN length(d) <= 10 THEN '(' || d[1:2] || ') ' || d[3:6] || '-' || d[7:] ELSE '(' || d[1:2] || ') ' || d[3:7] || '-' || d[8:11] END"))
def format_phone(spark, sf_dir):
    return _digits(spark, sf_dir).select("c_custkey", formats.phone(F.col("d")).alias("formatted"))


@query("SELECT o_orderkey, 'R$ ' || translate(format('{:,.2f}', CAST(floor(o_totalprice * 100) AS BIGINT) / 100.0), ',.', '.,') AS formatted FROM orders")
def format_currency(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", formats.currency(F.floor(F.col("o_totalprice") * 100)).alias("formatted"))


@query("SELECT l_orderkey, l_linenumber, translate(format('{:,.2f}', CAST(floor(l_extendedprice * 100) AS BIGINT) / 100.0), ',.', '.,') AS formatted FROM lineitem")
def format_decimal(spark, sf_dir):
    """Prices written the Brazilian way, read and written again."""
    written = formats.currency(F.floor(F.col("l_extendedprice") * 100))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", formats.decimal(written).alias("formatted"))


@query("""SELECT l_orderkey, l_linenumber, CAST(n // 1000 AS VARCHAR) || CASE WHEN n % 1000 = 0 THEN '' ELSE ',' || left(lpad(CAST(n % 1000 AS VARCHAR), 3, '0'), 2) END || '%' AS formatted
FROM (SELECT l_orderkey, l_linenumber, l_orderkey * 37 % 100000 AS n FROM lineitem)""")
def format_percentage(spark, sf_dir):
    n = F.col("l_orderkey") * 37 % 100000
    sep = F.when(F.col("l_linenumber") % 2 == 0, ",").otherwise(".")
    raw = F.concat(F.floor(n / 1000).cast("string"), F.when(n % 1000 == 0, "").otherwise(F.concat(sep, F.lpad((n % 1000).cast("string"), 3, "0"))), F.lit(" %"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", formats.percentage(raw).alias("formatted"))


_CPF9 = "lpad(CAST(c_custkey * 1234577 % 1000000000 AS VARCHAR), 9, '0')"
_DIGIT = "list_sum(list_transform(range(1, {n} + 1), lambda i: CAST({x}[i] AS INT) * ({n} + 2 - i)))"


@query(f"""WITH k AS (SELECT c_custkey, {_CPF9} AS b FROM customer),
a AS (SELECT *, {_DIGIT.format(n=9, x='b')} * 10 % 11 % 10 AS d1 FROM k),
e AS (SELECT *, b || CAST(d1 AS VARCHAR) AS b2 FROM a),
f AS (SELECT *, b2 || CAST({_DIGIT.format(n=10, x='b2')} * 10 % 11 % 10 AS VARCHAR) AS whole FROM e),
g AS (SELECT c_custkey, whole, CASE WHEN c_custkey % 3 = 0 THEN whole ELSE b || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') END AS cpf FROM f)
SELECT c_custkey, cpf, cpf = whole AND cpf <> repeat(cpf[1], 11) AS valid FROM g""")
def validate_cpf(spark, sf_dir):
    b = F.lpad((F.col("c_custkey") * 1234577 % 1000000000).cast("string"), 9, "0")
    d1 = formats._weighted(b, list(range(10, 1, -1))) * 10 % 11 % 10
    b2 = F.concat(b, d1.cast("string"))
    whole = F.concat(b2, (formats._weighted(b2, list(range(11, 1, -1))) * 10 % 11 % 10).cast("string"))
    cpf = F.when(F.col("c_custkey") % 3 == 0, whole).otherwise(F.concat(b, F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0")))
    return table(spark, sf_dir, "customer").select("c_custkey", cpf.alias("cpf")).withColumn("valid", formats.valid_cpf(F.col("cpf")))


_CNPJ12 = "lpad(CAST(l_orderkey * 7654321 % 100000000 AS VARCHAR), 8, '0') || '000' || CAST(l_linenumber % 10 AS VARCHAR)"
_MOD11 = "(CASE WHEN {s} % 11 < 2 THEN 0 ELSE 11 - {s} % 11 END)"
_S1 = "list_sum(list_transform(range(1, 13), lambda i: CAST(b[i] AS INT) * (CASE WHEN i <= 4 THEN 6 - i ELSE 14 - i END)))"
_S2 = "list_sum(list_transform(range(1, 14), lambda i: CAST(b2[i] AS INT) * (CASE WHEN i <= 5 THEN 7 - i ELSE 15 - i END)))"


@query(f"""WITH k AS (SELECT l_orderkey, l_linenumber, {_CNPJ12} AS b FROM lineitem),
a AS (SELECT *, b || CAST({_MOD11.format(s=_S1)} AS VARCHAR) AS b2 FROM k),
f AS (SELECT *, b2 || CAST({_MOD11.format(s=_S2)} AS VARCHAR) AS whole FROM a),
g AS (SELECT *, CASE WHEN l_orderkey % 2 = 0 THEN whole ELSE b || lpad(CAST(l_orderkey % 100 AS VARCHAR), 2, '0') END AS cnpj FROM f)
SELECT l_orderkey, l_linenumber, cnpj, cnpj = whole AS valid FROM g""")
def validate_cnpj(spark, sf_dir):
    b = F.concat(F.lpad((F.col("l_orderkey") * 7654321 % 100000000).cast("string"), 8, "0"), F.lit("000"), (F.col("l_linenumber") % 10).cast("string"))
    tail = [9, 8, 7, 6, 5, 4, 3, 2]

    def digit(x, weights):
        rest = formats._weighted(x, weights) % 11
        return F.when(rest < 2, 0).otherwise(11 - rest).cast("string")

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", b.alias("b"))
    rows = rows.withColumn("b2", F.concat("b", digit(F.col("b"), [5, 4, 3, 2, *tail])))
    whole = F.concat("b2", digit(F.col("b2"), [6, 5, 4, 3, 2, *tail]))
    cnpj = F.when(F.col("l_orderkey") % 2 == 0, whole).otherwise(F.concat("b", F.lpad((F.col("l_orderkey") % 100).cast("string"), 2, "0")))
    return rows.select("l_orderkey", "l_linenumber", cnpj.alias("cnpj")).withColumn("valid", formats.valid_cnpj(F.col("cnpj")))


# ---------------------------------------------------------------- types

_NAMES = ["empresa.cnpj", "cliente.cpf", "data_assinatura", "assinatura data", "valor_total", "quantidade", "e-mail", "cep", "telefone celular", "observacao", "percentual", "nome", "checkbox.aceito", "zip_code", "deadline", "approved", "preco unitario", "qty", "birthdate"]


def _any(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, '{n}')" for n in needles) + ")"


def _part(x: str, names) -> str:
    return f"list_has_any(regexp_split_to_array({x}, '[._\\-\\s/()]+'), [{', '.join(repr(n) for n in names)}])"


_GUESS = f"""CASE WHEN {_any('x', types.BOX)} THEN 'checkbox' WHEN {_part('x', ('date', 'data'))} OR regexp_replace(x, '[^a-z0-9áàâãéêíóôõúç]', '', 'g') IN {types.DATE_COMPACT} THEN 'date'
 WHEN {_any('x', types.GUESS_LONG_TEXT)} THEN 'multiline' WHEN contains(x, 'cnpj') THEN 'cnpj' WHEN regexp_matches(x, '(^|[._\\-\\s])cpf($|[._\\-\\s])') THEN 'cpf'
 WHEN {_part('x', ('cep',))} OR contains(x, 'postal') OR contains(x, 'código postal') THEN 'cep' WHEN {_any('x', types.PHONE)} THEN 'phone' WHEN {_any('x', ('email', 'e-mail'))} THEN 'email'
 WHEN {_any('x', types.MONEY + types.MONEY_SPACED)} THEN 'currency' WHEN {_any('x', types.PERCENT)} THEN 'percentage' WHEN {_part('x', types.QUANTITY)} THEN 'integer' ELSE 'text' END"""
_INFER = f"""CASE WHEN contains(x, 'cnpj') THEN 'cnpj' WHEN regexp_matches(x, '(^|[._\\-])cpf($|[._\\-])') THEN 'cpf' WHEN {_part('x', ('cep',))} OR contains(x, 'postal') THEN 'cep'
 WHEN {_any('x', types.PHONE)} THEN 'phone' WHEN {_any('x', ('email', 'e-mail'))} THEN 'email' WHEN {_any('x', types.MONEY)} THEN 'currency' WHEN {_any('x', types.PERCENT)} THEN 'percentage' WHEN {_part('x', types.QUANTITY)} THEN 'integer' ELSE 'text' END"""
_SUGGEST = f"""CASE WHEN contains(x, 'cnpj') THEN 'cnpj' WHEN regexp_matches(x, '(^|[._\\-\\s])cpf($|[._\\-\\s])') THEN 'cpf' WHEN {_any('x', ('email', 'e-mail'))} THEN 'email' WHEN {_any('x', types.PHONE)} THEN 'phone'
 WHEN {_part('x', ('cep',))} OR contains(x, 'postal') OR contains(x, 'zip_code') THEN 'cep' WHEN regexp_split_to_array(trim(x), '[._\\-\\s]+')[-1] IN {types.DATE_LAST} OR suffix(x, '.date') THEN 'date'
 WHEN {_any('x', (*types.PERCENT, 'tax_rate'))} THEN 'percentage' WHEN {_any('x', types.MONEY + types.MONEY_SPACED)} THEN 'currency' WHEN {_part('x', types.QUANTITY)} THEN 'integer'
 WHEN {_any('x', types.SUGGEST_LONG_TEXT)} THEN 'multiline' WHEN {_any('x', types.AGREE)} THEN 'checkbox' ELSE 'text' END"""


@query(f"""WITH n AS (SELECT n_nationkey, lower(n_name) || s || f AS x FROM nation, (SELECT unnest({_NAMES!r}) AS f), (SELECT unnest(['.', '_', ' ']) AS s))
SELECT n_nationkey, x AS field_id, {_GUESS} AS guessed, {_INFER} AS inferred, {_SUGGEST} AS suggested FROM n""")
def infer_type(spark, sf_dir):
    names = F.explode(F.array(*[F.lit(n) for n in _NAMES]))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", names.alias("f")).select("*", F.explode(F.array(F.lit("."), F.lit("_"), F.lit(" "))).alias("s"))
    x = F.concat(F.lower("n_name"), "s", "f")
    return n.select("n_nationkey", x.alias("field_id")).select("n_nationkey", "field_id", types.guess(F.col("field_id")).alias("guessed"), types.infer(F.col("field_id"), F.lit("text")).alias("inferred"), types.suggest(F.col("field_id")).alias("suggested"))


# ---------------------------------------------------------------- tags and rendering

_TEXT = "'Cliente: {{company.name}} Saldo: {{price.total}} {{checkbox:ok}} {{default_or_text:obs|sem observação}} {{segment}}'"


@query(f"""WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS name, CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) AS total, CASE WHEN c_custkey % 2 = 0 THEN 'sim' ELSE 'não' END AS ok, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS obs FROM customer)
SELECT c_custkey, 'Cliente: ' || coalesce(name, '{{{{company.name}}}}') || ' Saldo: ' || total || ' ' || CASE WHEN ok = 'sim' THEN '☑' ELSE '☐' END || ' ' || coalesce(obs, 'sem observação') || ' {{{{segment}}}}' AS rendered,
 CASE WHEN name IS NULL THEN 'company.name,segment' ELSE 'segment' END AS unresolved FROM a""")
def render_documents(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    answers = F.map_filter(
        F.create_map(
            F.lit("company.name"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")), F.lit("price.total"), F.floor("c_acctbal").cast("string"),
            F.lit("ok"), F.when(F.col("c_custkey") % 2 == 0, "sim").otherwise("não"), F.lit("obs"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")),
        ),
        lambda k, v: v.isNotNull(),
    )
    rows = c.select("c_custkey", F.lit(_TEXT[1:-1]).alias("text"), answers.alias("answers"))
    return tags.render(rows, "answers").select("c_custkey", "rendered", F.array_join("unresolved", ",").alias("unresolved"))


@query("""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS o, p_brand FROM part),
t AS (SELECT p_partkey, unnest([1, 2, 3, 4, 5]) AS k, o, p_brand FROM w)
SELECT p_partkey, k AS token_pos, CASE k WHEN 4 THEN 'repeat' WHEN 5 THEN 'row_number' ELSE 'field' END AS kind,
 CASE k WHEN 1 THEN 'part.options' WHEN 2 THEN 'part.day' WHEN 3 THEN 'other:part' WHEN 4 THEN 'items' ELSE 'row.number' END AS field_id,
 CASE k WHEN 1 THEN 'dropdown' WHEN 2 THEN 'date' ELSE 'text' END AS type,
 CASE WHEN k = 1 THEN array_to_string(list_filter(o, lambda x: x <> ''), ';') ELSE '' END AS options FROM t""")
def tag_parse(spark, sf_dir):
    made = F.concat(F.lit("{{dropdown: part.options |"), F.replace("p_name", F.lit(" "), F.lit(" | ")), F.lit("}} {{date:part.day}} {{other:part}} {{repeat: items}} {{row.number}}"))
    rows = tags.tokens(table(spark, sf_dir, "part").select("p_partkey", made.alias("text"))).withColumn("p", tags.parse(F.col("token")))
    return rows.select("p_partkey", (F.col("token_pos") + 1).alias("token_pos"), "p.kind", "p.field_id", "p.type", F.array_join("p.options", ";").alias("options"))


@query("""SELECT o_orderkey, CAST(3 + o_orderkey % 3 AS BIGINT) AS tags, CAST(2 AS BIGINT) AS valid_ids, CAST(CASE WHEN o_orderkey % 3 > 1 THEN 1 ELSE 0 END AS BIGINT) AS malformed,
 CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS BIGINT) AS repeated, CAST(o_orderkey % 2 AS BIGINT) AS unmatched_open, CAST(0 AS BIGINT) AS unmatched_close FROM orders""")
def tag_health(spark, sf_dir):
    k = F.col("o_orderkey")
    text_ = F.concat(F.lit("{{a.b}} {{date:c}} {{a.b}}"), F.when(k % 3 > 0, " {{c}}").otherwise(""), F.when(k % 3 > 1, " {{9x}}").otherwise(""), F.when(k % 2 == 1, " {{open").otherwise(""))
    return tags.health(table(spark, sf_dir, "orders").select("o_orderkey", text_.alias("text")), "o_orderkey")


@query("""SELECT o_orderkey, trim(regexp_replace(regexp_replace('Pedido-' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || '-' || o_orderpriority || '-' || o_orderstatus, '[<>:"/\\\\|?*]', '-', 'g'), '\\s+', ' ', 'g'), ' .') || '.docx' AS filename FROM orders""")
def filename_plan(spark, sf_dir):
    pairs = F.array(
        *[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("template.name", F.lit("Pedido")), ("sequence", F.lpad(F.col("o_orderkey").cast("string"), 6, "0")), ("order.priority", F.col("o_orderpriority")), ("order.status", F.col("o_orderstatus")))]
    )
    made = tags.fill_pattern(F.lit("{{template.name}}-{{sequence}}-{{order.priority}}-{{date:order.status}}"), pairs)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(text.safe_filename(made), F.lit(".docx")).alias("filename"))


@query("""SELECT o_orderkey, n AS row_number, lpad(CAST(n AS VARCHAR), 2, '0') || ': ' || CAST(l_partkey AS VARCHAR) || ' x ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS row_text
FROM (SELECT o_orderkey, l_partkey, l_quantity, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, CAST(l_quantity AS BIGINT)) AS INT) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey)""")
def repeat_rows(spark, sf_dir):
    """A model row for each item of an order: items are gathered per order, then exploded with their number."""
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("bigint").alias("q"))))
    by_order = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(items.alias("items"))
    rows = table(spark, sf_dir, "orders").join(by_order, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.posexplode("items").alias("i", "item"))
    n = F.col("i") + 1
    return rows.select("o_orderkey", n.alias("row_number"), F.concat(F.lpad(n.cast("string"), 2, "0"), F.lit(": "), F.col("item.l_partkey").cast("string"), F.lit(" x "), F.col("item.q").cast("string")).alias("row_text"))


# ---------------------------------------------------------------- rules

#: Answers: a number of the event, and for some a text that reads like false, an empty one, or none.
_SAID = "CASE event_id % 11 WHEN 2 THEN 'false' WHEN 3 THEN 'None' WHEN 4 THEN '' WHEN 5 THEN NULL ELSE json_extract_string(props, '$.k') END"
_OPS = "CASE event_id % 4 WHEN 0 THEN 'equals' WHEN 1 THEN 'not_equals' WHEN 2 THEN 'truthy' ELSE 'other' END"


@query(f"""WITH e AS (SELECT event_id, {_OPS} AS op, {_SAID} AS raw, lower(coalesce({_SAID}, 'none')) AS said, CAST(event_id % 7 AS VARCHAR) AS expected FROM events)
SELECT event_id, CASE op WHEN 'equals' THEN said = expected WHEN 'not_equals' THEN said <> expected WHEN 'truthy' THEN raw IS NOT NULL AND raw <> '' ELSE TRUE END AS visible FROM e""")
def condition_visibility(spark, sf_dir):
    k, m = F.col("event_id") % 4, F.col("event_id") % 11
    said = F.when(m == 2, "false").when(m == 3, "None").when(m == 4, "").when(m == 5, None).otherwise(F.get_json_object("props", "$.k"))
    op = F.when(k == 0, "equals").when(k == 1, "not_equals").when(k == 2, "truthy").otherwise("other")
    return table(spark, sf_dir, "events").select("event_id", rules.condition_matches(op, (F.col("event_id") % 7).cast("string"), said).alias("visible"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'integer' WHEN 1 THEN 'percentage' WHEN 2 THEN 'cep' ELSE 'text' END AS kind,
 CASE WHEN l_orderkey % 11 = 0 THEN '' WHEN l_linenumber % 4 = 0 THEN CAST(l_partkey AS VARCHAR) || CASE WHEN l_orderkey % 5 = 0 THEN 'x' ELSE '' END WHEN l_linenumber % 4 = 1 THEN CAST(l_orderkey % 120 AS VARCHAR) WHEN l_linenumber % 4 = 2 THEN CAST(l_orderkey * 997 AS VARCHAR) ELSE l_returnflag || l_linestatus END AS answer FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN answer = '' THEN 'required' WHEN kind = 'cep' AND length(answer) <> 8 THEN 'cep' WHEN kind = 'integer' AND NOT regexp_matches(answer, '^[+-]*[0-9]+$') THEN 'integer'
 WHEN kind = 'percentage' AND CAST(answer AS BIGINT) > 100 THEN 'range' WHEN kind = 'text' AND answer <> 'NO' AND NOT regexp_full_match(answer, '[AR]F') THEN 'pattern' WHEN kind = 'text' AND answer = 'NO' THEN 'pattern' ELSE 'ok' END AS problem FROM v""")
def validate_answers(spark, sf_dir):
    n, k = F.col("l_linenumber") % 4, F.col("l_orderkey")
    kind = F.when(n == 0, "integer").when(n == 1, "percentage").when(n == 2, "cep").otherwise("text")
    answer = (
        F.when(k % 11 == 0, "").when(n == 0, F.concat(F.col("l_partkey").cast("string"), F.when(k % 5 == 0, "x").otherwise(""))).when(n == 1, (k % 120).cast("string")).when(n == 2, (k * 997).cast("string")).otherwise(F.concat("l_returnflag", "l_linestatus"))
    )
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("kind"), answer.alias("answer"))
    broken = rules.validate(F.col("kind"), F.col("answer"), F.lit(True), kinds=("integer", "percentage", "cep"))
    shape = F.when((F.col("kind") == "text") & ~F.col("answer").rlike("^(?:[AR]F)$"), "pattern")
    return rows.select("l_orderkey", "l_linenumber", F.coalesce(broken, shape, F.lit("ok")).alias("problem"))


@query("SELECT o_custkey, o_orderpriority FROM orders GROUP BY ALL HAVING NOT bool_or(o_orderstatus = 'F')")
def choice_group_missing(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", (F.col("o_orderstatus") == "F").alias("checked"), F.lit(True).alias("required"))
    return rules.missing_choices(rows, "o_custkey", "o_orderpriority")


_FIELDS = "SELECT p_size AS template_id, p_partkey AS pos, CASE WHEN p_partkey % 13 = 0 THEN '' WHEN p_partkey % 17 = 0 THEN '9' || p_brand ELSE lower(replace(p_brand, '#', '_')) END AS id, CASE WHEN p_partkey % 19 = 0 THEN '' ELSE p_name END AS label, CASE WHEN p_partkey % 3 = 0 THEN 'dropdown' ELSE 'text' END AS type, string_split(p_type, ' ') AS options, CASE WHEN p_partkey % 7 = 0 THEN 'brand_99' WHEN p_partkey % 23 = 0 THEN '' END AS depends_on FROM part"
_ISSUES = f"""WITH f AS ({_FIELDS}), g AS (SELECT *, count(*) OVER (PARTITION BY template_id, id) AS same FROM f), i AS (
SELECT template_id, pos, id AS field_id, 'error' AS severity, 'field.id_missing' AS code FROM g WHERE id = ''
UNION ALL SELECT template_id, pos, id, 'error', 'field.id_invalid' FROM g WHERE id LIKE '9%'
UNION ALL SELECT template_id, pos, id, 'error', 'field.id_duplicate' FROM g WHERE id <> '' AND id NOT LIKE '9%' AND same > 1
UNION ALL SELECT template_id, pos, id, 'error', 'field.label_missing' FROM g WHERE label = ''
UNION ALL SELECT template_id, pos, id, 'error', 'dropdown.options_missing' FROM g WHERE type = 'dropdown' AND len(list_distinct(list_filter(options, lambda x: x <> ''))) < 2
UNION ALL SELECT template_id, pos, id, 'warning', 'dropdown.options_duplicate' FROM g WHERE type = 'dropdown' AND len(list_distinct(list_filter(options, lambda x: x <> ''))) < len(list_filter(options, lambda x: x <> ''))
UNION ALL SELECT template_id, pos, id, 'error', 'condition.field_unknown' FROM g WHERE depends_on <> '' AND NOT EXISTS (SELECT 1 FROM f WHERE f.template_id = g.template_id AND f.id = g.depends_on)
UNION ALL SELECT template_id, pos, id, 'error', 'condition.field_missing' FROM g WHERE depends_on = '')"""


def _fields(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.col("p_size").alias("template_id"), k.alias("pos"),
        F.when(k % 13 == 0, "").when(k % 17 == 0, F.concat(F.lit("9"), "p_brand")).otherwise(F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))).alias("id"),
        F.when(k % 19 == 0, "").otherwise(F.col("p_name")).alias("label"), F.when(k % 3 == 0, "dropdown").otherwise("text").alias("type"), F.split("p_type", " ").alias("options"),
        F.when(k % 7 == 0, "brand_99").when(k % 23 == 0, "").alias("depends_on"),
    )


@query(f"{_ISSUES} SELECT * FROM i")
def quality_issues(spark, sf_dir):
    return rules.quality_issues(_fields(spark, sf_dir))


@query(f"{_ISSUES} SELECT template_id, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings FROM i GROUP BY template_id")
def issue_counts(spark, sf_dir):
    return rules.issue_counts(rules.quality_issues(_fields(spark, sf_dir)))


@query("""WITH c AS (SELECT c_custkey AS id, c_mktsegment AS t FROM customer), s AS (SELECT o_custkey AS id, min(o_orderpriority) AS t FROM orders GROUP BY 1)
SELECT coalesce(c.id, s.id) AS id, CASE WHEN s.id IS NULL THEN 'missing' WHEN c.id IS NULL THEN 'unused' WHEN left(c.t, 1) <> left(s.t, 1) THEN 'type_mismatch' ELSE 'ok' END AS status FROM c FULL JOIN s ON c.id = s.id""")
def configured_vs_scanned(spark, sf_dir):
    configured = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.left("c_mktsegment", F.lit(1)).alias("type"))
    scanned = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.left(F.min("o_orderpriority"), F.lit(1)).alias("type"))
    return rules.configured_vs_scanned(configured, scanned, ["id"]).select("id", "status")


@query("SELECT n_nationkey, 'region_' || CAST(n_regionkey + n_nationkey % 2 * 4 AS VARCHAR) AS depends_on FROM nation WHERE n_regionkey + n_nationkey % 2 * 4 NOT IN (SELECT r_regionkey FROM region)")
def unknown_dependency(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_regionkey") + F.col("n_nationkey") % 2 * 4).alias("r"))
    known = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r"))
    return n.join(known, "r", "left_anti").select("n_nationkey", F.concat(F.lit("region_"), F.col("r").cast("string")).alias("depends_on"))


@query("""WITH RECURSIVE e AS (SELECT n_regionkey AS g, n_nationkey AS n, CAST((n_nationkey * 7 + 3) % 25 AS INT) AS t FROM nation), all_e AS (SELECT 0 AS g, n, t FROM e),
walk AS (SELECT g, n, t, 1 AS d FROM all_e UNION ALL SELECT w.g, w.n, x.t, d + 1 FROM walk w JOIN all_e x ON w.t = x.n WHERE d < 25)
SELECT DISTINCT g AS template_id, n AS node FROM walk WHERE n = t""")
def condition_cycles(spark, sf_dir):
    e = table(spark, sf_dir, "nation").select(F.lit(0).alias("template_id"), F.col("n_nationkey").alias("node"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("to"))
    return rules.cycles(e, "template_id", "node", "to")
