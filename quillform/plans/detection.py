"""Queries on detection and layout, each with DuckDB SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect, layout, matching
from .forms import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


#: Texts with masks, and their kinds, places and confidences.
_MASKED = (
    ("CPF: 000.000.000-00 fim", "cpf@5-19@0.91"),
    ("Banco: ____ ou: R$ XX,XXX", "underscores@7-11@0.91,currency@16-25@0.91"),
    ("XXXX sem rotulo", "letters@0-4@0.74"),
    ("nada aqui", ""),
    ("Fone： (83) XXXX-XXXX e (00) 00000-0000", "letters@6-20@0.91,phone@23-38@0.74"),
    ("E-mail: teste@domínio.com.br, {unidade.órgão}", "email@8-28@0.91,braces@30-45@0.82"),
    ("Valor: R$ 000 . 000,00 em __/__/____", "currency@7-22@0.91,underscores@26-36@0.74"),
    ("Nome: {nome} {{tag}} e-mail@empresa.com", "braces@6-12@0.98,email@21-39@0.74"),
)


@query("SELECT c_custkey, CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN '{w}'" for i, (_, w) in enumerate(_MASKED)) + " END AS masks FROM customer")
def inline_masks(spark, sf_dir):
    """Masks in texts that are built from customers: kind, begin, end, confidence."""
    texts = F.array(*[F.lit(t) for t, _ in _MASKED])
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.get(texts, (F.col("c_custkey") % 8).cast("int")).alias("text")).select("c_custkey", detect.masks(F.col("text")).alias("m"))
    said = F.transform("m", lambda x: F.concat(x["kind"], F.lit("@"), x["start"].cast("string"), F.lit("-"), x["end"].cast("string"), F.lit("@"), x["confidence"].cast("string")))
    return rows.select("c_custkey", F.array_join(said, ",").alias("masks"))


@query("""SELECT p_partkey, CASE WHEN len(o) BETWEEN 2 AND 8 THEN array_to_string(o, ';') ELSE 'none' END AS options FROM (SELECT p_partkey, string_split(p_name || CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_type ELSE '' END, ' ')[1:CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 9 END] AS o FROM part)""")
def inline_checkboxes(spark, sf_dir):
    names = F.split(F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), "p_type")).otherwise("")), " ")
    few = F.slice(names, F.lit(1), F.when(F.col("p_partkey") % 5 == 0, 1).otherwise(9))
    text = F.concat(F.lit("Tipo: "), F.array_join(F.transform(few, lambda x: F.concat(F.lit("☐ "), x)), " "))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("t")).select("p_partkey", F.coalesce(F.array_join(detect.inline_options(F.col("t")), ";"), F.lit("none")).alias("options"))


_CELLS = """WITH o AS (SELECT l_suppkey AS doc, l_orderkey % 50 AS row_index, l_linenumber % 5 AS cell_index, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
c AS (SELECT doc, row_index, cell_index, CASE WHEN p % 3 = 0 THEN '' WHEN p % 3 = 1 THEN 'Rotulo ' || CAST(p AS VARCHAR) ELSE '____' END AS text FROM o)"""


def _cells(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("doc"), (F.col("l_orderkey") % 50).alias("row_index"), (F.col("l_linenumber") % 5).alias("cell_index")).agg(F.min("l_partkey").alias("p"))
    k = F.col("p") % 3
    return o.select("doc", F.lit(0).alias("table_index"), "row_index", "cell_index", F.when(k == 0, "").when(k == 1, F.concat(F.lit("Rotulo "), F.col("p").cast("string"))).otherwise("____").alias("text"))


@query(f"""{_CELLS}, w AS (SELECT *, last_value(CASE WHEN text LIKE 'Rotulo%' THEN text END IGNORE NULLS) OVER q AS label, last_value(CASE WHEN text LIKE 'Rotulo%' THEN cell_index END IGNORE NULLS) OVER q AS near FROM c WINDOW q AS (PARTITION BY doc, row_index ORDER BY cell_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc, row_index, cell_index, label, CASE WHEN cell_index - near = 1 THEN 0.84 ELSE 0.68 END AS confidence FROM w WHERE text = '' AND label IS NOT NULL""")
def empty_cells(spark, sf_dir):
    return detect.empty_cells(_cells(spark, sf_dir)).drop("table_index")


@query(f"""{_CELLS}, oo AS (SELECT *, row_index * 5 + cell_index AS ordinal FROM c), w AS (SELECT *,
 last_value(CASE WHEN text LIKE 'Rotulo%' THEN text END IGNORE NULLS) OVER (PARTITION BY doc, row_index ORDER BY cell_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
 last_value(CASE WHEN text LIKE 'Rotulo%' THEN text END IGNORE NULLS) OVER (PARTITION BY doc, cell_index ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u,
 last_value(CASE WHEN text LIKE 'Rotulo%' THEN text END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM oo)
SELECT doc, ordinal, CASE WHEN text = '' THEN 'blank' WHEN text = '____' THEN 'fill_area' ELSE 'content' END AS role, coalesce(l, u, b) AS label, CASE WHEN l IS NOT NULL THEN 'left' WHEN u IS NOT NULL THEN 'column' WHEN b IS NOT NULL THEN 'nearby' END AS label_source,
 CASE WHEN l IS NOT NULL THEN 0.97 WHEN u IS NOT NULL THEN 0.8 WHEN b IS NOT NULL THEN 0.58 END AS label_confidence FROM w""")
def label_candidates(spark, sf_dir):
    cells = _cells(spark, sf_dir).withColumn("ordinal", F.col("row_index") * 5 + F.col("cell_index"))
    return detect.annotate(cells).select("doc", "ordinal", "role", "label", "label_source", "label_confidence")


@query("""WITH r AS (SELECT o_custkey AS doc, o_orderkey AS row_index, o_orderpriority AS p FROM orders WHERE o_orderpriority < '4'), i AS (SELECT *, row_index - row_number() OVER (PARTITION BY doc ORDER BY row_index) AS g FROM r)
SELECT doc, min(row_index) AS first_row, count(*) AS n, string_agg(p, ';' ORDER BY row_index) AS options FROM i GROUP BY doc, g HAVING count(*) >= 1""")
def checkbox_groups(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderpriority") < "4", F.concat(F.lit("( ) "), "o_orderpriority")).otherwise(F.concat("o_orderpriority", F.lit(" ☐")))
    rows = o.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("row_index"), text.alias("text"))
    return detect.checkbox_groups(rows, least=1).select("doc", "first_row", "n", F.array_join("options", ";").alias("options"))


@query("""WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN 'OU' ELSE role END AS text FROM conversations), p AS (SELECT conv_id, turn, text, sum(CASE WHEN text = 'OU' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM r),
g AS (SELECT conv_id, part, string_agg(text, chr(10) ORDER BY turn) AS t FROM p WHERE text <> 'OU' GROUP BY ALL)
SELECT conv_id, count(*) AS n, string_agg(t, '|' ORDER BY part) AS options FROM g GROUP BY conv_id HAVING max(part) >= 2 AND count(*) BETWEEN 3 AND 10""")
def long_choices(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 1, " ou ").otherwise(F.col("role")).alias("text"))
    return detect.long_choices(rows, "conv_id", "turn").select("conv_id", "n", F.array_join("options", "|").alias("options"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 0.6 + (l_linenumber % 4) * 0.1 AS base, l_returnflag = 'A' AS agree, l_linestatus = 'O' AS sect, l_partkey % 10 = 0 AS poor FROM lineitem),
c AS (SELECT *, round(greatest(0, least(1, base + CASE WHEN agree THEN 0.1 ELSE 0 END + CASE WHEN sect THEN -0.18 ELSE 0 END + CASE WHEN poor THEN -0.3 ELSE 0 END)), 4) AS t FROM b), d AS (SELECT *, CAST(CASE WHEN poor THEN least(t, 0.54) ELSE t END AS DOUBLE) AS confidence FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, confidence, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.65 THEN 'medium' ELSE 'low' END AS band,
 CASE WHEN confidence < 0.65 THEN 'required' WHEN confidence < 0.85 OR sect OR poor THEN 'recommended' ELSE 'ready' END AS priority, confidence >= 0.8 AS selected FROM d""")
def candidate_scoring(spark, sf_dir):
    given = F.array(F.when(F.col("l_returnflag") == "A", "label_agreement"), F.when(F.col("l_linestatus") == "O", "section_only"), F.when(F.col("l_partkey") % 10 == 0, "poor_label"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", detect.rescore(0.6 + (F.col("l_linenumber") % 4) * 0.1, F.filter(given, lambda x: x.isNotNull())).alias("s"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "s.*")


_FIELDS = "SELECT p_size AS template_id, p_partkey AS pos, p_brand AS section FROM part"


@query(f"""WITH f AS ({_FIELDS}), m AS (SELECT *, min(pos) OVER (PARTITION BY template_id, section) AS first FROM f), r AS (SELECT *, dense_rank() OVER (PARTITION BY template_id ORDER BY first) AS rk FROM m)
SELECT template_id, pos, section, row_number() OVER (PARTITION BY template_id ORDER BY CASE rk WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE rk END, pos) - 1 AS new_pos FROM r""")
def section_reorder(spark, sf_dir):
    f = table(spark, sf_dir, "part").select(F.col("p_size").alias("template_id"), F.col("p_partkey").alias("pos"), F.col("p_brand").alias("section"))
    return layout.swap_sections(f, 1, 2)


@query("""WITH f AS (SELECT l_orderkey AS doc, l_linenumber // 3 AS row, l_partkey AS k, l_suppkey AS s, CAST(l_partkey % 16 AS INT) AS start, CAST(1 + l_suppkey % 4 AS INT) AS span FROM lineitem),
g AS (SELECT *, least(12, greatest(1, max(greatest(2, start + span)) OVER (PARTITION BY doc))) AS grid, count(*) OVER (PARTITION BY doc, row) = 1 AS alone FROM f), h AS (SELECT *, CASE WHEN alone THEN 0 ELSE greatest(0, least(start, grid - 1)) END AS new_start FROM g)
SELECT doc, row, k, s, start, span, CAST(grid AS INT) AS grid, CAST(new_start AS INT) AS new_start, CAST(CASE WHEN alone THEN grid ELSE greatest(1, least(span, grid - new_start)) END AS INT) AS new_span FROM h""")
def grid_normalize(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.floor(F.col("l_linenumber") / 3).cast("int").alias("row"), F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s"), (F.col("l_partkey") % 16).cast("int").alias("start"), (1 + F.col("l_suppkey") % 4).cast("int").alias("span"), F.lit(2).alias("columns"))
    return layout.normalize_grid(f, "doc").drop("columns")


@query("""WITH c AS (SELECT p_size AS t, p_partkey AS id, p_brand AS label, CASE WHEN p_size % 2 = 0 THEN p_brand || ' ' || CAST(p_partkey AS VARCHAR) ELSE p_brand END AS id_label FROM part), r AS (SELECT *, count(*) OVER (PARTITION BY t, label) > 1 AS rep FROM c),
w AS (SELECT *, CASE WHEN rep THEN id_label ELSE label END AS wanted FROM r), d AS (SELECT t, count(DISTINCT wanted) = count(*) AS fits FROM w GROUP BY t)
SELECT t, id, CASE WHEN fits THEN wanted ELSE label END AS shown FROM w JOIN d USING (t)""")
def column_labels(spark, sf_dir):
    b = F.col("p_brand")
    c = table(spark, sf_dir, "part").select(F.col("p_size").alias("t"), F.col("p_partkey").alias("id"), b.alias("label"), F.when(F.col("p_size") % 2 == 0, F.concat(b, F.lit(" "), F.col("p_partkey").cast("string"))).otherwise(b).alias("id_label"))
    return layout.distinct_labels(c, "t").select("t", "id", "shown")


@query("""WITH g AS (SELECT p_brand, p_size, list(DISTINCT p_name) AS n FROM part GROUP BY ALL), w AS (SELECT *, list_transform(n, lambda x: string_split(x, ' ')) AS ws FROM g)
SELECT p_brand, p_size, CASE WHEN len(list_distinct(list_transform(ws, lambda x: x[1]))) > 1 THEN '' WHEN len(list_distinct(list_transform(ws, lambda x: x[2]))) > 1 THEN ws[1][1] ELSE ws[1][1] || ' ' || ws[1][2] END AS prefix FROM w""")
def group_titles(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.collect_set("p_name").alias("n"))
    return g.select("p_brand", "p_size", layout.common_prefix(F.col("n")).alias("prefix"))


@query("""WITH a AS (SELECT c_nationkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'cliente.nome completo ' ELSE 'auto.conta ' END || CAST(c_custkey AS VARCHAR) AS answer_key FROM customer),
f AS (SELECT c_nationkey AS k, c_custkey AS field_id, 'Nome Completo ' || CAST(c_custkey AS VARCHAR) AS label FROM customer WHERE c_custkey % 3 = 0)
SELECT f.k, CAST(field_id AS BIGINT) AS field_id, answer_key FROM f JOIN a ON f.k = a.k AND suffix(a.answer_key, lower(f.label)) AND a.answer_key = 'cliente.' || lower(f.label)""")
def suffix_matches(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    a = c.select(F.col("c_nationkey").alias("k"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "cliente.nome completo ").otherwise("auto.conta "), F.col("c_custkey").cast("string")).alias("answer_key"))
    f = c.filter("c_custkey % 3 = 0").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("field_id"), F.col("c_custkey").alias("pos"), F.concat(F.lit("Nome Completo "), F.col("c_custkey").cast("string")).alias("label"))
    return matching.suffix_matches(a, f, "k")


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS k FROM part")
def template_keys(spark, sf_dir):
    """Names with stop words and version marks added, which the key drops again."""
    made = F.concat(F.lit("Modelo de "), "p_name", F.lit(" (Cópia) versão "), F.col("p_partkey").cast("string"), F.lit(" v2"))
    return table(spark, sf_dir, "part").select("p_partkey", matching.template_key(made).alias("k"))


@query("""SELECT p_size AS t, p_partkey AS pos, CASE WHEN p_partkey % 2 = 0 THEN CAST(row_number() OVER (PARTITION BY p_size, p_partkey % 2 = 0, p_brand ORDER BY p_partkey) = 1 AS VARCHAR) ELSE 'Texto de exemplo' END AS sample FROM part""")
def sample_values(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("t"), F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("group"))
    return layout.sample_rows(p, "t", F.lit("Texto de exemplo")).select("t", "pos", "sample")
