"""Queries on whole documents: packages that are made, filled, read back and scanned."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scan
from ..sources import generate, ooxml
from .forms import table
from .labels import _sql

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


#: (table, row, cell, start, span, v_merge, text): tables with headers, titles and repeated rows, good and bad.
CELLS = [
    (0, 0, 0, 0, 4, None, "Relação de itens"), (0, 1, 0, 0, 2, None, "Bem"), (0, 1, 1, 2, 2, None, "Entrega"), (0, 2, 0, 0, 1, None, "Nº"), (0, 2, 1, 1, 1, None, "Descrição"), (0, 2, 2, 2, 1, None, "Prazo"), (0, 2, 3, 3, 1, None, "Valor: "),
    (0, 3, 0, 0, 1, None, "{{row.number}}"), (0, 3, 1, 1, 1, None, "{{repeat:itens}}{{itens.descricao}}"), (0, 3, 2, 2, 1, None, "{{date:itens.prazo}}"), (0, 3, 3, 3, 1, None, "Preço: {{itens.valor}}"),
    (1, 0, 0, 0, 1, None, "{{repeat:a}}{{b.x}}"), (2, 0, 0, 0, 1, None, "{{repeat:a}}{{a.x.y}}"), (3, 0, 0, 0, 1, None, "{{repeat:a}}{{a.x}}"), (3, 0, 1, 1, 1, None, "{{a.x}}"), (4, 0, 0, 0, 1, "restart", "{{repeat:a}}{{a.x}}"),
    (5, 0, 0, 0, 1, None, "{{repeat:a}}"), (6, 0, 0, 0, 1, None, "{{repeat:a}}{{repeat:b}}{{a.x}}"), (7, 0, 0, 0, 1, None, "{{a.x}}"), (8, 0, 0, 0, 1, None, "{{repeat:t}}{{checkbox:t.ok}} {{dropdown:t.uf|PB|PE}} {{linha.numero}} {{row.index}}"),
]
_SCHEMA = "array<struct<table_index:int,row_index:int,cell_index:int,start:int,span:int,v_merge:string,text:string>>"


def _cells(spark, sf_dir):
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else _sql(v)
    made = F.expr("cast(array(" + ", ".join("struct(" + ", ".join(lit(v) for v in r) + ")" for r in CELLS) + f") as {_SCHEMA})")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc"), F.explode(made).alias("c")).select("doc", "c.*")


#: What the rows with a repeat tag are: table, problem, columns as id:label:type:required:options.
REPEATS = [
    ("itens", None, "item:Bem — Nº:auto_number:false:;descricao:Bem — Descrição:multiline:true:;prazo:Entrega — Prazo:date:true:;valor:Preço:currency:true:"), ("a", "outside the table", None), ("a", "not a plain column", None), ("a", "repeated column", None), ("a", "merged cell", None), ("a", "no columns", None), ("a", "several tables", None),
    ("t", None, "ok:Ok:checkbox:false:;uf:Uf:dropdown:true:PB,PE;item:Item:auto_number:false:"),
]


@query("SELECT s_suppkey AS doc, table_id, problem, columns FROM supplier, (VALUES " + ", ".join(f"({_sql(a)}, {_sql(b)}, {_sql(c)})" for a, b, c in REPEATS) + ") AS v(table_id, problem, columns)")
def repeat_row_scan(spark, sf_dir):
    said = F.transform("columns", lambda c: F.concat_ws(":", c["id"], c["label"], c["type"], c["required"].cast("string"), F.array_join(c["options"], ",")))
    return scan.repeat_rows(_cells(spark, sf_dir)).select("doc", "table_id", "problem", F.array_join(said, ";").alias("columns"))


_ITEMS = "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, l_partkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 10 = 1"


@query(f"""WITH i AS ({_ITEMS}), d AS (SELECT DISTINCT o_orderkey FROM i), c AS (SELECT o_orderkey, max(n) AS m FROM i GROUP BY 1), o AS (SELECT orders.*, m FROM orders JOIN c USING (o_orderkey) WHERE o_orderkey % 10 = 1)
SELECT o_orderkey AS doc, 0 AS ordinal, 'Pedido ' || CAST(o_orderkey AS VARCHAR) || ': ' || o_orderpriority || ' ' || CASE WHEN o_orderstatus = 'F' THEN '☑' ELSE '☐' END || ' sem obs' AS text FROM o
UNION ALL SELECT o_orderkey, 1, 'Nº' FROM o UNION ALL SELECT o_orderkey, 2, 'Peça' FROM o UNION ALL SELECT o_orderkey, CAST(1 + 2 * n AS INT), lpad(CAST(n AS VARCHAR), 2, '0') FROM i UNION ALL SELECT o_orderkey, CAST(2 + 2 * n AS INT), 'P' || CAST(l_partkey AS VARCHAR) FROM i
UNION ALL SELECT o_orderkey, CAST(3 + 2 * m AS INT), 'fim' FROM o""")
def generated_documents(spark, sf_dir):
    """A document for every tenth order (its table is made of the order's lines), filled and read back."""
    template = ooxml.build_docx(["Pedido {{id}}: {{prioridade}} {{checkbox:ok}} {{default_or_text:obs|sem obs}}", [["Nº", "Peça"], ["{{repeat:itens}}{{row.number}}", "P{{itens.peca}}"]], "fim"])
    lines = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: F.struct(x["l_partkey"].cast("string").alias("peca")))
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(lines.alias("itens"))
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 10 = 1").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    answers = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("prioridade"), (F.col("o_orderstatus") == "F").alias("ok"), "itens"))
    made = generate.documents(o.select(F.col("o_orderkey").cast("string").alias("path"), F.lit(template).alias("template"), answers.alias("answers")), "path", "template", "answers")
    return ooxml.parse_docx(made.filter("problem IS NULL")).select(F.col("path").cast("long").alias("doc"), "ordinal", "text")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Unfilled: left: b' WHEN 1 THEN 'Unfilled: uf: XX is not an option' WHEN 2 THEN 'Unfilled: t: no rows' END AS problem FROM customer")
def generation_problems(spark, sf_dir):
    """Documents that can't be completed: a tag without an answer, an answer that is no option, a table without rows."""
    k = F.col("c_custkey") % 4
    made = [ooxml.build_docx(x) for x in (["{{a}} {{b}}"], ["{{dropdown:uf|PB|PE}}"], [[["{{repeat:t}}{{t.x}}"]]], ["{{a}} {{dropdown:uf|Sim => XX|PE}}"])]
    template = F.when(k == 0, F.lit(made[0])).when(k == 1, F.lit(made[1])).when(k == 2, F.lit(made[2])).otherwise(F.lit(made[3]))
    rows = table(spark, sf_dir, "customer").select("c_custkey", template.alias("t"), F.lit('{"a": "x", "uf": "XX"}').alias("v"))
    return generate.documents(rows, "c_custkey", "t", "v").select("c_custkey", "problem")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 1 THEN 'no package' WHEN 2 THEN 'missing [Content_Types].xml' END AS problem FROM customer")
def output_checks(spark, sf_dir):
    k = F.col("c_custkey") % 3
    content = F.when(k == 0, F.lit(ooxml.build_docx(["x"]))).when(k == 1, F.lit(b"PK\3\4 no")).otherwise(F.lit(ooxml.packed([("word/document.xml", b"<x/>")])))
    return ooxml.check_docx(table(spark, sf_dir, "customer").select("c_custkey", content.alias("content"))).select("c_custkey", "problem")


_CONTROLS = [("a", "checkbox", None, None, "a", "checkbox", "", False), ("dropdown:b|x|y", "dropdown", "PB;Selecione um item;PE", None, "b", "dropdown", "PB;PE", False), ("c", "dropdown", "Escolher um item.", None, "c", "dropdown", "", True), (None, "date", None, None, "", "date", "", True), (None, None, None, "caixa", "caixa", "checkbox", "", False), ("a", "date", None, None, None, None, None, None), ("d", None, None, None, None, None, None, None)]


@query("SELECT n_nationkey AS doc, field_id, type, options, needs_review FROM nation, (VALUES " + ", ".join(f"({_sql(r[4])}, {_sql(r[5])}, {_sql(r[6])}, {str(r[7]).upper()})" for r in _CONTROLS if r[5]) + ") AS v(field_id, type, options, needs_review)")
def control_fields(spark, sf_dir):
    lit = lambda v: "NULL" if v is None else _sql(v)
    made = F.expr("cast(array(" + ", ".join("struct(" + ", ".join(lit(v) for v in r[:4]) + ")" for r in _CONTROLS) + ") as array<struct<control_id:string,control_kind:string,o:string,legacy_box:string>>)")
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc"), F.posexplode(made).alias("ordinal", "c")).select("doc", "ordinal", "c.control_id", "c.control_kind", F.split("c.o", ";").alias("control_options"), "c.legacy_box")
    return scan.control_fields(rows).select("doc", "field_id", "type", F.array_join("options", ";").alias("options"), "needs_review")


@query("SELECT r_regionkey AS doc, field_id, parts FROM region, (VALUES ('a', 'Cabeçalho,Corpo / tabelas / caixas de texto'), ('b', 'Corpo / tabelas / caixas de texto'), ('c', 'Rodapé')) AS v(field_id, parts)")
def tag_places(spark, sf_dir):
    rows = [("document", "{{a}} e {{date:b}}", None), ("header1", "{{a}}", None), ("footer2", "x", "c"), ("document", "{{a}}", None)]
    made = F.array(*[F.struct(F.lit(s).alias("story"), F.lit(t).alias("text"), F.lit(c).cast("string").alias("control_id")) for s, t, c in rows])
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("doc"), F.explode(made).alias("r")).select("doc", "r.*")
    return scan.tag_places(r).select("doc", "field_id", F.array_join("parts", ",").alias("parts"))
