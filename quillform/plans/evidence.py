"""A query on metadata from evidence: the lines of an order are fields that lack some of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence
from .axes import _LINES
from .forms import table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


_FIELD = {
    "doc": "l_orderkey", "pos": "i", "field_id": "'f' || CAST(i AS STRING)", "label": "CASE l_suppkey % 4 WHEN 0 THEN 'Data ' || l_linestatus WHEN 1 THEN 'Valor' WHEN 2 THEN ' ' END", "label_source": "CAST(NULL AS STRING)", "section": "CASE WHEN l_tax > 0.04 THEN CAST(i AS STRING) || '. Parte ' || l_returnflag END",
    "type": "CASE l_partkey % 5 WHEN 0 THEN 'cpf' WHEN 1 THEN 'auto' END", "type_source": "CASE WHEN l_partkey % 7 = 1 THEN 'manual' END", "placeholder": "CASE l_quantity % 5 WHEN 0 THEN '_/_/____' WHEN 1 THEN '000.000.000-00' WHEN 2 THEN 'R$ 0,00' END", "default_value": "CASE WHEN l_quantity % 7 = 0 THEN 'a@b.c' END",
    "profile_identity": "CASE WHEN l_discount > 0.07 THEN 'p' END", "choice_group_label": "CASE WHEN l_partkey % 9 = 0 THEN 'Grupo:' END", "layout_group_label": "CASE WHEN l_partkey % 6 = 0 THEN 'Grade ' || l_returnflag END", "layout_row_label": "CASE WHEN l_partkey % 4 = 0 THEN 'Telefone' END",
    "layout_column": "CASE WHEN l_partkey % 3 = 0 THEN 'Custo' END", "profile_key": "CASE WHEN l_partkey % 2 = 0 THEN 'chave' END",
}
_SELECT = ", ".join(f"{v} AS {c}" for c, v in _FIELD.items())


@query(f"""WITH f AS (SELECT {_SELECT}, l_extendedprice > 50000 AS listed FROM ({_LINES})),
a AS (SELECT *, CASE WHEN trim(coalesce(label, '')) <> '' THEN NULL WHEN choice_group_label IS NOT NULL THEN ['Grupo', 'choice_group', '0.98'] WHEN layout_group_label IS NOT NULL THEN [layout_group_label, 'layout_group', '0.94'] WHEN layout_row_label IS NOT NULL THEN ['Telefone', 'row_label', '0.92'] WHEN layout_column IS NOT NULL THEN ['Custo', 'column_header', '0.82'] WHEN profile_key IS NOT NULL THEN ['chave', 'profile_key', '0.72'] END AS el FROM f),
b AS (SELECT *, coalesce(el[1], trim(label), '') AS said FROM a),
c AS (
  SELECT *, CASE WHEN coalesce(type, 'auto') <> 'auto' OR type_source = 'manual' THEN NULL WHEN listed THEN ['dropdown', 'options', '1.0'] WHEN placeholder LIKE '\\_%' ESCAPE '\\' THEN ['date', 'mask', '0.98'] WHEN placeholder LIKE '000%' THEN ['cpf', 'mask', '0.99'] WHEN placeholder LIKE 'R$%' THEN ['currency', 'mask', '0.98']
    WHEN default_value IS NOT NULL THEN ['email', 'example_value', '0.98'] WHEN said = 'Telefone' THEN ['phone', 'semantic_label', '0.97'] WHEN said LIKE 'Data%' THEN ['date', 'semantic_label', '0.90'] WHEN said IN ('Valor', 'Custo') THEN ['currency', 'semantic_label', '0.92'] END AS et FROM b
),
d AS (SELECT *, coalesce(et[1], type) AS kind, CASE WHEN said <> '' AND profile_identity IS NULL THEN 0.90 END AS ei FROM c)
SELECT doc, pos, CASE WHEN el IS NOT NULL THEN said ELSE label END AS label, el[2] AS label_from, kind AS type, et[2] AS type_from,
  CASE WHEN ei IS NOT NULL THEN CASE WHEN section IS NULL THEN '' ELSE 'parte_' || lower(right(section, 1)) || '.' END || replace(lower(said), ' ', '_') || ':' || coalesce(kind, 'text') ELSE profile_identity END AS profile_identity,
  round((coalesce(CAST(el[3] AS DOUBLE), 0) + coalesce(CAST(et[3] AS DOUBLE), 0) + CAST(coalesce(ei, 0) AS DOUBLE)) / nullif(CAST(el IS NOT NULL AS INT) + CAST(et IS NOT NULL AS INT) + CAST(ei IS NOT NULL AS INT), 0), 3) AS context_confidence
FROM d""")
def resolved_metadata(spark, sf_dir):
    """Labels, types and identities of the fields of all orders, with what they come from and how sure they are together."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("quill_lineitem")
    lines = _LINES.replace("FROM lineitem", "FROM quill_lineitem")
    f = spark.sql(f"SELECT {_SELECT}, CASE WHEN l_extendedprice > 50000 THEN array('A', 'B') END AS options FROM ({lines})")
    r = evidence.resolve(f)
    told = lambda a: F.col("evidence")[a]["source"]
    return r.select("doc", "pos", "label", told("label").alias("label_from"), "type", told("type").alias("type_from"), "profile_identity", "context_confidence")
