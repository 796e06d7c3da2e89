"""Queries on lone check boxes: every order is a document, its lines are rows of a marker cell and an option cell."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import markers
from .axes import _LINES, _clean, _has_fill, _space
from .forms import table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


_NONE = "0 AS named_boxes, 0 AS bare_boxes, 0 AS named_legacy, 0 AS bare_legacy, CAST(NULL AS STRING) AS glyph, FALSE AS has_field, FALSE AS has_object"
#: The paragraphs of a line, and of an order before its table, in the SQL that both engines read.
_PARTS = (
    (f"""l_orderkey AS doc, 1 AS block, i AS r, 0 AS s, 0 AS k, CASE l_quantity % 8 WHEN 0 THEN '☐' WHEN 1 THEN ' ✓ ' WHEN 2 THEN '☐ Total' WHEN 6 THEN '( )' ELSE '' END AS text, CAST(l_partkey % 4 * 600 AS INT) AS width, 1 AS runs, 0 AS bold_runs, FALSE AS is_numbered,
  CASE WHEN l_quantity % 8 = 3 AND l_suppkey % 2 = 0 THEN 1 ELSE 0 END AS named_boxes, CASE WHEN l_quantity % 8 = 3 AND l_suppkey % 2 = 1 THEN 1 ELSE 0 END AS bare_boxes, 0 AS named_legacy, CASE WHEN l_quantity % 8 = 6 AND l_suppkey % 5 = 0 THEN 1 ELSE 0 END AS bare_legacy,
  CASE WHEN l_quantity % 8 = 4 THEN 'drawing' END AS glyph, l_quantity % 8 = 3 AS has_field, l_quantity % 8 IN (3, 4) AS has_object""", ""),
    (f"""l_orderkey, 1, i, 1, 0, CASE WHEN l_returnflag = 'R' THEN CAST(l_linenumber AS STRING) || ') Item ' || l_linestatus WHEN l_returnflag = 'A' THEN 'Atraso  na entrega' ELSE '____' END, CAST(l_suppkey % 3 * 1500 + 1500 AS INT), 1, CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END, l_discount > 0.08, {_NONE}""", ""),
    (f"""l_orderkey, 1, i, 1, 1, CASE WHEN l_suppkey % 4 = 0 THEN 'Observação: nada' ELSE 'peça ' || CAST(l_partkey AS STRING) END, CAST(NULL AS INT), 1, 0, FALSE, {_NONE}""", ""),
    (f"""l_orderkey, 1, i, 1, 2, 'fim', CAST(NULL AS INT), 1, 0, FALSE, {_NONE}""", "l_suppkey % 4 < 2"),
)
_RECORDS = f"WITH l AS ({_LINES})\n" + "\nUNION ALL ".join(f"SELECT {x} FROM l{' WHERE ' + c if c else ''}" for x, c in _PARTS) + "\n"
#: The same paragraphs for Spark, which would number the lines anew for every part of a union.
_TYPE = "STRUCT<doc: BIGINT, block: INT, r: INT, s: INT, k: INT, text: STRING, width: INT, runs: INT, bold_runs: INT, is_numbered: BOOLEAN, named_boxes: INT, bare_boxes: INT, named_legacy: INT, bare_legacy: INT, glyph: STRING, has_field: BOOLEAN, has_object: BOOLEAN>"
_EACH = " ".join(f"WHEN {n} THEN CAST(struct({x}) AS {_TYPE})" for n, (x, _) in enumerate(_PARTS))
_THERE = " ".join(f"WHEN {n} THEN {c}" for n, (_, c) in enumerate(_PARTS) if c)
_ONCE = f"WITH l AS ({_LINES}) SELECT l_orderkey AS doc, c.* EXCEPT (doc) FROM (SELECT *, CASE part {_EACH} END AS c FROM l LATERAL VIEW explode(sequence(0, {len(_PARTS) - 1})) x AS part WHERE CASE part {_THERE} ELSE TRUE END)"
_BEFORE = f"""SELECT o_orderkey AS doc, -1 AS block, CASE WHEN o_custkey % 3 = 0 THEN '2. Entrega ' || o_orderpriority ELSE 'Nota.' END AS text, {_NONE} FROM orders
UNION ALL SELECT o_orderkey, 0, CASE o_orderstatus WHEN 'O' THEN 'Verificada a seguinte situação:' WHEN 'F' THEN repeat('prosa longa ', 12) ELSE 'ok' END, {_NONE} FROM orders"""


def _inputs(spark, sf_dir):
    for t in ("lineitem", "orders"):
        table(spark, sf_dir, t).createOrReplaceTempView(f"quill_{t}")
    inside = spark.sql(_ONCE.replace("FROM lineitem", "FROM quill_lineitem")).withColumn("table_index", F.lit(1))
    none = F.lit(None).cast("int")
    outside = spark.sql(_BEFORE.replace("FROM orders", "FROM quill_orders")).select("*", none.alias("r"), none.alias("s"), F.lit(0).alias("k"), none.alias("width"), F.lit(1).alias("runs"), F.lit(0).alias("bold_runs"), F.lit(False).alias("is_numbered"), none.alias("table_index"))
    return inside.unionByName(outside).withColumnRenamed("r", "row_index").withColumnRenamed("s", "start")


_DIGITS = r"regexp_matches({0}, '^\d')"
_ROWS = rf"""
p AS (SELECT *, {_space('text')} AS said FROM ({_RECORDS})),
m AS (
  SELECT doc, r, width, CASE WHEN named_boxes > 0 THEN NULL WHEN bare_boxes = 1 OR bare_legacy = 1 THEN 'paragraph' WHEN said IN ('☐', '✓', '( )') THEN 'text_span' WHEN said = '' AND glyph IS NOT NULL THEN 'paragraph' END AS mode, said = '' AND NOT has_object AS blank
  FROM p WHERE s = 0
),
o AS (
  SELECT doc, r, max(width) FILTER (WHERE k = 0) AS room, string_agg(said, ' — ' ORDER BY k) FILTER (WHERE NOT {_has_fill('said')} AND k < stop) AS option, bool_or(k = 0 AND (is_numbered OR bold_runs = runs OR regexp_matches(said, '^\d{{1,3}}[.)]\s*\S'))) AS looks
  FROM (SELECT *, coalesce(min(CASE WHEN starts_with(said, 'Observação') THEN k END) OVER (PARTITION BY doc, r), 9) AS stop FROM p WHERE s = 1) GROUP BY doc, r
),
marked AS (
  SELECT m.doc, m.r, option, CASE WHEN mode IS NOT NULL THEN mode WHEN blank AND looks AND width <= 1800 AND width * 3 <= room AND bool_or(mode IS NOT NULL) OVER (PARTITION BY m.doc) THEN 'inferred_blank' END AS mode
  FROM m JOIN o ON o.doc = m.doc AND o.r = m.r WHERE option IS NOT NULL AND option <> ''
)
"""


@query(f"WITH {_ROWS} SELECT doc, r AS row_index, mode, option FROM marked WHERE mode IS NOT NULL")
def marked_rows(spark, sf_dir):
    """Rows of the orders' tables with a lone check box, and what it is the box of."""
    return markers.marked_rows(_inputs(spark, sf_dir)).select("doc", "row_index", "mode", "option")


@query(rf"""WITH {_ROWS},
run AS (SELECT *, r - row_number() OVER (PARTITION BY doc ORDER BY r) AS island FROM marked WHERE mode IS NOT NULL),
top AS (SELECT *, row_number() OVER (PARTITION BY doc, island ORDER BY r) AS n FROM run),
g AS (SELECT doc, min(r) AS first_row, string_agg(option, '|' ORDER BY r) AS options, string_agg(mode, '|' ORDER BY r) AS modes, count(*) FILTER (WHERE mode = 'inferred_blank') AS inferred FROM top WHERE n <= 8 GROUP BY doc, island HAVING count(*) >= 2)
SELECT g.doc, first_row, CASE WHEN o_orderstatus = 'O' THEN 'Situação verificada' WHEN o_custkey % 3 = 0 THEN {_clean("'2. Entrega ' || o_orderpriority")} ELSE 'Ocorrência verificada' END AS label, options, modes,
  CAST(inferred AS BIGINT) AS inferred, CASE WHEN inferred > 0 THEN CAST(0.89 AS DOUBLE) ELSE CAST(0.93 AS DOUBLE) END AS confidence FROM g LEFT JOIN orders ON o_orderkey = g.doc""")
def marker_groups(spark, sf_dir):
    """Groups of options of the orders' tables, with their prompt."""
    g = markers.marker_groups(_inputs(spark, sf_dir))
    return g.select("doc", "first_row", "label", F.array_join("options", "|").alias("options"), F.array_join("modes", "|").alias("modes"), F.col("inferred").cast("long").alias("inferred"), "confidence")
