"""Queries on merged layouts: the lines of an order are the fields of a template."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merging
from .axes import _LINES, _space
from .forms import table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


#: Attributes of a line's field and of what its document says, in the SQL that both engines read.
_FIELD = {
    "doc": "l_orderkey", "pos": "i", "field_id": "'f' || CAST(i AS STRING)", "type": "CASE WHEN l_returnflag = 'A' THEN 'checkbox' ELSE 'text' END", "label": "CASE WHEN l_tax < 0.02 THEN ' ' ELSE 'L' || CAST(l_suppkey AS STRING) END",
    "label_source": "CASE l_linenumber % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'identifier' END", "section": "CASE l_returnflag WHEN 'R' THEN 'Dados do documento' WHEN 'N' THEN '' ELSE 'Minha' END", "section_source": "CAST(NULL AS STRING)",
    "detection_source": "CASE WHEN l_discount < 0.06 THEN 'automatic' END", "layout": "CASE l_quantity % 4 WHEN 0 THEN 'choice' WHEN 1 THEN 'table' WHEN 2 THEN 'auto' ELSE 'form_grid' END",
    "layout_group": "CASE WHEN l_partkey % 3 = 0 THEN 'meu' ELSE 'doc_table_' || CAST(l_linenumber AS STRING) END", "layout_group_label": "CASE WHEN l_partkey % 2 = 0 THEN 'Grupo ' || l_linestatus END", "layout_row": "'row_' || CAST(l_linenumber AS STRING)",
    "layout_row_label": "CASE WHEN l_suppkey % 2 = 0 THEN 'Linha' END", "layout_column": "CASE WHEN l_suppkey % 3 = 0 THEN 'Coluna' END", "layout_column_index": "CASE WHEN l_suppkey % 4 > 0 THEN l_linenumber END", "layout_column_span": "CAST(NULL AS INT)", "layout_grid_columns": "4",
    "layout_order": "CAST(NULL AS INT)", "layout_row_header_label": "CASE WHEN l_suppkey % 5 = 0 THEN 'Função' END", "layout_presentation": "CAST(NULL AS STRING)", "choice_group": "CASE WHEN l_suppkey % 7 = 0 THEN 'c' || CAST(l_suppkey AS STRING) END", "choice_required": "CASE WHEN l_suppkey % 3 = 1 THEN FALSE END",
}
_SAID = {
    "doc": "l_orderkey", "field_id": "'f' || CAST(i AS STRING)", "section": "CASE WHEN l_partkey % 5 > 0 THEN CAST(l_linenumber AS STRING) || '. Seção' ELSE '' END", "detected_label": "CASE WHEN l_partkey % 4 > 0 THEN 'Doc ' || CAST(l_partkey AS STRING) END",
    "layout": "CASE l_partkey % 3 WHEN 0 THEN 'form_grid' WHEN 1 THEN 'table' END", "layout_group": "CASE WHEN l_partkey % 6 < 5 THEN 'doc_table_1_segment_' || CAST(l_linenumber AS STRING) END", "layout_group_label": "'Doc'", "layout_row": "CASE WHEN l_partkey % 7 > 0 THEN 'row_' || CAST(i AS STRING) END",
    "layout_row_label": "'Rótulo'", "layout_column": "CASE WHEN l_partkey % 2 = 0 THEN '' ELSE 'Título' END", "layout_column_index": "0", "layout_column_span": "2", "layout_grid_columns": "5", "layout_order": "i", "layout_row_header_label": "'Item'",
    "layout_presentation": "CASE WHEN l_partkey % 9 = 0 THEN 'sheet' END", "choice_group": "CASE WHEN l_partkey % 2 = 0 THEN 'dg' END", "choice_required": "TRUE",
}
_SEEN = "l_extendedprice > 2000"


def _select(what: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {c}" for c, v in what.items())


def _frames(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("quill_lineitem")
    lines = _LINES.replace("FROM lineitem", "FROM quill_lineitem")
    return spark.sql(f"SELECT {_select(_FIELD)} FROM ({lines})"), spark.sql(f"SELECT {_select(_SAID)} FROM ({lines}) WHERE {_SEEN}")


_GRIDS = "('table', 'form_grid')"


def _merged(c: str) -> str:
    old = f"f.{c}"
    if c in merging.STALE:
        old = f"CASE WHEN rehomed OR moved THEN NULL ELSE f.{c} END"
    elif c == merging.HEADER:
        old = f"CASE WHEN rehomed THEN NULL ELSE f.{c} END"
    elif c == "choice_group":
        old = "CASE WHEN rehomed THEN coalesce(nullif(f.choice_group, ''), nullif(f.layout_group, ''), f.choice_group) ELSE f.choice_group END"
    elif c == "choice_required":
        old = "CASE WHEN rehomed THEN coalesce(f.choice_required, TRUE) ELSE f.choice_required END"
    if _FIELD[c].startswith(("CAST(NULL AS INT", "4", "CASE WHEN l_suppkey % 4")) or c == "choice_required":
        return f"coalesce({old}, d.{c}) AS {c}"
    return f"coalesce(nullif(nullif({old}, ''), 'auto'), nullif(nullif(d.{c}, ''), 'auto'), {old}) AS {c}"


@query(f"""WITH l AS ({_LINES}), f AS (SELECT {_select(_FIELD)} FROM l), d AS (SELECT {_select(_SAID)} FROM l WHERE {_SEEN}),
j AS (
  SELECT f.doc, f.pos, coalesce(f.detection_source = 'automatic' AND f.type = 'checkbox' AND f.layout = 'choice' AND d.layout IN {_GRIDS} AND d.layout_group <> '' AND d.layout_row <> '', FALSE) AS rehomed,
    coalesce(f.layout IN {_GRIDS} AND d.layout IN {_GRIDS} AND f.layout <> d.layout AND starts_with(f.layout_group, 'doc_table_'), FALSE) AS moved
  FROM f LEFT JOIN d ON f.doc = d.doc AND f.field_id = d.field_id
)
SELECT f.doc, f.pos, CASE WHEN d.detected_label <> '' AND (trim(f.label) = '' OR coalesce(f.label_source, '') IN ('', 'identifier')) THEN d.detected_label ELSE f.label END AS label,
  CASE WHEN d.section <> '' AND f.section IN ('', 'Dados do documento') THEN d.section ELSE f.section END AS section, rehomed AS compact_choice, {", ".join(_merged(c) for c in merging.LAYOUT)}
FROM f JOIN j ON j.doc = f.doc AND j.pos = f.pos LEFT JOIN d ON f.doc = d.doc AND f.field_id = d.field_id""")
def layout_merge(spark, sf_dir):
    """The fields of all orders with what their documents say about layout."""
    f, d = _frames(spark, sf_dir)
    return merging.apply_layout(f, d).select("doc", "pos", "label", "section", "compact_choice", *merging.LAYOUT)


_USER = "SELECT doc, field_id, CASE WHEN pos % 3 = 0 THEN 'meu ' || CAST(pos AS STRING) ELSE label END AS label, type FROM ({0}) x WHERE pos % 5 < 4 UNION ALL SELECT doc, 'novo', 'Novo', CAST(NULL AS STRING) FROM ({0}) y WHERE pos = 0"


@query(f"""WITH l AS ({_LINES}), b AS (SELECT doc, field_id, pos, label, type FROM (SELECT {_select(_FIELD)} FROM l)), u AS ({_USER.format('SELECT * FROM b')}), s AS (SELECT doc, field_id, detected_label AS label, CASE WHEN layout = 'table' THEN 'date' ELSE 'text' END AS type FROM (SELECT {_select(_SAID)} FROM l WHERE {_SEEN})),
k AS (SELECT doc, field_id FROM b UNION SELECT doc, field_id FROM u UNION SELECT doc, field_id FROM s),
j AS (
  SELECT k.doc, k.field_id, b.doc IS NOT NULL AS inb, u.doc IS NOT NULL AS inu, s.doc IS NOT NULL AS ins, b.label AS bl, u.label AS ul, s.label AS sl, b.type AS bt, u.type AS ut, s.type AS st,
    u.doc IS NOT NULL AND CASE WHEN b.doc IS NOT NULL THEN u.label IS DISTINCT FROM b.label ELSE u.label IS NOT NULL END AS ol, u.doc IS NOT NULL AND CASE WHEN b.doc IS NOT NULL THEN u.type IS DISTINCT FROM b.type ELSE u.type IS NOT NULL END AS ot
  FROM k LEFT JOIN b USING (doc, field_id) LEFT JOIN u USING (doc, field_id) LEFT JOIN s USING (doc, field_id)
)
SELECT doc, field_id, CASE WHEN ol THEN ul WHEN ins THEN sl ELSE bl END AS label, CASE WHEN ot THEN ut WHEN ins THEN st ELSE bt END AS type, CASE WHEN ol THEN 'user' ELSE 'scan' END AS label_origin,
  CAST((ol AND ins AND sl IS DISTINCT FROM bl AND sl IS DISTINCT FROM ul) AS INT) + CAST((ot AND ins AND st IS DISTINCT FROM bt AND st IS DISTINCT FROM ut) AS INT) AS conflicts
FROM j WHERE NOT (inb AND NOT inu) AND (ins OR ol OR ot)""")
def three_way_merge(spark, sf_dir):
    """Fields of all orders between the last scan, a person's changes and a new scan."""
    f, d = _frames(spark, sf_dir)
    base = f.select("doc", "field_id", "pos", "label", "type")
    user = base.filter("pos % 5 < 4").select("doc", "field_id", F.when(F.col("pos") % 3 == 0, F.concat(F.lit("meu "), F.col("pos").cast("string"))).otherwise(F.col("label")).alias("label"), "type")
    user = user.unionByName(base.filter("pos = 0").select("doc", F.lit("novo").alias("field_id"), F.lit("Novo").alias("label"), F.lit(None).cast("string").alias("type")))
    scan = d.select("doc", "field_id", F.col("detected_label").alias("label"), F.when(F.col("layout") == "table", "date").otherwise("text").alias("type"))
    m = merging.three_way(base, user, scan, ["doc", "field_id"], ["label", "type"])
    return m.select("doc", "field_id", "label", "type", F.col("origins")["label"].alias("label_origin"), F.size("conflicts").alias("conflicts"))


#: A row for each field, most with a fixed text beside or in it.
_GRID = "SELECT l_orderkey AS doc, 'g' AS section, CAST(l_linenumber AS STRING) AS layout_group, 'r' || CAST(i AS STRING) AS layout_row, i AS pos, 'Campo ' || CAST(l_suppkey AS STRING) AS label, CAST(l_quantity % 4 AS INT) AS start, CAST(l_partkey % 3 AS INT) AS span, CAST(l_suppkey % 20 AS INT) AS grid, l_tax > 0.06 AS locked, CASE l_partkey % 4 WHEN 0 THEN 'campo  ' || CAST(l_suppkey AS STRING) || ' :' WHEN 1 THEN 'Campo ' || CAST(l_suppkey AS STRING) || ': selecione um item.' WHEN 2 THEN 'Outro' END AS fixed, CAST(l_quantity % 4 AS INT) - CAST(l_partkey % 2 AS INT) - 1 AS spot FROM ({0})"


@query(rf"""WITH l AS ({_LINES}), g AS ({_GRID.format('SELECT * FROM l')}),
a AS (SELECT *, greatest(1, least(12, max(grid) OVER (PARTITION BY doc, layout_group))) AS n, count(*) OVER (PARTITION BY doc, layout_group, layout_row) AS m FROM g),
b AS (SELECT *, greatest(0, least(start, n - 1)) AS s FROM a), c AS (SELECT *, greatest(1, least(span, n - s)) AS w, trim(lower({_space('fixed')}), ' :') AS said FROM b),
d AS (SELECT *, fixed IS NOT NULL AND spot >= 0 AND (said = lower(label) OR said = lower(label) || ': selecione um item.') AS named FROM c),
e AS (SELECT *, named AND spot + 1 = s AND NOT locked AS grows, named AND ((spot + 1 = s AND NOT locked) OR (spot < s + w AND s < spot + 1)) AS goes FROM d),
h AS (SELECT *, m = 1 AND NOT (fixed IS NOT NULL AND spot >= 0 AND NOT goes) AND NOT locked AS wide FROM e)
SELECT doc, layout_group, layout_row, pos, n AS grid, CASE WHEN wide THEN 0 WHEN grows THEN spot ELSE s END AS start, CASE WHEN wide THEN n WHEN grows THEN least(n - spot, 1 + w) ELSE w END AS span, wide AS full_width, CASE WHEN fixed IS NOT NULL AND spot >= 0 AND NOT goes THEN fixed END AS fixed
FROM h""")
def normalized_grids(spark, sf_dir):
    """The places of all fields in their grids, and the fixed texts that are left beside them."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("quill_lineitem")
    g = spark.sql(_GRID.format(_LINES.replace("FROM lineitem", "FROM quill_lineitem")))
    fixed = F.when(F.col("fixed").isNotNull() & (F.col("spot") >= 0), F.array(F.struct(F.col("spot").alias("start"), F.lit(1).alias("span"), F.col("fixed").alias("label"))))
    out = merging.normalized(g.withColumn("statics", fixed).drop("fixed", "spot"))
    return out.select("doc", "layout_group", "layout_row", "pos", "grid", "start", "span", "full_width", F.get("statics", F.lit(0))["label"].alias("fixed"))
