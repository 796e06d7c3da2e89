"""Queries on records, matching, layout and histories, each with DuckDB SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text
from ..operators import detect, filters, history, matching, records
from ..operators.graph import components
from ..sources import ooxml
from ..sources.stores import paste_tsv
from .forms import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


_LINES = "SELECT doc_id, CAST(i - 1 AS INT) AS ordinal, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"


def _lines(spark, sf_dir):
    return records.lines(table(spark, sf_dir, "documents"), "doc_id")


@query(_LINES)
def paragraph_records(spark, sf_dir):
    return _lines(spark, sf_dir)


#: A line of fewer than 40 characters stands for a section title.
_SHORT = 40


@query(f"WITH l AS ({_LINES}) SELECT doc_id, ordinal, last_value(CASE WHEN length(line) < {_SHORT} AND line <> '' THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS section FROM l")
def section_forward_fill(spark, sf_dir):
    title = F.when((F.length("line") < _SHORT) & (F.col("line") != ""), F.col("line"))
    return records.forward_fill(_lines(spark, sf_dir), ["doc_id"], ["ordinal"], title, "section").select("doc_id", "ordinal", "section")


@query(f"WITH l AS ({_LINES}) SELECT doc_id, ordinal, last_value(CASE WHEN length(line) BETWEEN 1 AND 140 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS label FROM l")
def previous_label(spark, sf_dir):
    usable = F.when(F.length("line").between(1, 140), F.col("line"))
    return records.previous(_lines(spark, sf_dir), ["doc_id"], ["ordinal"], usable, "label").select("doc_id", "ordinal", "label")


@query("SELECT sha256(text) AS fingerprint, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_fingerprints(spark, sf_dir):
    return matching.duplicates(table(spark, sf_dir, "documents"), "doc_id")


_NAME = "trim(regexp_replace(lower(p_name || ' Nº ' || p_type), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT p_partkey, {_NAME} AS name_key FROM part")
def name_normalize(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.name_key(F.concat("p_name", F.lit(" Nº "), "p_type")).alias("name_key"))


@query(None)
def similar_name_pairs(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" "), "p_brand").alias("name"))
    return matching.similar_names(names)


@query(None)
def similar_name_groups(spark, sf_dir):
    """Connected groups of all templates (parts) by similar names."""
    names = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" "), "p_brand").alias("name"))
    return matching.similar_groups(names, "p_partkey")


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS u, CAST(n_nationkey * 3 % 25 AS INT) AS v FROM nation WHERE n_nationkey % 4 <> 1), s AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (SELECT n_nationkey AS u, n_nationkey AS v FROM nation UNION SELECT r.u, s.v FROM r JOIN s ON r.v = s.u)
SELECT u AS node, min(v) AS grp FROM r GROUP BY u""")
def similar_groups(spark, sf_dir):
    """Connected groups of a graph of links."""
    n = table(spark, sf_dir, "nation")
    edges = n.filter("n_nationkey % 4 <> 1").select(F.col("n_nationkey").alias("u"), (F.col("n_nationkey") * 3 % 25).alias("v"))
    return components(n.select(F.col("n_nationkey").alias("node")), edges)


@query("SELECT doc_id, ordinal, line AS text FROM (" + _LINES + ")")
def docx_round_trip(spark, sf_dir):
    """Documents written as DOCX packages and read back as paragraph records."""
    made = ooxml.to_docx(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("doc_id").cast("string").alias("path"), "content")
    return ooxml.parse_docx(made).select(F.col("path").cast("long").alias("doc_id"), "ordinal", "text")


# Saved answers of customers for the suppliers of their nation: exact id, then account, then segment.
_STAGES = """s1 AS (SELECT n_nationkey AS k, s_suppkey AS t, min(c_name) AS value, 1 AS stage FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN customer ON c_custkey = s_suppkey AND c_nationkey = n_nationkey GROUP BY 1, 2),
s2 AS (SELECT s_nationkey AS k, s_suppkey AS t, min(c_name) AS value, 2 AS stage FROM supplier JOIN customer ON c_nationkey = s_nationkey AND c_custkey % 10 = s_suppkey % 10 GROUP BY 1, 2),
s3 AS (SELECT s_nationkey AS k, s_suppkey AS t, min(c_name) AS value, 3 AS stage FROM supplier JOIN customer ON c_nationkey = s_nationkey GROUP BY 1, 2)"""


@query(f"""WITH {_STAGES}, u AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3), b AS (SELECT k, t, arg_min(value, stage) AS value, min(stage) AS stage FROM u GROUP BY 1, 2)
SELECT s_nationkey AS nation, s_suppkey AS target_id, value, stage FROM supplier LEFT JOIN b ON k = s_nationkey AND t = s_suppkey""")
def profile_resolve(spark, sf_dir):
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    target = s.select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("target_id"))
    near = c.select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_name")
    pick = lambda df: df.groupBy("nation", "target_id").agg(F.min("c_name").alias("value"))
    # Answers are aggregated by what each stage matches on before they meet the targets: no stage pairs all of a nation.
    exact = target.join(near.withColumnRenamed("c_custkey", "target_id"), ["nation", "target_id"])
    digit = near.groupBy("nation", (F.col("c_custkey") % 10).alias("digit")).agg(F.min("c_name").alias("c_name"))
    any_ = near.groupBy("nation").agg(F.min("c_name").alias("c_name"))
    stages = [pick(exact), pick(target.withColumn("digit", F.col("target_id") % 10).join(digit, ["nation", "digit"])), pick(target.join(any_, "nation"))]
    return matching.resolve(target, stages, "nation")


def _described(df, key, ident, label, kind, section):
    return df.select(F.col(key).alias("k"), F.col(ident).cast("string").alias("field_id"), text.identity_text(label).alias("label_norm"), kind.alias("type"), text.identity_text(section).alias("section_norm"), matching.semantic_identity(label, F.col(ident).cast("string")).alias("semantic"))


@query("""WITH s AS (SELECT p_size AS k, CAST(p_partkey AS VARCHAR) AS id, lower(p_name) AS l, CASE WHEN p_partkey % 2 = 0 THEN 'text' ELSE 'date' END AS t, lower(replace(p_brand, '#', ' ')) AS sec FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0),
t AS (SELECT p_size AS k, CAST(p_partkey AS VARCHAR) AS id, lower(p_name) AS l, CASE WHEN p_partkey % 3 = 0 THEN 'text' ELSE 'date' END AS t, lower(replace(p_brand, '#', ' ')) AS sec FROM part WHERE p_partkey % 2 = 1),
p AS (SELECT s.k, t.id AS target_id, s.id AS source_id, CASE WHEN s.t = t.t THEN 98 ELSE 82 END + CASE WHEN s.sec = t.sec THEN 2 ELSE 0 END AS score FROM s JOIN t ON s.k = t.k AND s.l = t.l),
a AS (SELECT * FROM p WHERE score >= 90), b AS (SELECT *, max(score) OVER (PARTITION BY k, target_id) AS m FROM a), c AS (SELECT *, count(*) OVER (PARTITION BY k, target_id) AS n FROM b WHERE score = m),
d AS (SELECT * FROM c WHERE n = 1), e AS (SELECT *, max(score) OVER (PARTITION BY k, source_id) AS m2 FROM d), f AS (SELECT *, count(*) OVER (PARTITION BY k, source_id) AS n2 FROM e WHERE score = m2)
SELECT k, target_id, source_id, CAST(score AS INT) AS score FROM f WHERE n2 = 1""")
def identity_ambiguity(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    section = F.replace("p_brand", F.lit("#"), F.lit(" "))
    s = _described(p.filter("p_partkey % 2 = 0 OR p_partkey % 3 = 0"), "p_size", "p_partkey", F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, "text").otherwise("date"), section)
    t = _described(p.filter("p_partkey % 2 = 1"), "p_size", "p_partkey", F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, "text").otherwise("date"), section)
    return matching.identity_matches(s, t, "k")


@query("SELECT source, lang, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) = 1")
def dedupe_candidates(spark, sf_dir):
    return records.dedupe(table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars"), ["source", "lang"], [F.desc("n_chars"), F.asc("doc_id")])


@query("""WITH c AS (SELECT o_custkey AS doc, o_orderkey AS cand, CASE WHEN o_orderpriority = '1-URGENT' THEN 'table' ELSE 'field' END AS kind, list(DISTINCT l_linenumber) AS places FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
h AS (SELECT c.doc, c.cand, min(t.cand) AS t_cand FROM c JOIN c AS t ON c.doc = t.doc AND c.kind = 'field' AND t.kind = 'table' AND list_has_all(t.places, c.places) GROUP BY ALL)
SELECT c.doc, cand, kind, (SELECT count(*) FROM h WHERE h.doc = c.doc AND t_cand = c.cand) AS suppressed FROM c WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc = c.doc AND h.cand = c.cand)""")
def region_ownership(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("places"))
    c = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    c = c.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("cand"), F.when(F.col("o_orderpriority") == "1-URGENT", "table").otherwise("field").alias("kind"), "places")
    return records.suppress_owned(c, "doc").select("doc", "cand", "kind", "suppressed")


@query("""WITH e AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events)
SELECT user_id, event_type, min(event_id) AS first_event, count(*) AS n FROM e GROUP BY user_id, event_type, g""")
def checkbox_runs(spark, sf_dir):
    rows = records.islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return rows.groupBy("user_id", "event_type", "island").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n")).drop("island")


@query("SELECT l_orderkey, count(*) AS n_rows FROM lineitem GROUP BY 1 HAVING min(l_linenumber) = 1 AND max(l_linenumber) = count(DISTINCT l_linenumber) AND count(*) = count(DISTINCT l_linenumber) AND count(*) >= 2")
def numbered_table(spark, sf_dir):
    return records.numbered_table(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


_PEERS = "SELECT l_suppkey AS doc, 0 AS table_index, CAST(l_orderkey % 40 AS INT) AS row_index, CAST(l_linenumber AS INT) AS cell_index, max(l_partkey) AS p FROM lineitem GROUP BY ALL"


@query(f"""WITH c AS ({_PEERS}), w AS (SELECT doc, cell_index FROM c WHERE p % 3 = 0 GROUP BY ALL HAVING count(DISTINCT row_index) >= 2)
SELECT doc, row_index, cell_index, CAST(0.68 AS DOUBLE) AS confidence FROM c WHERE p % 3 = 1 AND p % 4 > 0 AND EXISTS (SELECT 1 FROM w WHERE w.doc = c.doc AND w.cell_index = c.cell_index)""")
def consistency_repair(spark, sf_dir):
    """Blank cells (a third of all) in columns that other rows can edit; a quarter of them have too weak a label."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    c = l.groupBy(F.col("l_suppkey").alias("doc"), F.lit(0).alias("table_index"), (F.col("l_orderkey") % 40).cast("int").alias("row_index"), F.col("l_linenumber").cast("int").alias("cell_index")).agg(F.max("l_partkey").alias("p"))
    k = F.col("p") % 3
    cells = c.select("doc", "table_index", "row_index", "cell_index", F.when(k == 0, "____").when(k == 1, "").otherwise("texto").alias("text"), (k == 0).alias("editable"), F.when(F.col("p") % 4 == 0, 0.7).otherwise(0.74).alias("label_confidence"))
    return detect.consistency_repairs(cells).select("doc", "row_index", "cell_index", "confidence")


_GRID = "SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS pos, l_linenumber % 2 AS header, CAST(1 + l_quantity % 3 AS INT) AS span, l_partkey FROM lineitem"


@query(f"""WITH g AS ({_GRID}), s AS (SELECT *, CAST(coalesce(sum(span) OVER (PARTITION BY doc, header ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start FROM g)
SELECT c.doc, c.start, string_agg(CAST(h.l_partkey AS VARCHAR), ' / ' ORDER BY h.start) AS header FROM s c JOIN s h ON c.doc = h.doc AND c.header = 0 AND h.header = 1 AND c.start < h.start + h.span AND h.start < c.start + c.span AND h.span < 12 GROUP BY c.doc, c.start""")
def header_overlap(spark, sf_dir):
    w = W.partitionBy("doc").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    g = table(spark, sf_dir, "lineitem").withColumn("doc", F.col("l_orderkey")).select("doc", F.row_number().over(w).alias("pos"), (F.col("l_linenumber") % 2).alias("h"), (1 + F.col("l_quantity") % 3).cast("int").alias("span"), F.col("l_partkey").cast("string").alias("text"))
    s = records.starts(g, ["doc", "h"], ["pos"], "span")
    return records.overlap_headers(s.filter("h = 0"), s.filter("h = 1"), ["doc"], 12)


@query("""WITH h AS (SELECT o_custkey AS k, o_orderdate AS at, max(o_orderpriority) AS header FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2), r AS (SELECT o_custkey AS k, o_orderkey, o_orderdate AS at FROM orders)
SELECT r.k, o_orderkey, header FROM r ASOF LEFT JOIN h ON r.k = h.k AND r.at >= h.at""")
def header_asof(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.col("o_orderdate").alias("at"), "o_orderpriority", "o_orderstatus")
    h = o.filter("o_orderstatus = 'F'").groupBy("k", "at").agg(F.max("o_orderpriority").alias("header"))
    return records.header_asof(o.select("k", "o_orderkey", "at"), h, "k", "at", "header").select("k", "o_orderkey", "header")


@query("""WITH i AS (SELECT l_suppkey AS doc, l_orderkey * 10 + l_linenumber AS cell, CAST(l_partkey % 200 AS INT) AS s, CAST(l_partkey % 200 + l_quantity % 5 AS INT) AS e FROM lineitem),
m AS (SELECT *, max(e) OVER (PARTITION BY doc ORDER BY s, e, cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i) SELECT doc, cell, s, e FROM m WHERE s < before""")
def overlap_issues(spark, sf_dir):
    at = F.col("l_partkey") % 200
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cell"), at.cast("int").alias("s"), (at + F.col("l_quantity") % 5).cast("int").alias("e"))
    return records.overlapping(cells, ["doc"], "s", "e", "cell")


@query("SELECT source, lang AS section, count(*) AS n_fields, CAST(sum(n_chars) AS BIGINT) AS chars, min(doc_id) AS first_field FROM documents GROUP BY ALL")
def section_cards(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", F.col("lang").alias("section")).agg(F.count("*").alias("n_fields"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first_field"))


@query("""WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS g FROM conversations)
SELECT conv_id, role, min(turn) AS first_turn, count(*) AS n FROM t GROUP BY conv_id, role, g""")
def layout_blocks(spark, sf_dir):
    rows = records.islands(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role")
    return rows.groupBy("conv_id", "role", "island").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n")).drop("island")


@query("SELECT o_custkey, count(*) AS fields, count(*) FILTER (WHERE o_orderstatus = 'F') AS answered, count(*) FILTER (WHERE o_orderstatus <> 'F' AND o_orderpriority < '3') AS missing, 100 * count(*) FILTER (WHERE o_orderstatus = 'F') // count(*) AS percent FROM orders GROUP BY 1")
def progress(spark, sf_dir):
    return history.progress(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderstatus") == "F", F.col("o_orderpriority") < "3")


@query("""WITH o AS (SELECT p_brand, p_type, min(p_partkey) AS k FROM part GROUP BY ALL), v AS (SELECT p_brand, split_part(p_type, ' ', 1) AS value, min(k) AS k, arg_min(p_type, k) AS label FROM o GROUP BY ALL)
SELECT p_brand, string_agg(label || '=' || value, ';' ORDER BY k) AS options FROM v GROUP BY p_brand""")
def dropdown_normalize(spark, sf_dir):
    o = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("k"))
    raw = F.transform(F.array_sort(F.collect_list(F.struct("k", "p_type"))), lambda x: F.concat(x["p_type"], F.lit(" => "), F.split(x["p_type"], " ")[0]))
    made = o.groupBy("p_brand").agg(raw.alias("raw")).select("p_brand", records.options(F.col("raw")).alias("o"))
    return made.select("p_brand", F.array_join(F.transform("o", lambda x: F.concat(x["label"], F.lit("="), x["value"])), ";").alias("options"))


@query("SELECT p_partkey, 0 AS row, trim(p_name) AS name, trim(p_brand) AS brand FROM part UNION ALL SELECT p_partkey, 1, trim(p_type), '' FROM part")
def tsv_paste(spark, sf_dir):
    pasted = F.concat_ws("\t", "p_name", "p_brand", F.lit("dropped"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(pasted, F.lit("\r\n \n"), "p_type").alias("t"))
    return paste_tsv(rows, "p_partkey", "t", ["name", "brand"])


_NEEDLE = "re"


@query(f"""WITH u AS (SELECT 'customer' AS kind, c_custkey AS id, c_name || ' ' || c_mktsegment AS t FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'part', p_partkey, p_name || ' ' || p_type FROM part UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation)
SELECT kind, id FROM u WHERE contains(lower(t), '{_NEEDLE}')""")
def global_search(spark, sf_dir):
    t = lambda name, *cols: table(spark, sf_dir, name).select(*cols)
    return filters.search(_NEEDLE, customer=t("customer", "c_custkey", "c_name", "c_mktsegment"), supplier=t("supplier", "s_suppkey", "s_name"), part=t("part", "p_partkey", "p_name", "p_type"), nation=t("nation", "n_nationkey", "n_name"))


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def favorites_prune(spark, sf_dir):
    alive = table(spark, sf_dir, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"))
    return matching.prune(table(spark, sf_dir, "supplier"), alive, "s_nationkey").select("s_suppkey", "s_nationkey")


@query("SELECT 'customer' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents")
def overview_counts(spark, sf_dir):
    return filters.overview(**{name: table(spark, sf_dir, name) for name in ("customer", "orders", "events", "documents")})


# ---------------------------------------------------------------- histories


@query("SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS INT) AS y, lpad(CAST(row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS VARCHAR), 4, '0') AS number FROM orders")
def sequence_numbers(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return history.sequences(o, [F.col("o_custkey"), F.year("o_orderdate")], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"), "number")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def drafts_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return history.latest(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT user_id, event_id, event_type FROM l ORDER BY ts DESC, event_id DESC LIMIT 250")
def recent_topk(spark, sf_dir):
    e = history.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")])
    return history.newest(e, [F.desc("ts"), F.desc("event_id")], history.RECENT_CAP).select("user_id", "event_id", "event_type")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 2000")
def audit_topk(spark, sf_dir):
    return history.newest(table(spark, sf_dir, "events"), [F.desc("ts"), F.desc("event_id")], history.AUDIT_CAP).select("event_id", "event_type")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) > 7")
def retention(spark, sf_dir):
    return history.beyond(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], history.BACKUPS_KEPT).select("o_custkey", "o_orderkey")


@query("""WITH b AS (SELECT c_custkey AS k, c_name AS v FROM customer), ch AS (SELECT o_custkey AS k, o_orderpriority AS v, o_orderstatus = 'P' AS deleted FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT k, v FROM b WHERE k NOT IN (SELECT k FROM ch) UNION ALL SELECT k, v FROM ch WHERE NOT deleted""")
def store_upsert(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    changes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"), (F.col("o_orderstatus") == "P").alias("deleted"), "o_orderdate", "o_orderkey")
    return history.upsert(base, changes, ["k"], [F.col("o_orderdate"), F.col("o_orderkey")])


@query("""WITH n AS (SELECT p_partkey, lower(replace(p_brand, '#', '_')) AS base FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS k FROM n)
SELECT p_partkey, CASE WHEN k = 1 THEN base ELSE base || '_' || CAST(k AS VARCHAR) END AS unique_id FROM r""")
def unique_field_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("base"), F.lit(1).alias("doc"))
    return records.unique_ids(rows, "base", ["p_partkey"], "doc").select("p_partkey", "unique_id")
