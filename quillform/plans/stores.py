"""Queries on keyed stores, each with DuckDB SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stores
from .forms import table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


@query("""WITH e AS (SELECT p_partkey AS id, p_name AS label, CASE WHEN p_partkey % 3 = 0 THEN 'manual' ELSE 'auto' END AS ls, p_type AS t, CASE WHEN p_partkey % 4 = 0 THEN 'user' ELSE 'auto' END AS ts FROM part WHERE p_partkey % 5 > 0),
s AS (SELECT p_partkey AS id, p_size AS pos, p_brand AS label, 'text' AS t FROM part WHERE p_partkey % 7 > 0)
SELECT s.id, pos, CASE WHEN ls = 'manual' THEN e.label ELSE s.label END AS label, CASE WHEN ts = 'user' THEN e.t ELSE s.t END AS type, e.id IS NULL AS is_new FROM s LEFT JOIN e USING (id)""")
def merge_scanned(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    e = p.filter("p_partkey % 5 > 0").select(k.alias("id"), F.col("p_name").alias("label"), F.when(k % 3 == 0, "manual").otherwise("auto").alias("label_source"), F.col("p_type").alias("type"), F.when(k % 4 == 0, "user").otherwise("auto").alias("type_source"))
    s = p.filter("p_partkey % 7 > 0").select(k.alias("id"), F.col("p_size").alias("pos"), F.col("p_brand").alias("label"), F.lit("text").alias("type"))
    return stores.merge_scanned(e, s, ["id"])


_CANDS = "SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS cand, CAST(l_partkey % 12 AS INT) AS start, CAST(1 + l_suppkey % 4 AS INT) AS span, CASE l_returnflag WHEN 'A' THEN 40 WHEN 'N' THEN 30 ELSE 10 END AS a FROM lineitem"


@query(f"""WITH c AS ({_CANDS}) SELECT doc, cand, start, span FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS b WHERE b.doc = c.doc AND b.start < c.start + c.span AND c.start < b.start + b.span AND (-b.a, b.start, b.cand) < (-c.a, c.start, c.cand))""")
def overlap_suppression(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    a = F.when(F.col("l_returnflag") == "A", "native").when(F.col("l_returnflag") == "N", "explicit").otherwise("assisted")
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.row_number().over(w).alias("cand"), (F.col("l_partkey") % 12).cast("int").alias("start"), (1 + F.col("l_suppkey") % 4).cast("int").alias("span"), a.alias("source"))
    rank = F.create_map(*[F.lit(x) for kv in stores.AUTHORITY.items() for x in kv])[F.col("source")]
    return stores.suppress_overlaps(c, ["doc"], rank).select("doc", "cand", "start", "span")


@query("""WITH t AS (SELECT 'doc ' || o_orderpriority AS base, count(*) FILTER (WHERE o_orderkey <= 40) AS top FROM orders GROUP BY 1), w AS (SELECT o_orderkey, 'doc ' || o_orderpriority AS name FROM orders WHERE o_orderkey > 40),
n AS (SELECT o_orderkey, name, row_number() OVER (PARTITION BY name ORDER BY o_orderkey) + top AS n FROM w JOIN t ON name = base)
SELECT o_orderkey, CASE WHEN n = 1 THEN name ELSE name || '_' || CAST(n AS VARCHAR) END AS free FROM n""")
def collision_names(spark, sf_dir):
    """Names of later orders among those that the first forty have taken."""
    from pyspark.sql import Window as W

    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("doc "), "o_orderpriority").alias("name"))
    n = F.row_number().over(W.partitionBy("name").orderBy("o_orderkey"))
    taken = o.filter("o_orderkey <= 40").withColumn("n", n).select(F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat_ws("_", "name", F.col("n").cast("string"))).alias("name"))
    return stores.free_names(o.filter("o_orderkey > 40"), taken, "name", ["o_orderkey"]).select("o_orderkey", "free")


@query("""WITH f AS (SELECT n_regionkey AS r, list(CAST(n_nationkey AS VARCHAR) ORDER BY n_nationkey) AS fav FROM nation GROUP BY 1)
SELECT n_nationkey, array_to_string(CASE WHEN list_contains(fav, CAST(n_nationkey % 7 AS VARCHAR)) THEN list_filter(fav, lambda x: x <> CAST(n_nationkey % 7 AS VARCHAR)) ELSE list_append(fav, CAST(n_nationkey % 7 AS VARCHAR)) END, ',') AS favorites FROM nation JOIN f ON r = n_regionkey""")
def favorites_toggle(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    f = n.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list("n_nationkey")), lambda x: x.cast("string")).alias("fav"))
    return n.join(f, "n_regionkey").select("n_nationkey", F.array_join(stores.toggle(F.col("fav"), (F.col("n_nationkey") % 7).cast("string")), ",").alias("favorites"))


@query("""WITH c AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events), d AS (SELECT * FROM c WHERE before IS NULL OR before <> event_type)
SELECT user_id, event_id, event_type FROM d QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5""")
def undo_snapshots(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return stores.snapshots(e, "user_id", ["ts", "event_id"], "event_type", cap=5).select("user_id", "event_id", "event_type")


@query("SELECT p_brand AS id, 'custom' AS kind FROM part WHERE p_size < 20 GROUP BY 1 UNION ALL SELECT p_brand, 'builtin' FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size < 20) GROUP BY 1")
def library_union(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    built, custom = p.select(F.col("p_brand").alias("id")).distinct().withColumn("kind", F.lit("builtin")), p.filter("p_size < 20").select(F.col("p_brand").alias("id")).distinct().withColumn("kind", F.lit("custom"))
    return stores.library(built, custom)
